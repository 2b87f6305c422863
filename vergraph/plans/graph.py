"""A graph as two DataFrames, and how iterative plans cut their lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vergraph.functions.values import is_tombstoned


def shared_place(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset on one machine, as in tests, a new local folder."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="vergraph-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Have Python workers import this package wherever they run: once for an application."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.join(tempfile.mkdtemp(prefix="vergraph-package-"), f"vergraph_graph_{sc.applicationId}")
        sc.addPyFile(shutil.make_archive(name, "zip", os.path.dirname(package), os.path.basename(package)))
        _sent.add(sc.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the executors share."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_place(df.sparkSession))
    return df.checkpoint()


#: Rows of ids up to which a counted table is broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of a counted size, to be broadcast if that is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: Ids that a step may name in its filter, and rows that a walk may hold on the driver.
FEW = 2_000


@dataclass
class Steps:
    """src, dst, relationship_type, rel: the edges a walk takes."""

    edges: DataFrame

    def from_few(self, ids: list[str]) -> DataFrame:
        """Edges that leave one of at most FEW ids."""
        return self.edges.where(F.col("src").isin(ids))

    def from_many(self, ids: DataFrame, rows: int) -> DataFrame:
        """Edges that leave an id of a counted table (column src)."""
        return self.edges.join(small(ids, rows), "src")

    def on_cycles(self) -> Steps:
        """Without edges that are known, before they are read, to lie on no cycle nor between cycles."""
        return self

    def done(self) -> None:
        self.edges.unpersist()


def turned(backwards: bool) -> list[Column]:
    """src, dst of edges that are walked forwards or backwards."""
    ends = [F.col("src"), F.col("dst")]
    return [e.alias(n) for e, n in zip(ends[::-1] if backwards else ends, ("src", "dst"), strict=True)]


@dataclass
class Adjacency:
    """Two bucketed tables of the same edges: by source and by target."""

    spark: SparkSession
    by_src: str
    by_dst: str

    def steps(self, types: list[str] | None = None, backwards: bool = False, known: bool = True) -> Steps:
        t = self.spark.table(self.by_dst if backwards else self.by_src)
        t = t.where(F.col("relationship_type").isin(*types)) if types else t
        t = t.where("known") if known else t
        return Steps(t.select(*turned(backwards), "relationship_type", "rel"))


class EdgeSource(Protocol):
    """Edges that are joined with rows of their ends, or counted, before they are
    made (``at_ends``, ``counted_at_ends``), and found by their ids."""

    def joined(self, ends: dict[str, DataFrame], how: str) -> DataFrame: ...

    def counted(self, ends: dict[str, DataFrame], how: str, by: list[str]) -> DataFrame: ...

    def among(self, ids: DataFrame) -> DataFrame: ...

    def of_types(self, types: list[str], others: bool = False) -> EdgeSource: ...


def at_ends(edges: DataFrame | EdgeSource, ends: dict[str, DataFrame], how: str) -> DataFrame:
    """Edges joined with rows of their ends.  ``ends``: for "from", "to" or both
    rows of id, or id and version, and what else is to come in (name: from_name)."""
    if not isinstance(edges, DataFrame):
        return edges.joined(ends, how)
    for side, rows in ends.items():
        names = {c: f"{side}_entity_{c}" if c in ("id", "version") else f"{side}_{c}" for c in rows.columns}
        edges = edges.join(rows.toDF(*names.values()), [names[c] for c in ("id", "version") if c in names], how)
    return edges


def counted_at_ends(edges: DataFrame | EdgeSource, ends: dict[str, DataFrame], how: str, by: list[str]) -> DataFrame:
    """``by``, n: the rows of ``at_ends`` counted by an edge's columns or those that
    come in.  A source counts pairs that grow with a product of its tables by the
    counts of both sides."""
    if not isinstance(edges, DataFrame):
        return edges.counted(ends, how, by)
    return at_ends(edges, ends, how).groupBy(*by).agg(F.count("*").alias("n"))


class Index(Protocol):
    def steps(self, types: list[str] | None = None, backwards: bool = False, known: bool = True) -> Steps: ...


@dataclass
class Graph:
    """``entities``: version rows (with is_latest); ``relationships``: edges;
    ``index`` gives what steps are read from, if not these: a stored adjacency, or
    the tables behind them; ``source`` the same edges, if they can be joined with
    their ends before they are made."""

    entities: DataFrame
    relationships: DataFrame
    index: Callable[[], Index] | None = None
    source: EdgeSource | None = None

    def edge_source(self) -> DataFrame | EdgeSource:
        return self.relationships if self.source is None else self.source

    def steps(self, types: list[str] | None = None, backwards: bool = False, known: bool = True) -> Steps:
        """The edges, forwards or turned round, of which both ends are nodes (or all
        of them): from the index, or else kept for the time of the walk
        (``done``)."""
        if self.index is not None:
            return self.index().steps(types, backwards, known)
        e = self.edges(types)
        for side in ("src", "dst") if known else ():
            e = e.join(self.entities.select(F.col("id").alias(side)), side, "left_semi")
        return Steps(e.select(*turned(backwards), "relationship_type", "rel").persist())

    def latest(self, include_deleted: bool = True) -> DataFrame:
        """Current rows: those recorded as latest."""
        rows = self.entities.where("is_latest")
        return rows if include_deleted else rows.where(~is_tombstoned(F.col("content")))

    def nodes(self) -> DataFrame:
        """Ids with any version."""
        return self.entities.select("id").distinct()

    def edges(self, types: list[str] | None = None) -> DataFrame:
        """src, dst, relationship_type, rel: all edges, endpoints by id."""
        e = self.relationships.select(F.col("from_entity_id").alias("src"), F.col("to_entity_id").alias("dst"), "relationship_type", F.col("id").alias("rel"))
        return e.where(F.col("relationship_type").isin(*types)) if types else e

    def loaded(self) -> "Graph":
        """Latest, undeleted rows, and the edges between them by id."""
        rows = self.latest(include_deleted=False)
        ids = rows.select("id")
        return Graph(rows, at_ends(self.edge_source(), {"from": ids, "to": ids}, "left_semi"))
