"""Upkeep of counts by signed differences.

A batch of changed nodes and edges is turned into rows with a sign: what the
loaded graph (current, undeleted nodes, and the edges between them) had of what
the batch touches, with -1, and what it has after it, with 1.  Touched are the
changed edges, and the edges of nodes that came, went, or came back.  Degrees,
counts by type and connected ids follow by adding up signs; nothing else of the
graph is looked at.

A change of whole edge types (``retyped``) names no edge: its signs are added up
by end and type where the edges come from, before they are made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vergraph.functions.values import is_tombstoned
from vergraph.plans.graph import Graph, counted_at_ends, cut

from .relations import upsert_edges
from .replica import keep_last

ENDS = ("from_entity_id", "to_entity_id")


@dataclass
class Counts:
    """``degrees``: id, out_degree, in_degree (without ids that have no edge);
    ``types``: what (entity, relationship), type, n (without zeros)."""

    degrees: DataFrame
    types: DataFrame

    def connected(self) -> DataFrame:
        """Ids with an edge."""
        return self.degrees.select("id")

    def totals(self) -> DataFrame:
        """total_entities, total_relationships, connected_entities: one row."""
        n = self.types.agg(*[F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).alias(c) for w, c in (("entity", "total_entities"), ("relationship", "total_relationships"))])
        return n.crossJoin(self.degrees.agg(F.count("*").alias("connected_entities")))  # single rows


@dataclass
class Signed:
    """``nodes``: id, entity_type, sign; ``edges``: rel, src, dst, relationship_type, sign."""

    nodes: DataFrame
    edges: DataFrame


def _alive(nodes: DataFrame) -> DataFrame:
    return nodes.where(~is_tombstoned(F.col("content"))).select("id", "entity_type")


def _between(edges: DataFrame, alive: DataFrame) -> DataFrame:
    """Edges of which both ends are alive."""
    for side in ENDS:
        edges = edges.join(alive.select(F.col("id").alias(side)), side, "left_semi")
    return edges.select(F.col("id").alias("rel"), F.col("from_entity_id").alias("src"), F.col("to_entity_id").alias("dst"), "relationship_type")


def applied(graph: Graph, nodes: DataFrame, edges: DataFrame) -> Graph:
    """The stored graph after a batch: of each id the last row (``pos``) counts;
    tombstones and edges without their ends are kept, as they may come back."""
    last = keep_last(nodes, ["id"], "pos").drop("pos")
    rows = graph.latest().join(last.select("id"), "id", "left_anti").unionByName(last, allowMissingColumns=True)
    return Graph(rows, upsert_edges(graph.relationships, edges))


def differences(graph: Graph, nodes: DataFrame, edges: DataFrame) -> Signed:
    """What a batch changes in the loaded graph.  ``nodes`` and ``edges`` as for ``applied``."""
    last = keep_last(nodes, ["id"], "pos").drop("pos")
    ids = last.select("id")
    old, new = _alive(graph.latest().join(ids, "id", "left_semi")), _alive(last)
    came = old.select("id", F.lit(-1).alias("s")).union(new.select("id", F.lit(1).alias("s"))).groupBy("id").agg(F.sum("s").alias("s")).where("s <> 0").select("id")  # alive before or after, not both
    came = cut(came)
    fresh = keep_last(edges, ["id"], "pos").drop("pos")
    changed = cut(graph.relationships.join(fresh.select("id"), "id", "left_semi"))
    around = graph.relationships.join(fresh.select("id"), "id", "left_anti")
    out = around.join(came.select(F.col("id").alias(ENDS[0])), ENDS[0], "left_semi").select(*changed.columns)
    into = around.join(came.select(F.col("id").alias(ENDS[1])), ENDS[1], "left_semi").select(*changed.columns)
    incident = cut(out.union(into).dropDuplicates(["id"]))
    # the ends of touched edges before and after the batch
    touched = changed.select(*ENDS).union(incident.select(*ENDS)).union(fresh.select(*ENDS))
    ends = touched.select(F.col(ENDS[0]).alias("id")).union(touched.select(F.col(ENDS[1]))).distinct()
    before = cut(_alive(graph.latest().join(ends, "id", "left_semi")))
    after = before.join(ids, "id", "left_anti").union(new)
    kept = [c for c in changed.columns if c in fresh.columns]
    signed = _between(changed.select(*kept).union(incident.select(*kept)), before).withColumn("sign", F.lit(-1)).union(_between(fresh.select(*kept).union(incident.select(*kept)), after).withColumn("sign", F.lit(1)))
    whole = ["rel", "src", "dst", "relationship_type"]
    signed = signed.groupBy(*whole).agg(F.sum("sign").cast("long").alias("sign")).where("sign <> 0")
    return Signed(_signed_nodes(old, new), signed)


@dataclass
class Tallied:
    """``Signed`` edges added up: ``nodes`` as there; ``degrees``: id, out_degree,
    in_degree; ``types``: relationship_type, sign."""

    nodes: DataFrame
    degrees: DataFrame
    types: DataFrame


def retyped(graph: Graph, nodes: DataFrame, types: list[str], to: str) -> Tallied:
    """As ``differences`` for a batch of ``nodes`` and of all edges of some types,
    which get the type ``to``.  The graph has a ``source`` of edges."""
    last = keep_last(nodes, ["id"], "pos").drop("pos")
    was, new = _alive(graph.latest()), _alive(last)
    now = was.join(last.select("id"), "id", "left_anti").union(new)
    old = was.join(last.select("id"), "id", "left_semi")
    no, yes = F.lit(False), F.lit(True)
    state = cut(was.select("id", yes.alias("was"), no.alias("now")).union(now.select("id", no, yes)).groupBy("id").agg(F.max("was").alias("was"), F.max("now").alias("now")))
    changed, same = state.where("was <> now"), state.where("was = now")
    moved, others = graph.source.of_types(types), graph.source.of_types(types, others=True)
    # of the other edges only those of nodes that came or went, each once
    parts = [(moved, state, state), (others, changed, state), (others, same, changed)]
    flags = ["from_was", "from_now", "to_was", "to_now"]

    def signs(by: list[str]) -> DataFrame:
        """``by``, before, after: edges with both ends alive."""
        rows = None
        for edges, a, b in parts:
            n = counted_at_ends(edges, {"from": a, "to": b}, "inner", [*by, *flags]).withColumn("moved", F.lit(edges is moved))
            rows = n if rows is None else rows.unionByName(n)
        return rows.select(*by, "moved", *[F.when(F.col(f"from_{s}") & F.col(f"to_{s}"), F.col("n")).otherwise(0).alias(s) for s in ("was", "now")])

    of_types = signs(["relationship_type"])
    kept = F.when(F.col("moved"), F.lit(to)).otherwise(F.col("relationship_type"))
    of_types = of_types.select("relationship_type", (-F.col("was")).alias("sign")).union(of_types.select(kept, "now"))
    zero = F.lit(0).cast("long")
    out, into = (signs([c]).select(F.col(c).alias("id"), (F.col("now") - F.col("was")).alias("d")) for c in ENDS)
    degrees = out.select("id", F.col("d").alias("out_degree"), zero.alias("in_degree")).union(into.select("id", zero, "d"))
    return Tallied(_signed_nodes(old, new), degrees, of_types)


def _signed_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.withColumn("sign", F.lit(-1)).union(new.withColumn("sign", F.lit(1))).groupBy("id", "entity_type").agg(F.sum("sign").cast("long").alias("sign")).where("sign <> 0")


def _degrees(edges: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return edges.select(F.col("src").alias("id"), F.col("sign").alias("out_degree"), zero.alias("in_degree")).union(edges.select("dst", zero, "sign"))


def _types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select(F.lit("entity").alias("what"), F.col("entity_type").alias("type"), F.col("sign").alias("n")).union(edges.select(F.lit("relationship"), "relationship_type", "sign"))


def _added(degrees: DataFrame, types: DataFrame) -> Counts:
    degrees = degrees.groupBy("id").agg(F.sum("out_degree").alias("out_degree"), F.sum("in_degree").alias("in_degree")).where("out_degree <> 0 or in_degree <> 0")
    return Counts(degrees, types.groupBy("what", "type").agg(F.sum("n").alias("n")).where("n <> 0"))


def counted(graph: Graph) -> Counts:
    """The counts of a graph from all of it."""
    alive, one = _alive(graph.latest()), F.lit(1).cast("long")
    nodes = alive.withColumn("sign", one)
    if graph.source is None:
        edges = _between(graph.relationships, alive).withColumn("sign", one)
        return _added(_degrees(edges), _types(nodes, edges))
    ids = cut(alive.select("id").distinct())
    of_types, out, into = (graph.source.counted({"from": ids, "to": ids}, "left_semi", [c]) for c in ("relationship_type", *ENDS))
    zero = F.lit(0).cast("long")
    degrees = out.select(F.col(ENDS[0]).alias("id"), F.col("n").alias("out_degree"), zero.alias("in_degree")).union(into.select(ENDS[1], zero, "n"))
    return _added(degrees, _types(nodes, of_types.withColumnRenamed("n", "sign")))


def kept_up(counts: Counts, signed: Signed | Tallied) -> Counts:
    """The counts after a batch."""
    whole = isinstance(signed, Tallied)
    degrees, edges = (signed.degrees, signed.types) if whole else (_degrees(signed.edges), signed.edges)
    return _added(counts.degrees.union(degrees), counts.types.union(_types(signed.nodes, edges)))
