"""Edge filters, validity and version-aware joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vergraph.plans.graph import EdgeSource, Graph, at_ends, counted_at_ends, cut
from vergraph.schema import VALID_ENDPOINTS


def edges_where(edges: DataFrame, from_id: str | None = None, to_id: str | None = None, rel_type: str | None = None) -> DataFrame:
    """Edges that meet all given conditions (FLT10)."""
    for column, value in (("from_entity_id", from_id), ("to_entity_id", to_id), ("relationship_type", rel_type)):
        if value is not None:
            edges = edges.where(F.col(column) == value)
    return edges


def pinned(graph: Graph, edges: DataFrame | None = None) -> DataFrame:
    """Edges whose endpoints are pinned to the current versions (JON3)."""
    now = graph.latest().select("id", "version")
    return at_ends(graph.edge_source() if edges is None else edges, {"from": now, "to": now}, "left_semi")


def relationships_of(graph: Graph, from_id: str | None = None, to_id: str | None = None, rel_type: str | None = None) -> DataFrame:
    """With an endpoint given, only pinned edges; without, all (trap T3)."""
    edges = edges_where(graph.relationships, from_id, to_id, rel_type)
    return edges if from_id is None and to_id is None else pinned(graph, edges)


def existing(edges: DataFrame | EdgeSource, entities: DataFrame, exact: bool = False) -> DataFrame:
    """Edges both of whose endpoints exist: by id (JON4), or at the exact version (JON5)."""
    rows = entities.select("id", "version") if exact else entities.select("id")
    return at_ends(edges, {"from": rows, "to": rows}, "left_semi")


def existing_counts(edges: DataFrame | EdgeSource, entities: DataFrame, by: list[str], exact: bool = False) -> DataFrame:
    """``by``, n of ``existing``."""
    rows = entities.select("id", "version") if exact else entities.select("id")
    return counted_at_ends(edges, {"from": rows, "to": rows}, "left_semi", by)


def with_endpoints(edges: DataFrame | EdgeSource, entities: DataFrame) -> DataFrame:
    """Edges with name and type of both pinned endpoint rows (JON2)."""
    rows = entities.select("id", "version", "name", F.col("entity_type").alias("type"))
    return at_ends(edges, {"from": rows, "to": rows}, "left")


def validity(spark) -> DataFrame:
    """relationship_type, from_type, to_type of all allowed combinations (39 rows)."""
    return spark.createDataFrame([(k, a, b) for k, pairs in VALID_ENDPOINTS.items() for a, b in pairs], "relationship_type string, from_type string, to_type string")


def checked(graph: Graph) -> DataFrame:
    """All edges between existing entities, with whether their types are allowed (FLT21)."""
    types = graph.latest().select("id", "entity_type")
    e = graph.relationships.join(types.toDF("from_entity_id", "from_type"), "from_entity_id").join(types.toDF("to_entity_id", "to_type"), "to_entity_id")
    rules = validity(graph.relationships.sparkSession).withColumn("valid", F.lit(True))
    return e.join(F.broadcast(rules), ["relationship_type", "from_type", "to_type"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))  # a fixed table


def connected_pinned(graph: Graph, id_: str, rel_type: str | None = None) -> DataFrame:
    """One hop both ways over pinned edges, with the joined rows (TRV17)."""
    e = pinned(graph, edges_where(graph.relationships, rel_type=rel_type).where((F.col("from_entity_id") == id_) | (F.col("to_entity_id") == id_)))
    out = e.where(F.col("from_entity_id") == id_).select(F.col("to_entity_id").alias("id"), F.col("to_entity_version").alias("version"), "relationship_type", F.lit("outgoing").alias("direction"))
    into = e.where(F.col("to_entity_id") == id_).select(F.col("from_entity_id").alias("id"), F.col("from_entity_version").alias("version"), "relationship_type", F.lit("incoming").alias("direction"))
    return out.unionByName(into).join(graph.entities.select("id", "version", "name", "entity_type"), ["id", "version"])


def upsert_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored edges with those of the same id replaced; of several new ones the
    last (``pos``) counts (SNK3, SNK6, SYN8)."""
    last = _last(new)
    return stored.join(last.select("id"), "id", "left_anti").unionByName(last, allowMissingColumns=True)


def _last(new: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return new.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("pos")))).where("_n = 1").drop("_n", "pos")


def _summed(counts: DataFrame, more: DataFrame, by: list[str]) -> DataFrame:
    return counts.unionByName(more).groupBy(*by).agg(F.sum("n").alias("n")).where("n <> 0")


def upserted_counts(stored: DataFrame | EdgeSource, new: DataFrame, by: list[str]) -> DataFrame:
    """``by``, n of ``upsert_edges``: the stored edges' counts, without the edges
    that are replaced, with the new ones."""
    if isinstance(stored, DataFrame):
        return upsert_edges(stored, new).groupBy(*by).agg(F.count("*").alias("n"))
    last = _last(new)
    gone = stored.among(last.select("id")).groupBy(*by).agg((-F.count("*")).alias("n"))
    came = last.groupBy(*by).agg(F.count("*").alias("n"))
    return _summed(stored.counted({}, "left_semi", by), gone.unionByName(came), by)


def with_ids(edges: DataFrame) -> DataFrame:
    """Edges without an id get one, shaped as a uuid, from what they connect: a
    batch that runs again gives the same ids (SNK3)."""
    h = F.when(F.col("id").isNull(), F.md5(F.concat_ws("|", "relationship_type", "from_entity_id", "to_entity_id")))
    made = F.concat_ws("-", *[F.substring("_hash", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    # a column of its own: named five times in one expression, the hash is computed five times
    return edges.withColumn("_hash", h).withColumn("id", F.coalesce("id", made)).drop("_hash")


def replace_touching(edges: DataFrame | EdgeSource, ids: DataFrame, new: DataFrame) -> DataFrame:
    """Edges that touch any of the ids give way to the new ones (SNK7)."""
    ids = ids.select("id")
    return at_ends(edges, {"from": ids, "to": ids}, "left_anti").unionByName(new, allowMissingColumns=True)


def replaced_counts(edges: DataFrame | EdgeSource, ids: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """``by``, n of ``replace_touching``."""
    ids = ids.select("id")
    return _summed(counted_at_ends(edges, {"from": ids, "to": ids}, "left_anti", by), new.groupBy(*by).agg(F.count("*").alias("n")), by)


def upkeep(graph: Graph, nodes: DataFrame, edges: DataFrame) -> Graph:
    """The loaded graph after a batch of node and edge rows: of each id the last
    (``pos``) counts, a tombstone takes the node out with its edges, and an edge
    whose endpoints are both there comes in (TRV20, SYN15)."""
    alive = _alive(graph, nodes)
    kept = existing(upsert_edges(graph.relationships, edges), alive)
    return Graph(alive, kept)


def _alive(graph: Graph, nodes: DataFrame) -> DataFrame:
    from vergraph.functions.values import is_tombstoned
    from vergraph.operators.replica import keep_last

    last = keep_last(nodes, ["id"], "pos").drop("pos")
    stored = graph.latest().join(last.select("id"), "id", "left_anti").unionByName(last, allowMissingColumns=True)
    return stored.where(~is_tombstoned(F.col("content")))


def upkeep_counts(graph: Graph, nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """``by``, n of the edges of ``upkeep``: the stored ones between what is there, counted
    at their ends, without those that are replaced, with the new ones."""
    alive, stored, last = cut(_alive(graph, nodes).select("id")), graph.edge_source(), _last(edges)  # for each kind again
    if isinstance(stored, DataFrame):
        return existing_counts(upsert_edges(stored, edges), alive, by)
    gone = existing(stored.among(last.select("id")), alive).groupBy(*by).agg((-F.count("*")).alias("n"))
    came = existing_counts(last, alive, by)
    return _summed(existing_counts(stored, alive, by), gone.unionByName(came), by)
