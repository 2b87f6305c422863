"""Graph statistics, digests and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vergraph.plans.graph import Graph


def type_counts(graph: Graph) -> DataFrame:
    """what, type, n: entities and edges by type; types without any are absent."""
    e = graph.latest().groupBy(F.col("entity_type").alias("type")).count().select(F.lit("entity").alias("what"), "type", F.col("count").alias("n"))
    r = graph.relationships.groupBy(F.col("relationship_type").alias("type")).count().select(F.lit("relationship").alias("what"), "type", F.col("count").alias("n"))
    return e.union(r)


def statistics(graph: Graph, clamp: bool = False) -> DataFrame:
    """One row: totals, average degree 2E / V, isolated = V - distinct endpoints
    (AGG1; may be negative with dangling edges, unless clamped: AGG3)."""
    v = graph.latest().agg(F.count("*").alias("total_entities"))
    r = graph.relationships
    ends = r.select("from_entity_id").union(r.select("to_entity_id")).agg(F.count_distinct("from_entity_id").alias("ends"))
    e = r.agg(F.count("*").alias("total_relationships"))
    isolated = F.col("total_entities") - F.col("ends")
    degree = F.coalesce(2 * F.col("total_relationships") / F.nullif("total_entities", F.lit(0)), F.lit(0.0))
    one = v.crossJoin(e).crossJoin(ends)  # single rows
    return one.select("total_entities", "total_relationships", degree.alias("average_degree"), F.round(degree, 2).alias("average_degree_rounded"), (F.greatest(isolated, F.lit(0)) if clamp else isolated).alias("isolated_entities"))


def index_statistics(graph: Graph) -> DataFrame:
    """As the loaded graph has them: no tombstones, no dangling edges (AGG2)."""
    g = graph.loaded()
    e = g.edges()
    ids = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
    alone = g.entities.join(ids, "id", "left_anti").agg(F.count("*").alias("isolated_entities"))
    v, m = g.entities.agg(F.count("*").alias("total_entities")), e.agg(F.count("*").alias("total_relationships"))
    degree = F.coalesce(2 * F.col("total_relationships") / F.nullif("total_entities", F.lit(0)), F.lit(0.0))
    return v.crossJoin(m).crossJoin(alone).select("total_entities", "total_relationships", degree.alias("average_degree"), "isolated_entities")  # single rows


def generation_marker(rows: DataFrame) -> DataFrame:
    """What a cached index compares to see that the store has moved on (AGG4, SYN16)."""
    return rows.agg(F.max("server_seq").alias("max_seq"), F.count("*").alias("n_rows"), F.max("updated_at").alias("newest"))


def state_digest(latest: DataFrame) -> DataFrame:
    """sha256 over id, 0x1f, version, 0x1e of all rows by id (AGG6).  The text of
    a hash is one value by definition; pieces of it are gathered in id order from
    sorted parts, and only (id, version) text, no content, comes together."""
    row = F.concat("id", F.lit("\x1f"), "version", F.lit("\x1e"))
    pieces = latest.select(F.struct("id", row.alias("t")).alias("p")).agg(F.array_sort(F.collect_list("p")).alias("all"))
    return pieces.select(F.sha2(F.array_join(F.transform("all", lambda p: p["t"]), ""), 256).alias("digest"), F.size("all").cast("long").alias("n_entities"))


def bucket_digests(latest: DataFrame, buckets: int = 1024) -> DataFrame:
    """Digests of hash buckets of ids, to compare large states part by part."""
    keyed = latest.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    row = F.concat("id", F.lit("\x1f"), "version", F.lit("\x1e"))
    grouped = keyed.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("id", row.alias("t")))).alias("all"))
    return grouped.select("bucket", F.sha2(F.array_join(F.transform("all", lambda p: p["t"]), ""), 256).alias("digest"))


def like_residue(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows in all, and rows that still match a LIKE pattern (AGG9)."""
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(F.col(column).like(pattern)).alias("n_matching"))


def sync_counters(outcomes: DataFrame) -> DataFrame:
    """client_id, total_syncs, total_conflicts, sync_failures (since the last
    success), last_success_us: the fold of sync outcomes (AGG13, SYN17).
    ``outcomes``: client_id, at_us, ok, conflicts."""
    last = outcomes.groupBy("client_id").agg(F.max(F.when(F.col("ok"), F.col("at_us"))).alias("last_success_us"))
    return (
        outcomes.join(last, "client_id")
        .groupBy("client_id", "last_success_us")
        .agg(F.count("*").alias("total_syncs"), F.sum("conflicts").alias("total_conflicts"), F.count_if(~F.col("ok") & (F.col("at_us") > F.coalesce("last_success_us", F.lit(-(1 << 62))))).alias("sync_failures"))
    )


def drifted(rows: DataFrame, marker: DataFrame) -> DataFrame:
    """One row: whether the rows still have the marker taken before (SYN16)."""
    now = generation_marker(rows)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in now.columns]
    both = now.alias("a").crossJoin(marker.alias("b"))  # single rows
    return both.select((~F.forall(F.array(*same), lambda x: x)).alias("drifted"))
