"""The client's side: pending changes, pulls, tracking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vergraph.plans.graph import EdgeSource, at_ends


def keep_last(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The last arrival of each key replaces the ones before (SNK5, SNK6)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(arrival))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def listed_by_type(rows: DataFrame, entity_type: str, arrival: str) -> DataFrame:
    """The latest row of every id that ever had the type, with ``stale`` where it
    has another one now: the client's index keeps re-typed ids (FLT8); without
    the stale rows it is the plain lookup by type."""
    had = rows.where(F.col("entity_type") == entity_type).select("id").distinct()
    return keep_last(rows.join(had, "id", "left_semi"), ["id"], arrival).withColumn("stale", F.col("entity_type") != entity_type)


def pending_state(edits: DataFrame, acks: DataFrame | None = None) -> DataFrame:
    """id, operation, entry_us: an id that was created locally stays ``create``
    until acknowledged; acknowledged ids leave (CLI3).  ``edits``: id, operation, at_us."""
    if acks is not None:
        edits = edits.join(acks.select("id"), "id", "left_anti")
    first = F.min_by("operation", "at_us")
    return edits.groupBy("id").agg(F.when(first == "create", "create").otherwise("update").alias("operation"), F.min("at_us").alias("entry_us"))


def push_payload(pending: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """id, operation, version, relationships: pending edges ride on their source
    entity's change; edges without a pending source come apart, with a null
    operation (CLI2, JON11)."""
    grouped = edges.groupBy(F.col("from_entity_id").alias("id")).agg(F.array_sort(F.collect_list(F.col("id"))).alias("relationships"))
    own = pending.join(entities.where("is_latest").select("id", "version"), "id").join(grouped, "id", "left")
    orphans = grouped.join(pending, "id", "left_anti").select("id", F.lit(None).cast("string").alias("operation"), F.lit(None).cast("string").alias("version"), "relationships")
    return own.select("id", "operation", "version", F.coalesce("relationships", F.array().cast("array<string>")).alias("relationships")).union(orphans)


def payload_sizes(pending: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """As ``push_payload``, with n_edges in place of the lists: edges are counted
    by source where they are made, and only the counts meet the changes."""
    counts = edges.groupBy(F.col("from_entity_id").alias("id")).agg(F.count("*").alias("n_edges"))
    own = pending.join(entities.where("is_latest").select("id", "version"), "id").join(counts, "id", "left")
    orphans = counts.join(pending, "id", "left_anti").select("id", F.lit(None).cast("string").alias("operation"), F.lit(None).cast("string").alias("version"), "n_edges")
    return own.select("id", "operation", "version", F.coalesce("n_edges", F.lit(0)).cast("int").alias("n_edges")).union(orphans.withColumn("n_edges", F.col("n_edges").cast("int")))


def apply_pull(stored: DataFrame, pulled: DataFrame) -> DataFrame:
    """Unseen versions are appended; the newest version of an id is current (SNK7, CLI4)."""
    fresh = pulled.join(stored.select("id", "version"), ["id", "version"], "left_anti")
    rows = stored.drop("is_latest").unionByName(fresh.drop("is_latest"), allowMissingColumns=True)
    w = Window.partitionBy("id").orderBy(F.desc("created_at"), F.desc("version"))
    return rows.withColumn("is_latest", F.row_number().over(w) == 1)


def pulled_times(changes: DataFrame, now_us: int) -> DataFrame:
    """Adds updated_us from the version string, else the given time (CLI5, CLI7)."""
    from vergraph.functions.values import version_micros

    return changes.withColumn("updated_us", F.coalesce(version_micros(F.col("version")), F.lit(now_us)))


def tracking_state(transitions: DataFrame) -> DataFrame:
    """id, sync_status, retry_count, conflict_reason from transition events id,
    at_us, status, reason; a success resets the count of conflicts (CLI9)."""
    good = transitions.groupBy("id").agg(F.max(F.when(F.col("status") == "synced", F.col("at_us"))).alias("good"))
    rows = transitions.join(good, "id")
    return rows.groupBy("id").agg(F.max_by("status", "at_us").alias("sync_status"), F.count_if((F.col("status") == "conflict") & (F.col("at_us") > F.coalesce("good", F.lit(-(1 << 62))))).alias("retry_count"), F.max_by("reason", "at_us").alias("conflict_reason"))


def with_status(rows: DataFrame, tracking: DataFrame, statuses: list[str]) -> DataFrame:
    """Rows whose tracking has one of the statuses (FLT20)."""
    return rows.join(tracking.where(F.col("sync_status").isin(*statuses)).select("id"), "id", "left_semi")


def type_index(entities: DataFrame) -> DataFrame:
    """entity_type, n, first_id, last_id: the secondary index as a summary (CLI10,
    CLI12); the ids themselves are a filter of the current rows."""
    return entities.where("is_latest").groupBy("entity_type").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def without_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Hard delete (generic CRUD)."""
    return rows.join(ids.select("id"), "id", "left_anti")


def unsent_edges(pending: DataFrame, edges: DataFrame | EdgeSource) -> DataFrame:
    """Pending edges without a pending source (JON11)."""
    return at_ends(edges, {"from": pending.select("id")}, "left_anti")


def sync_cycle(local: DataFrame, server: DataFrame, edits: DataFrame, cursor: int, size: int = 500) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One cycle: the pending ids are those before the pull; the pulled page is
    applied; the pending ids' local rows are pushed; what the server took leaves
    the pending set (CLI1).  Returns the local rows after the pull, the rows to
    push, and the edits still pending when ``push`` is acknowledged."""
    from vergraph.operators.versions import changed_since

    waiting = pending_state(edits)
    pulled = changed_since(server.where("is_latest"), cursor).orderBy("server_seq").limit(size)
    after = apply_pull(local, pulled)
    push = local.where("is_latest").join(waiting.select("id"), "id", "left_semi")
    return after, push, edits.join(push.select("id"), "id", "left_anti")
