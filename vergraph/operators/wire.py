"""What leaves and enters the system: payloads of entities, edges, blobs and syncs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vergraph.functions.text import content_preview

PUSH_RESULT = "changes array<struct<entity:struct<id:string>>>, conflicts array<struct<entity_id:string, resolution_strategy:string, local_version:string, remote_version:string>>"


def entity_payload(rows: DataFrame) -> DataFrame:
    """Entities with the defaults of missing fields (PRJ8)."""
    empty = F.array().cast("array<string>")
    return rows.select(
        F.coalesce("id", F.lit("")).alias("id"), F.coalesce("version", F.lit("")).alias("version"), "entity_type", F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("content", F.lit("{}")).alias("content"), F.coalesce(F.nullif("user_id", F.lit("")), F.lit("unknown")).alias("user_id"), F.coalesce("parent_versions", empty).alias("parent_versions"),
    )


def blob_payload(blobs: DataFrame, include_data: bool = False) -> DataFrame:
    """Blob fields; the data as base64 only if asked for and not empty (PRJ3)."""
    fields = [c for c in blobs.columns if c != "data"]
    encoded = F.when(F.octet_length("data") > 0, F.regexp_replace(F.base64("data"), r"\s", ""))
    return blobs.select(*fields, *([encoded.alias("data")] if include_data else []))


def search_payload(hits: DataFrame, score: Column | str = "score") -> DataFrame:
    """id, name, entity_type, score, preview of search hits (PRJ6)."""
    return hits.select("id", "name", "entity_type", F.col(score).alias("score") if isinstance(score, str) else score.alias("score"), content_preview(F.col("content")).alias("preview"))


def pushed(responses: DataFrame, body: str = "body") -> DataFrame:
    """id, conflict from JSON answers to a push: ids applied (null conflict), and
    ids in conflict with the strategy that settled them (CLI6)."""
    parsed = responses.select(F.from_json(body, PUSH_RESULT).alias("r"))
    applied = parsed.select(F.explode("r.changes.entity").alias("e")).where("e is not null").select("e.id", F.lit(None).cast("string").alias("conflict"))
    lost = parsed.select(F.explode("r.conflicts").alias("c")).select(F.coalesce("c.entity_id", F.lit("")).alias("id"), F.coalesce("c.resolution_strategy", F.lit("conflict")).alias("conflict"))
    return applied.union(lost)


def sync_status(counters: DataFrame) -> DataFrame:
    """Counters of ``stats.sync_counters`` with flags, and the moment of the next
    try: from the last success, cut to its minute, after the wait that the
    failures call for; null without failures (PRJ7, SYN17, DAT2)."""
    from vergraph.functions.values import backoff_seconds

    minute = F.floor(F.coalesce("last_success_us", F.lit(0)) / 60_000_000).cast("long") * 60_000_000
    return counters.withColumn("healthy", F.col("sync_failures") == 0).withColumn("next_retry_us", F.when(F.col("sync_failures") > 0, minute + backoff_seconds(F.col("sync_failures").cast("int")) * 1_000_000))
