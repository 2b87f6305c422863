"""Similarity of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vergraph.functions.text import leaves, match_ratio, tokens, words

from .search import score_shared, top


def _reference(rows: DataFrame, id_: str, *columns: str) -> DataFrame:
    """The reference row, its columns prefixed with ``ref_`` (one row)."""
    return rows.where(F.col("id") == id_).limit(1).select(*[F.col(c).alias(f"ref_{c}") for c in columns])


def similar_shared(rows: DataFrame, id_: str, limit: int = 5) -> DataFrame:
    """Same type 0.2, name ratio 0.3, shared keys 0.3, equal values 0.2; over 0.1 (SIM1)."""
    kind = "map<string,variant>"
    prepared = rows.withColumn("m", F.from_json("content", kind))
    ref = _reference(prepared, id_, "entity_type", "name", "m")
    pairs = prepared.where(F.col("id") != id_).crossJoin(F.broadcast(ref)).where(F.col("entity_type") == F.col("ref_entity_type"))  # one row
    a, b = F.map_keys("ref_m"), F.map_keys("m")
    common, union = F.array_intersect(a, b), F.array_union(a, b)
    text = lambda m, k: F.to_json(F.element_at(m, k))
    equal = F.size(F.filter(common, lambda k: text(F.col("m"), k) == text(F.col("ref_m"), k)))
    both = (F.size("m") > 0) & (F.size("ref_m") > 0)
    content = F.when(both, 0.3 * F.size(common) / F.greatest(F.size(union), F.lit(1)) + F.when(F.size(common) > 0, 0.2 * equal / F.size(common)).otherwise(0.0)).otherwise(0.0)
    score = 0.2 + 0.3 * match_ratio(F.lower("ref_name"), F.lower("name")) + content
    return top(pairs.withColumn("score", score).where("score > 0.1").drop("m", "ref_m", "ref_name", "ref_entity_type"), limit)


def entity_tokens(rows: DataFrame) -> DataFrame:
    """Adds token_set: of the name, of all content strings, and the type."""
    found = rows.withColumn("_l", leaves("content"))
    of_leaves = F.flatten(F.transform("_l", lambda e: tokens(e["value"])))
    return found.withColumn("token_set", F.array_distinct(F.concat(tokens(F.col("name")), F.array("entity_type"), of_leaves))).drop("_l")


def similar_engine(rows: DataFrame, id_: str, threshold: float = 0.7, limit: int = 10) -> DataFrame:
    """Same type 0.3, token Jaccard 0.7; all types are candidates (SIM2)."""
    prepared = entity_tokens(rows)
    ref = _reference(prepared, id_, "entity_type", "token_set")
    pairs = prepared.where(F.col("id") != id_).crossJoin(F.broadcast(ref))  # one row
    jaccard = F.size(F.array_intersect("token_set", "ref_token_set")) / F.greatest(F.size(F.array_union("token_set", "ref_token_set")), F.lit(1))
    score = F.when(F.col("entity_type") == F.col("ref_entity_type"), 0.3).otherwise(0.0) + jaccard * 0.7
    return top(pairs.withColumn("score", score).drop("ref_entity_type", "ref_token_set", "token_set"), limit, threshold)


def similar_by_name_score(rows: DataFrame, id_: str, name: str, limit: int = 5) -> DataFrame:
    """Of the first ``limit`` rows of the same type, those ranked by scorer A on the reference's name (SIM3)."""
    first = rows.where(F.col("id") != id_).orderBy("id").limit(limit)
    return top(score_shared(first, name).where("score > 0"), limit)


def similar_replica(rows: DataFrame, id_: str, limit: int = 5) -> DataFrame:
    """0.5 and the share of common name words, same type (SIM4)."""
    prepared = rows.withColumn("w", F.array_distinct(words(F.col("name"))))
    ref = _reference(prepared, id_, "entity_type", "w")
    pairs = prepared.where(F.col("id") != id_).crossJoin(F.broadcast(ref)).where(F.col("entity_type") == F.col("ref_entity_type"))  # one row
    share = F.size(F.array_intersect("w", "ref_w")) / F.greatest(F.size("w"), F.size("ref_w"), F.lit(1))
    return top(pairs.withColumn("score", 0.5 + share).drop("w", "ref_w", "ref_entity_type"), limit)
