"""Relevance-ranked search: three scorers and their candidate filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vergraph.functions.text import content_text, leaves, match_ratio, python_tokens, tokens
from vergraph.plans.graph import Graph, cut, small
from vergraph.schema import ENTITY_TYPES


def top(scored: DataFrame, limit: int, least: float | None = None) -> DataFrame:
    """Best rows, ties by id (SCH2, SRT1)."""
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), "id").limit(limit)


def _contains(text: Column, piece: str) -> Column:
    return F.contains(text, F.lit(piece))


def score_shared(rows: DataFrame, query: str, fuzzy: bool = True) -> DataFrame:
    """Scorer A (SCH1): adds score, and highlights of name and content.  Words
    count as often as the query has them; an equal name doubles what was scored
    before; near names (difflib) add their ratio."""
    q, parts = query.lower(), query.lower().split()
    name = F.lower("name")
    rows = rows.withColumn("_text", content_text("content")).withColumn("_fields", F.from_json("content", "map<string,variant>"))
    in_name = sum((_contains(name, w).cast("int") for w in parts), F.lit(0))
    in_text = sum((_contains(F.col("_text"), w).cast("int") for w in parts), F.lit(0))
    strings = F.filter(F.map_entries("_fields"), lambda e: F.schema_of_variant(e["value"]) == "STRING")
    fields = F.filter(F.transform(strings, lambda e: F.struct(e["key"].alias("key"), e["value"].cast("string").alias("value"))), lambda e: _contains(F.lower(e["value"]), q))
    some = (F.col("_text") != "") & (F.col("_text") != "{}")
    by_name = F.when(_contains(name, q), 3.0).otherwise(1.5 * in_name)
    by_text = F.when(~some, 0.0).otherwise(F.when(_contains(F.col("_text"), q), 2.0).otherwise(0.5 * in_text) + F.size(fields))
    score = (by_name + by_text) * F.when(name == q, 2.0).otherwise(1.0)
    if fuzzy:
        near = match_ratio(name, F.lit(q))
        score = score + F.when(near > 0.8, near).otherwise(0.0)
    shown = F.when(_contains(F.col("_text"), q), F.array(F.lit(f"Content contains '{query}'"))).when(in_text > 0, F.array(F.concat(F.lit("Content matches "), in_text.cast("string"), F.lit(" word(s)")))).otherwise(F.array().cast("array<string>"))
    shown = F.concat(shown, F.transform(fields, lambda e: F.concat(e["key"], F.lit(": "), F.substring(e["value"], 1, 50), F.lit("..."))))
    return rows.withColumn("score", score).withColumn("name_highlight", F.when(by_name > 0, F.array("name")).otherwise(F.array().cast("array<string>"))).withColumn("content_highlight", F.when(some, shown).otherwise(F.array().cast("array<string>"))).drop("_text", "_fields")


def search_shared(rows: DataFrame, query: str, limit: int = 10, fuzzy: bool = True) -> DataFrame:
    return top(score_shared(rows, query, fuzzy).where("score > 0"), limit)


def score_engine(rows: DataFrame, query: str) -> DataFrame:
    """Scorer B (SCH3, SCH4): adds score, highlights, matched_fields."""
    q, own = query.lower(), python_tokens(query)
    n = max(1, len(own))
    wanted = F.array(*[F.lit(t) for t in own]).cast("array<string>")
    overlap = lambda text: F.size(F.array_intersect(tokens(text), wanted))
    rows = rows if "_leaves" in rows.columns else rows.withColumn("_leaves", leaves("content"))
    name = F.when(_contains(F.lower("name"), q), 3.0).otherwise(2.0 * overlap(F.col("name")) / n)
    of_type = F.exists(wanted, lambda t: F.contains(F.col("entity_type"), t)) if own else F.lit(False)
    leaf = lambda e: F.when(_contains(F.lower(e["value"]), q), 1.5).otherwise(overlap(e["value"]) / n)
    hits = F.filter(F.transform("_leaves", lambda e: F.struct(leaf(e).alias("s"), e["path"].alias("path"), e["value"].alias("value"))), lambda h: h["s"] > 0)
    content = F.aggregate(hits, F.lit(0.0), lambda a, h: a + h["s"])
    empty = F.array().cast("array<string>")
    shown = F.concat(F.when(name > 0, F.array(F.concat(F.lit("Name: "), "name"))).otherwise(empty), F.transform(hits, lambda h: F.concat(h["path"], F.lit(": "), F.substring(h["value"], 1, 100), F.lit("..."))))
    matched = F.concat(F.when(name > 0, F.array(F.lit("name"))).otherwise(empty), F.when(of_type, F.array(F.lit("entity_type"))).otherwise(empty), F.when(content > 0, F.array(F.lit("content"))).otherwise(empty))
    return rows.withColumn("score", name + of_type.cast("double") + content).withColumn("highlights", shown).withColumn("matched_fields", matched).drop("_leaves")


def search_engine(rows: DataFrame, query: str, entity_types: list[str] | None = None, limit: int = 10, min_score: float = 0.1) -> DataFrame:
    """Full-text search (SCH5); a blank query finds nothing."""
    if not query.strip():
        return score_engine(rows, query).limit(0)
    if entity_types:
        rows = rows.where(F.col("entity_type").isin(*entity_types))
    return top(score_engine(rows, query), limit, min_score)


def search_rest(rows: DataFrame, query: str, entity_types: list[str] | None = None, limit: int = 10) -> DataFrame:
    """The same as asked over the wire, where no more than 100 come back (SCH13)."""
    return search_engine(rows, query, entity_types, min(limit, 100))


def property_matches(rows: DataFrame, wanted: dict[str, str]) -> Column:
    """1 for an equal value, a half for a contained string (FLT15)."""
    total = F.lit(0.0)
    for key, value in wanted.items():
        own = F.get_json_object("content", f"$.{key}")
        total = total + F.when(own == str(value), 1.0).when(F.contains(F.lower(own), F.lit(str(value).lower())) if isinstance(value, str) else F.lit(False), 0.5).otherwise(0.0)
    return total


def search_properties(rows: DataFrame, wanted: dict[str, str], entity_types: list[str] | None = None, limit: int = 10) -> DataFrame:
    """Share of the wanted properties that match (SCH6)."""
    if entity_types:
        rows = rows.where(F.col("entity_type").isin(*entity_types))
    matches = property_matches(rows, wanted)
    return top(rows.withColumn("score", matches / len(wanted)).where("score > 0"), limit)


def search_connected(graph: Graph, query: str, start: str, max_distance: int = 2, limit: int = 10) -> DataFrame:
    """Scorer B in a neighbourhood, nearer rows weighing more (SCH7)."""
    from .traverse import connected

    near = cut(connected(graph, start, None, "both", max_distance).groupBy("id").agg(F.min("distance").alias("distance")))
    scored = score_engine(graph.latest().join(small(near, near.count()), "id"), query).where("score > 0")
    return top(scored.withColumn("score", F.col("score") * (1 + 1 / (F.col("distance") + 1))), limit)


def search_names(rows: DataFrame, query: str, entity_types: list[str] | None = None, limit: int = 10) -> DataFrame:
    """Newest versions whose name matches (SCH8): three times the limit is taken,
    the first of each id stays, then the limit; so an older version may show."""
    found = rows.where(F.col("name").ilike(f"%{query}%"))
    if entity_types:
        found = found.where(F.col("entity_type").isin(*entity_types))
    newest = found.orderBy(F.desc("created_at"), "id", "version").limit(3 * limit)
    first = newest.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("created_at"), "version"))).where("_n = 1").drop("_n")
    return first.orderBy(F.desc("created_at"), "id").limit(limit)


def search_names_ranked(rows: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Candidates by name, ranked by scorer A (SCH9)."""
    return search_shared(search_names(rows, query, None, limit), query, limit)


def search_replica(rows: DataFrame, query: str, entity_types: list[str] | None = None) -> DataFrame:
    """Replica's filter (SCH10): ``*`` is everything; else name or content text contains the query."""
    if entity_types:
        rows = rows.where(F.col("entity_type").isin(*[t for t in entity_types if t in ENTITY_TYPES]))
    if query == "*":
        return rows
    q = query.lower()
    return rows.where(_contains(F.lower("name"), q) | _contains(F.col("_text") if "_text" in rows.columns else content_text("content"), q))


def score_replica(rows: DataFrame, query: str, partial: float = 1.5, other: float = 1.0) -> DataFrame:
    """Scorer C (SCH11: 2, 1.5, 1) and its variant (SCH12: 2, 1, 0.5)."""
    q = query.lower()
    return rows.withColumn("score", F.when(F.lower("name") == q, 2.0).when(_contains(F.lower("name"), q), partial).otherwise(other))


def search_replica_ranked(rows: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The limit comes before the ranking here (SCH11)."""
    first = search_replica(rows, query).orderBy("id").limit(limit)
    return score_replica(first, query).orderBy(F.desc("score"), "id")
