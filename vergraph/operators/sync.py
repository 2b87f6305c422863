"""Applying change batches: an ordered fold per id, paging, acknowledgements.

Changes of one id depend on each other in arrival order, and last-writer-wins
with a tie window is not transitive, so it is no aggregate.  Spark deals stored versions and changes by id
and sorts them; a task runs through them and keeps the state of one id (its
current version and the versions seen), so neither an id's changes nor its log
are ever gathered.  Ids are independent: the fold is one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vergraph.functions.values import is_tombstoned, remote_wins, resolution_reason, version_micros
from vergraph.plans.graph import EdgeSource, cut, send_package

from .versions import as_change, changed_since, filtered, numbered

_LOG = "id string, pos int, outcome string, becomes_latest boolean, inserted boolean, version string, parents array<string>, resolved_version string, reason string"
_TEXTS = pa.list_(pa.string())
_LOG_ARROW = pa.schema([("id", pa.string()), ("pos", pa.int32()), ("outcome", pa.string()), ("becomes_latest", pa.bool_()), ("inserted", pa.bool_()), ("version", pa.string()), ("parents", _TEXTS), ("resolved_version", pa.string()), ("reason", pa.string())])


def fold_change(now: tuple, seen: Callable[[str], bool], change: str, version: str | None, parents: list[str] | None, remote_us: int | None, apply_us: int | None, deleted: bool) -> tuple[tuple, tuple]:
    """One change of an id whose current version is ``now`` (version, time,
    deleted) and whose versions ``seen`` knows.  Returns (outcome, becomes_latest,
    inserted, parents, resolved_version, reason), and what is current after it."""
    current, current_us, gone = now
    parents, is_delete = list(parents) if parents is not None else [], change == "delete"
    based = current is not None and current in parents
    resolved = reason = None
    if is_delete:
        outcome = "noop" if current is None or gone else "tombstone"
    elif current is None:
        outcome = "insert"
    elif current == version:
        outcome = "noop"
    elif based:
        outcome = "fast_forward"
    else:
        remote_us = current_us if remote_us is None else remote_us
        known = remote_us is not None and current_us is not None
        near = known and abs(remote_us - current_us) // 1000 < 1000
        wins = (version or "") > current if near else known and remote_us > current_us
        outcome, resolved = ("conflict_won", version) if wins else ("conflict_lost", current)
        side = "remote" if wins else "local"
        reason = f"timestamps within 1s, {side} has greater version" if near else f"{side} has newer timestamp"
    # a version that is stored already is not inserted again, even if it would win now
    inserted = outcome != "noop" and version is not None and not seen(version)
    latest = inserted and outcome != "conflict_lost"
    # blind changes, and deletes that do not know the incumbent, are hung under it
    if (reason is not None and not parents) or (is_delete and current is not None and not based):
        parents = [current]
    return (outcome, latest, inserted, parents, resolved, reason), (version, apply_us, is_delete or deleted) if latest else now


def _folder(schema: pa.Schema):
    """Over rows sorted by id, the stored versions of an id before its changes:
    one log row for each change.  Only the state of the id at hand is kept."""

    def run(batches):
        at, now, seen = object(), (None, None, False), set()
        for batch in batches:
            log = []
            for id_, kind, pos, apply_us, change, version, parents, remote_us, deleted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if id_ != at:
                    at, now, seen = id_, (None, None, False), set()
                if kind == 0:
                    seen.add(version)
                    if change == "latest":
                        now = (version, remote_us, deleted)
                    continue
                (outcome, latest, inserted, parents, resolved, reason), now = fold_change(now, seen.__contains__, change, version, parents, remote_us, apply_us, deleted)
                log.append((id_, pos, outcome, latest, inserted, version, parents, resolved, reason))
                if inserted:
                    seen.add(version)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*log, strict=True) if log else [[]] * len(schema), schema, strict=True)], schema=schema)

    return run


def apply_changes(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per change: id, pos, outcome, becomes_latest, inserted, version,
    parents, resolved_version, reason (SYN2 to SYN7, SYN9: every row is an
    acknowledgement).  ``stored``: id, version, is_latest, updated_us, content;
    ``changes``: pos (order of arrival), apply_us (server time), change_type
    (create, update, delete), id, version, content, parent_versions.  A change
    without a version is never inserted."""
    send_package(changes.sparkSession)
    gone = is_tombstoned(F.col("content")).alias("deleted")
    none = F.lit(None)
    held = stored.join(changes.select("id").distinct(), "id", "left_semi").select(
        "id", F.lit(0).alias("kind"), none.cast("int").alias("pos"), none.cast("long").alias("apply_us"), F.when(F.col("is_latest"), "latest").otherwise("held").alias("change_type"),
        "version", none.cast("array<string>").alias("parent_versions"), F.col("updated_us").cast("long").alias("remote_us"), gone,
    )
    own = changes.select("id", F.lit(1).alias("kind"), F.col("pos").cast("int").alias("pos"), F.col("apply_us").cast("long").alias("apply_us"), "change_type", "version", "parent_versions", version_micros(F.col("version")).alias("remote_us"), gone)
    rows = held.union(own)
    # not by id itself: both sides may be dealt by id already, and Spark then leaves
    # the shuffle out, though the union does not put their parts together
    return rows.repartition(F.xxhash64("id")).sortWithinPartitions(*rows.columns).mapInArrow(_folder(_LOG_ARROW), _LOG)


def stored_content() -> Column:
    """What a change stores as content: a delete adds deleted."""
    held = F.coalesce("content", F.lit("{}"))
    marked = F.regexp_replace(held, r"\}\s*$", F.when(held.rlike(r"^\s*\{\s*\}\s*$"), '"deleted":true}').otherwise(',"deleted":true}'))
    return F.when(F.col("change_type") == "delete", marked).otherwise(F.col("content"))


def inserted_rows(log: DataFrame, changes: DataFrame) -> DataFrame:
    """The version rows that a batch adds, in order of ``pos``; tombstones carry deleted."""
    body = changes.select("id", "pos", "change_type", "content", "apply_us")
    rows = log.where("inserted").join(body, ["id", "pos"])
    return rows.select("id", "version", "pos", stored_content().alias("content"), F.col("parents").alias("parent_versions"), "becomes_latest", F.col("apply_us").alias("updated_us"))


def apply_batch(stored: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store after a batch, and the log of outcomes.  Rows that lose stay as
    history; new rows get the next sequence numbers in order of arrival."""
    log = apply_changes(stored, changes)
    new = inserted_rows(log, changes)
    last = Window.partitionBy("id").orderBy(F.desc(F.when(F.col("becomes_latest"), F.col("pos"))))
    new = new.withColumn("is_latest", F.col("becomes_latest") & (F.row_number().over(last) == 1))
    new = cut(new)
    top = stored.agg(F.coalesce(F.max("server_seq"), F.lit(0)).alias("_top"))
    new = numbered(new, ["pos", "id", "version"], "server_seq", new.count()).crossJoin(top).withColumn("server_seq", (F.col("server_seq") + F.col("_top")).cast("long"))  # one row
    moved = new.where("is_latest").select("id", F.lit(True).alias("_moved"))
    kept = stored.join(moved, "id", "left").withColumn("is_latest", F.col("is_latest") & F.col("_moved").isNull()).drop("_moved")
    return kept.unionByName(new.drop("_top", "pos", "becomes_latest"), allowMissingColumns=True), log


def resolve_pairs(pairs: DataFrame) -> DataFrame:
    """Adds winner and reason to rows of local_us, local_version, remote_us, remote_version (SYN3)."""
    args = [F.col(c) for c in ("local_us", "local_version", "remote_us", "remote_version")]
    return pairs.withColumn("winner", F.when(remote_wins(*args), "remote").otherwise("local")).withColumn("reason", resolution_reason(*args))


def legacy_sync(stored: DataFrame, remote: DataFrame) -> DataFrame:
    """In-place rule of the older generic repository (SYN14): absent ids are
    created; a remote row that wins replaces all but id and created_us."""
    both = stored.select("id", "created_us", *[F.col(c).alias(f"l_{c}") for c in ("version", "updated_us", "content")]).join(remote.select("id", F.col("created_us").alias("r_created_us"), *[F.col(c).alias(f"r_{c}") for c in ("version", "updated_us", "content")]), "id", "full")
    wins = F.col("r_updated_us").isNotNull() & (F.col("l_updated_us").isNull() | remote_wins(F.col("l_updated_us"), F.col("l_version"), F.col("r_updated_us"), F.col("r_version")))
    picked = [F.when(wins, F.col(f"r_{c}")).otherwise(F.col(f"l_{c}")).alias(c) for c in ("version", "updated_us", "content")]
    return both.select("id", F.coalesce("created_us", "r_created_us").alias("created_us"), *picked)


def pull_page(rows: DataFrame, cursor: int | None = None, since: Column | None = None, size: int = 500, full: bool = False, entity_types: list[str] | None = None, modified_by: list[str] | None = None) -> DataFrame:
    """The next page of current rows in sequence order; a full pull ignores the
    cursor; filters come before paging (SYN10, SYN11, SYN12)."""
    now = rows.where("is_latest")
    now = now if full else changed_since(now, cursor, since)
    first = filtered(now, entity_types, modified_by).orderBy("server_seq").limit(size)
    keys = first.select("id", "version", "server_seq")
    return as_change(first).join(keys, ["id", "version"])


def next_cursor(rows: DataFrame, cursor: int | None, size: int = 500) -> DataFrame:
    """next_cursor, has_more: the largest sequence number of the page, null after the last one."""
    more = changed_since(rows.where("is_latest"), cursor).select("server_seq").orderBy("server_seq").limit(size + 1)
    ranked = more.agg(F.array_sort(F.collect_list("server_seq")).alias("s"))  # size + 1 at most
    has_more = F.size("s") > size
    return ranked.select(F.when(has_more, F.element_at("s", size)).alias("next_cursor"), has_more.alias("has_more"))


def acknowledgements(log: DataFrame) -> DataFrame:
    """Distinct ids of a batch in order of their first change (SYN9, AGG12)."""
    return log.groupBy("id").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_changes"), F.count_if(F.col("reason").isNotNull()).alias("n_conflicts"))


def edge_changes(stored_entities: DataFrame, stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored edges after a batch, and which incoming edges were taken: those
    whose endpoints exist at exactly the pinned versions (SYN8)."""
    from vergraph.schema import RELATIONSHIP_TYPES

    from .relations import existing, upsert_edges

    known = incoming.where(F.col("relationship_type").isin(*RELATIONSHIP_TYPES))
    taken = existing(known, stored_entities, exact=True)
    return upsert_edges(stored, taken), taken


def rewritten_edges(stored_entities: DataFrame, stored: EdgeSource, patch: dict[str, Column]) -> DataFrame:
    """``edge_changes`` for a batch that names every stored edge once, with the columns
    of ``patch`` made from its own row: the stored edges after it.  Ends are looked up
    before edges are made, and an edge meets its new form in its own row; only those
    that the batch hangs elsewhere are joined by id."""
    from vergraph.schema import RELATIONSHIP_TYPES

    from .relations import existing, upsert_edges

    ends = stored_entities.select("id", "version").distinct().withColumn("known", F.lit(True))
    rows = stored.joined({"from": ends, "to": ends}, "left")
    columns = [c for c in rows.columns if c not in ("from_known", "to_known")]
    stays = F.lit(True)
    for c in ("id", "from_entity_id", "from_entity_version", "to_entity_id", "to_entity_version"):
        stays = stays & F.col(c).eqNullSafe(patch[c]) if c in patch else stays
    allowed = patch.get("relationship_type", F.col("relationship_type")).isin(*RELATIONSHIP_TYPES)
    taken = allowed & F.col("from_known").isNotNull() & F.col("to_known").isNotNull()
    here = rows.where(stays).select(*[F.when(taken, patch[c]).otherwise(F.col(c)).alias(c) if c in patch else F.col(c) for c in columns])
    old = rows.where(~stays).select(*columns)
    new = old.where(allowed).select(*[patch[c].alias(c) if c in patch else F.col(c) for c in columns]).withColumn("pos", F.lit(0))
    return here.unionByName(upsert_edges(old, existing(new, stored_entities, exact=True)).select(*columns))
