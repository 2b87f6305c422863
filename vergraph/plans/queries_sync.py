"""Queries on sync, the replica, migration, documents and time windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vergraph.functions.values import backoff_seconds, difference_ms, micros
from vergraph.operators import migrate, relations, replica, sync, versions as ver, windows
from vergraph.sources import snapshots, star
from vergraph.streaming.attempts import limited_stream
from vergraph.streaming.changes import Store, keyed_state, sync_stream

from .oracle import sql

QUERIES: dict = {}


def add(name, query, text=None):
    QUERIES[name] = (query, text)


def flagged(s, d):
    return ver.with_latest_flag(star.versions(s, d), F.col("server_seq"))


def pairs(s, d):
    """Consecutive events of a user as (local, remote)."""
    w = Window.partitionBy("id").orderBy("server_seq")
    rows = star.versions(s, d).select("id", "version", "server_seq", micros("created_at").alias("us"))
    rows = rows.select("id", F.lag("version").over(w).alias("local_version"), F.lag("us").over(w).alias("local_us"), F.col("version").alias("remote_version"), F.col("us").alias("remote_us"))
    return rows.where("local_us is not null")


PAIRS = "p AS (SELECT id, lag(version) OVER w AS local_version, lag(us) OVER w AS local_us, version AS remote_version, us AS remote_us FROM vers WINDOW w AS (PARTITION BY id ORDER BY server_seq)), q AS (SELECT *, CAST(trunc((remote_us - local_us) / 1000) AS BIGINT) AS ms FROM p WHERE local_us IS NOT NULL)"
WINS = "CASE WHEN abs(ms) < 1000 THEN remote_version > local_version ELSE remote_us > local_us END"
add("syn3_resolve", lambda s, d: sync.resolve_pairs(pairs(s, d)).select("remote_version", "winner", "reason", difference_ms(F.col("local_us"), F.col("remote_us")).alias("ms")), sql(f"SELECT remote_version, CASE WHEN {WINS} THEN 'remote' ELSE 'local' END AS winner, CASE WHEN abs(ms) < 1000 THEN 'timestamps within 1s, ' || CASE WHEN {WINS} THEN 'remote' ELSE 'local' END || ' has greater version' ELSE CASE WHEN {WINS} THEN 'remote' ELSE 'local' END || ' has newer timestamp' END AS reason, ms FROM q", "vers", recursive=PAIRS))
# the same pairs turned round, moved to within two seconds of each other
add("syn3_resolve_close", lambda s, d: sync.resolve_pairs(pairs(s, d).withColumn("remote_us", F.col("local_us") + F.col("remote_us") % 4_000_000 - 2_000_000)).groupBy("winner", "reason").agg(F.count("*").alias("n")), sql(f"SELECT CASE WHEN {WINS} THEN 'remote' ELSE 'local' END AS winner, CASE WHEN abs(ms) < 1000 THEN 'timestamps within 1s, ' || CASE WHEN {WINS} THEN 'remote' ELSE 'local' END || ' has greater version' ELSE CASE WHEN {WINS} THEN 'remote' ELSE 'local' END || ' has newer timestamp' END AS reason, count(*) AS n FROM r GROUP BY 1, 2", "vers", recursive=PAIRS + ", r AS (SELECT local_version, remote_version, local_us, local_us + remote_us % 4000000 - 2000000 AS remote_us, CAST(trunc((remote_us % 4000000 - 2000000) / 1000) AS BIGINT) AS ms FROM q)"))


def _store(s, d):
    """The first event of every user, as stored rows."""
    w = Window.partitionBy("id").orderBy("server_seq")  # one row, also of repeated ones
    return star.versions(s, d).withColumn("n", F.row_number().over(w)).where("n = 1").select("id", "version", F.lit(True).alias("is_latest"), micros("created_at").alias("updated_us"), "content", "server_seq")


def _changes(s, d, chained: bool):
    """All later events as changes: each based on the one before, or blind."""
    w = Window.partitionBy("id").orderBy("server_seq")
    v = star.versions(s, d).withColumn("before", F.lag("version").over(w)).where("before is not null")
    parents = F.array("before") if chained else F.array().cast("array<string>")
    kind = F.when(F.col("user_id") == "error", "delete").otherwise("update")
    return v.select(F.col("server_seq").cast("int").alias("pos"), micros("created_at").alias("apply_us"), kind.alias("change_type"), "id", "version", "content", parents.alias("parent_versions"))


RANKED = "k AS (SELECT *, lag(deleted) OVER (PARTITION BY id ORDER BY server_seq) AS before, row_number() OVER (PARTITION BY id ORDER BY server_seq) AS n FROM vers)"
CHAIN = """CASE WHEN n = 1 THEN NULL WHEN deleted AND before THEN 'noop' WHEN deleted THEN 'tombstone' ELSE 'fast_forward' END"""
add("syn7_tombstones", lambda s, d: sync.apply_changes(_store(s, d), _changes(s, d, True).where("change_type = 'delete'")).groupBy("id").agg(F.count_if(F.col("outcome") == "tombstone").alias("tombstones"), F.count_if(F.col("outcome") == "noop").alias("noops")), sql("SELECT id, CASE WHEN bool_or(deleted AND n = 1) THEN 0 ELSE 1 END AS tombstones, count(*) FILTER (WHERE deleted AND n > 1) - CASE WHEN bool_or(deleted AND n = 1) THEN 0 ELSE 1 END AS noops FROM k GROUP BY id HAVING count(*) FILTER (WHERE deleted AND n > 1) > 0", "vers", recursive=RANKED))


def _single(s, d):
    """One blind change for each user against the stored first version."""
    w = Window.partitionBy("id").orderBy(F.desc("pos"))  # one row, also of repeated ones
    return _changes(s, d, False).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n").withColumn("change_type", F.lit("update"))


add("syn4_blind_update", lambda s, d: sync.apply_changes(_store(s, d), _single(s, d)).select("id", "outcome", "version", F.array_join("parents", ",").alias("parents"), "resolved_version"), sql("SELECT l.id, CASE WHEN CASE WHEN abs(l.us - f.us) < 1000000 THEN l.version > f.version ELSE l.us > f.us END THEN 'conflict_won' ELSE 'conflict_lost' END AS outcome, l.version, f.version AS parents, CASE WHEN CASE WHEN abs(l.us - f.us) < 1000000 THEN l.version > f.version ELSE l.us > f.us END THEN l.version ELSE f.version END AS resolved_version FROM k f JOIN cur l ON l.id = f.id AND l.server_seq <> f.server_seq WHERE f.n = 1", "cur", recursive=RANKED))
add("syn5_apply_batch", lambda s, d: sync.apply_batch(_store(s, d), _single(s, d))[0].groupBy("id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("is_latest")).alias("n_latest"), F.max_by("version", F.when(F.col("is_latest"), F.col("server_seq"))).alias("latest")), sql("SELECT f.id, CASE WHEN l.server_seq = f.server_seq THEN 1 ELSE 2 END AS n_rows, 1 AS n_latest, l.version AS latest FROM k f JOIN cur l ON l.id = f.id WHERE f.n = 1", "cur", recursive=RANKED))
#: The fold in SQL, one change of every user after another: k has the changes in order, ``based`` is whether one names what is current.
FOLD = """RECURSIVE_K, c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY server_seq) AS m FROM CHANGES),
f AS (SELECT id, 1 AS m, version AS now, us AS now_us, deleted AS gone, CAST(NULL AS VARCHAR) AS outcome, server_seq AS pos FROM k WHERE n = 1
UNION ALL SELECT id, m, CASE WHEN latest THEN version ELSE now END, CASE WHEN latest THEN us ELSE now_us END, CASE WHEN latest THEN deleted ELSE gone END, outcome, pos FROM (
SELECT *, outcome NOT IN ('noop', 'conflict_lost') AS latest FROM (SELECT f.id, f.m + 1 AS m, now, now_us, gone, c.version, c.us, c.deleted, c.server_seq AS pos,
CASE WHEN c.deleted THEN CASE WHEN gone THEN 'noop' ELSE 'tombstone' END WHEN c.parent = now THEN 'fast_forward' WHEN CASE WHEN abs(c.us - now_us) < 1000000 THEN c.version > now ELSE c.us > now_us END THEN 'conflict_won' ELSE 'conflict_lost' END AS outcome
FROM f JOIN c ON c.id = f.id AND c.m = f.m)))"""


def fold_sql(changes, select):
    """``changes``: rows of k with a parent, all after what is stored."""
    return sql(select, "vers", recursive=FOLD.replace("RECURSIVE_K", RANKED).replace("CHANGES", changes))


FOLDED = "SELECT outcome, count(*) AS n FROM f WHERE outcome IS NOT NULL GROUP BY outcome"
BLIND = "(SELECT *, CAST(NULL AS VARCHAR) AS parent FROM k WHERE n > 1)"
add("syn2_fast_forward", lambda s, d: sync.apply_changes(_store(s, d), _changes(s, d, True).where("change_type = 'update'").withColumn("parent_versions", F.array(F.lag("version").over(Window.partitionBy("id").orderBy("pos")))).where("parent_versions[0] is not null")).groupBy("outcome").agg(F.count("*").alias("n"), F.count_if(F.col("becomes_latest")).alias("n_latest")), fold_sql("(SELECT * FROM (SELECT *, lag(version) OVER (PARTITION BY id ORDER BY server_seq) AS parent FROM k WHERE n > 1 AND NOT deleted) WHERE parent IS NOT NULL)", "SELECT outcome, count(*) AS n, count(*) FILTER (WHERE outcome NOT IN ('noop', 'conflict_lost')) AS n_latest FROM f WHERE outcome IS NOT NULL GROUP BY outcome"))
add("syn2_full_fold", lambda s, d: sync.apply_changes(_store(s, d), _changes(s, d, False)).groupBy("outcome").agg(F.count("*").alias("n")), fold_sql(BLIND, FOLDED))
add("syn9_acknowledgements", lambda s, d: sync.acknowledgements(sync.apply_changes(_store(s, d), _changes(s, d, True))).select("id", "first_pos", "n_changes"), sql("SELECT id, CAST(min(server_seq) FILTER (WHERE n > 1) AS INT) AS first_pos, count(*) FILTER (WHERE n > 1) AS n_changes FROM k GROUP BY id HAVING count(*) > 1", "vers", recursive=RANKED))


def _edges(s, d, rename):
    e = star.relationships(s, d).where("relationship_type = 'part_of'")
    return e.withColumn("properties", F.lit(rename)) if rename else e


def _edge_batch():
    """Every edge once more, one of them to a place that is not there."""
    bad = (F.col("from_entity_id") == "nation-3") & (F.col("relationship_type") == "part_of")
    return {"properties": F.lit("x"), "to_entity_id": F.when(bad, F.lit("region-99")).otherwise(F.col("to_entity_id"))}


add("syn8_edge_upsert", lambda s, d: sync.rewritten_edges(star.entities(s, d), star.KeyedEdges(s, d), _edge_batch()).select("id", "properties"), sql("SELECT relationship_type || '|' || src || '|' || dst AS id, CASE WHEN src = 'nation-3' AND relationship_type = 'part_of' THEN '{}' ELSE 'x' END AS properties FROM rels", "rels"))
add("syn10_pull_page", lambda s, d: sync.pull_page(flagged(s, d), 5000, size=50).select("id", "version", "change_type", "server_seq"), sql("SELECT id, version, CASE WHEN deleted THEN 'delete' ELSE 'update' END AS change_type, server_seq FROM cur WHERE server_seq > 5000 ORDER BY server_seq LIMIT 50", "cur"))
add("syn10_pull_filtered", lambda s, d: sync.pull_page(flagged(s, d), 0, size=20, modified_by=["click", "error"]).select("id", "change_type"), sql("SELECT id, CASE WHEN deleted THEN 'delete' ELSE 'update' END AS change_type FROM cur WHERE user_id IN ('click', 'error') ORDER BY server_seq LIMIT 20", "cur"))
add("syn10_next_cursor", lambda s, d: sync.next_cursor(flagged(s, d), 0, 100), sql("SELECT CASE WHEN count(*) > 100 THEN max(server_seq) FILTER (WHERE r <= 100) END AS next_cursor, count(*) > 100 AS has_more FROM (SELECT server_seq, row_number() OVER (ORDER BY server_seq) AS r FROM cur WHERE server_seq > 0)", "cur"))


def _legacy(s, d):
    rows = _store(s, d).select("id", "version", "updated_us", "content", F.col("updated_us").alias("created_us"))
    new = flagged(s, d).where("is_latest").select("id", "version", micros("created_at").alias("updated_us"), "content", F.lit(0).cast("long").alias("created_us"))
    return sync.legacy_sync(rows, new).select("id", "version", "created_us")


add("syn14_legacy_sync", _legacy, sql("SELECT f.id, l.version, f.us AS created_us FROM k f JOIN cur l ON l.id = f.id WHERE f.n = 1", "cur", recursive=RANKED))
add("syn18_backoff", lambda s, d: star.table(s, d, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") % 9).alias("failures")).select("user_id", "failures", backoff_seconds(F.col("failures")).alias("seconds")), "SELECT user_id, failures, CAST(30 * pow(2, least(failures, 6)) AS BIGINT) AS seconds FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') % 9 AS failures FROM events GROUP BY 1)")

# replica
EDITS = "(SELECT 'user-' || user_id AS id, CASE WHEN event_type = 'click' THEN 'create' ELSE 'update' END AS operation, epoch_us(ts) AS at_us FROM events)"


def edits(s, d):
    return star.versions(s, d).select("id", F.when(F.col("user_id") == "click", "create").otherwise("update").alias("operation"), micros("created_at").alias("at_us"))


def acked(s, d):
    return flagged(s, d).where("is_latest and user_id = 'click'").select("id")


PENDING = sql(f"SELECT id, arg_min(operation, at_us) AS operation, min(at_us) AS entry_us FROM {EDITS} WHERE id NOT IN (SELECT id FROM cur WHERE user_id = 'click') GROUP BY id", "cur")
add("cli3_pending", lambda s, d: replica.pending_state(edits(s, d), acked(s, d)), PENDING)
add("cli2_push_payload", lambda s, d: replica.payload_sizes(replica.pending_state(star.entities(s, d).select("id", F.lit("update").alias("operation"), F.lit(1).alias("at_us"))), star.entities(s, d), star.relationships(s, d)).select("id", "operation", "n_edges"), sql("SELECT e.id, 'update' AS operation, count(r.src) AS n_edges FROM entities e LEFT JOIN rels r ON r.src = e.id GROUP BY e.id", "entities", "rels"))
add("cli4_apply_pull", lambda s, d: replica.apply_pull(flagged(s, d).where("server_seq <= 600"), flagged(s, d).where("server_seq > 400")).where("is_latest").select("id", "version"), sql("SELECT id, version FROM cur", "cur"))
add("cli5_pulled_times", lambda s, d: replica.pulled_times(flagged(s, d).where("is_latest").select("id", "version").union(s.createDataFrame([("x", "no-time")], "id string, version string")), 5).select("id", "updated_us"), sql("SELECT id, us AS updated_us FROM cur UNION ALL SELECT 'x', 5", "cur"))
TRACK = "(SELECT 'user-' || user_id AS id, epoch_us(ts) AS at_us, CASE event_type WHEN 'error' THEN 'conflict' WHEN 'click' THEN 'synced' ELSE 'pending' END AS status FROM events)"
add("cli9_tracking", lambda s, d: replica.tracking_state(star.versions(s, d).select("id", micros("created_at").alias("at_us"), F.when(F.col("user_id") == "error", "conflict").when(F.col("user_id") == "click", "synced").otherwise("pending").alias("status"), F.col("user_id").alias("reason"))).select("id", "sync_status", "retry_count"), f"SELECT t.id, arg_max(status, at_us) AS sync_status, count(*) FILTER (WHERE status = 'conflict' AND at_us > coalesce(good, -1)) AS retry_count FROM {TRACK} t LEFT JOIN (SELECT id, max(at_us) AS good FROM {TRACK} WHERE status = 'synced' GROUP BY id) g ON g.id = t.id GROUP BY t.id")
add("cli10_type_index", lambda s, d: replica.type_index(star.entities(s, d)), sql("SELECT entity_type, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM entities GROUP BY 1", "entities"))
add("snk5_keep_last", lambda s, d: replica.keep_last(star.versions(s, d), ["id", "user_id"], "server_seq").select("id", "version"), sql("SELECT id, version FROM vers QUALIFY row_number() OVER (PARTITION BY id, user_id ORDER BY server_seq DESC) = 1", "vers"))
add("snk7_replace_edges", lambda s, d: relations.replaced_counts(star.KeyedEdges(s, d), star.entities(s, d).where("entity_type = 'zone'").select("id"), _edges(s, d, None), ["relationship_type"]), sql("SELECT relationship_type, count(*) AS n FROM rels WHERE relationship_type = 'part_of' OR (src NOT LIKE 'nation-%' AND dst NOT LIKE 'nation-%') GROUP BY 1", "rels"))

# migration, blobs, documents
add("mig1_repair", lambda s, d: migrate.repair_versions(star.versions(s, d).withColumn("version", F.replace("version", F.lit("+00:00"), F.lit("+00:00Z"))), star.relationships(s, d))[0].select("id", "version"), sql("SELECT id, version FROM vers", "vers"))
add("mig2_inline_blobs", lambda s, d: migrate.extract_blobs(star.table(s, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("id"), F.lit("n").alias("name"), F.lit("u").alias("user_id"), F.concat(F.lit('{"mime_type":"image/png","data_b64":"'), F.regexp_replace(F.base64(F.coalesce("text", F.lit("")).cast("binary")), r"\s", ""), F.lit('"}')).alias("content")))[1].select("size", "checksum", "blob_type"), "SELECT octet_length(encode(text)) AS size, sha256(text) AS checksum, 'png' AS blob_type FROM documents WHERE text <> ''")
MIMES = ("image/JPEG", "image/png", "application/pdf", "text/x")
add("mig3_blob_types", lambda s, d: star.table(s, d, "part").select("p_partkey", migrate.blob_type(F.element_at(F.array(*[F.lit(m) for m in (*MIMES, None)]), F.col("p_size") % 5 + 1)).alias("blob_type")), "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'pdf' ELSE 'data' END AS blob_type FROM part")
add("mig4_invariants", lambda s, d: migrate.checked_migration(star.versions(s, d), star.versions(s, d)), sql("SELECT count(*) AS rows_before, count(*) AS rows_after, 0 AS unrepaired, true AS ok FROM vers", "vers"))
add("blb1_data", lambda s, d: migrate.with_data(star.table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))).select("doc_id", "size", "checksum", "sync_status"), "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS size, sha256(coalesce(text, '')) AS checksum, 'pending_upload' AS sync_status FROM documents")
CUT = "substring(text, 1, 300)"
AT = f"greatest(CASE WHEN contains({CUT}, '.') THEN 300 - instr(reverse({CUT}), '.') ELSE -1 END, CASE WHEN contains({CUT}, chr(10)) THEN 300 - instr(reverse({CUT}), chr(10)) ELSE -1 END)"
add("doc1_summaries", lambda s, d: star.table(s, d, "documents").select("doc_id", migrate.summarised(F.col("text"), 300).alias("summary")), f"SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN {AT} > 240 THEN substring(text, 1, {AT} + 1) ELSE {CUT} || '...' END AS summary FROM documents")
add("doc2_manuals", lambda s, d: migrate.manual_metadata(star.table(s, d, "part").select(F.concat("p_name", F.lit("_PAR-42X "), "p_brand", F.when(F.col("p_size") > 25, "_Instruction Book.pdf").otherwise(".pdf")).alias("filename"), F.col("p_name").cast("binary").alias("data"))).groupBy("model_number", "document_type").agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes")), "SELECT 'PAR-42X' AS model_number, CASE WHEN p_size > 25 THEN 'instruction_manual' ELSE 'manual' END AS document_type, count(*) AS n, CAST(sum(length(p_name)) AS BIGINT) AS bytes FROM part GROUP BY 2")
add("doc3_photos", lambda s, d: migrate.photo_metadata(star.table(s, d, "part").select(F.concat("p_name", F.when(F.col("p_size") % 4 == 0, "_Serial").when(F.col("p_size") % 4 == 1, "_blower").when(F.col("p_size") % 4 == 2, "_Panel").otherwise(""), F.lit(".JPG")).alias("filename"), F.lit("x").cast("binary").alias("data"))).groupBy("photo_type", "format", "mime_type").agg(F.count("*").alias("n")), "SELECT CASE p_size % 4 WHEN 0 THEN 'serial_number' WHEN 1 THEN 'equipment' WHEN 2 THEN 'control_panel' ELSE 'device_photo' END AS photo_type, 'JPG' AS format, 'image/jpg' AS mime_type, count(*) AS n FROM part GROUP BY 1")

# time windows
ERRORS = "(SELECT CAST(user_id AS VARCHAR) AS identifier, epoch_us(ts) AS at_us, ts, event_type, event_id FROM events WHERE event_type = 'error')"


def attempts(s, d):
    e = star.table(s, d, "events").where("event_type = 'error'")
    return e.select(F.col("user_id").cast("string").alias("identifier"), micros("ts").alias("at_us"), "ts", F.lit(False).alias("success"), F.md5(F.col("event_id").cast("string")).alias("password_hash"))


def crowded(s, d):
    """All attempts within one hour, so that limits are met."""
    return attempts(s, d).withColumn("at_us", F.col("at_us") % 3_600_000_000)


add("u1_recent_attempts", lambda s, d: windows.attempts_before(crowded(s, d)).groupBy("identifier").agg(F.sum("n_recent").alias("total"), F.max("n_recent").alias("most")), f"SELECT identifier, CAST(sum(n) AS BIGINT) AS total, max(n) AS most FROM (SELECT identifier, count(*) OVER (PARTITION BY identifier ORDER BY at_us RANGE BETWEEN 299999999 PRECEDING AND 1 PRECEDING) AS n FROM (SELECT identifier, at_us % 3600000000 AS at_us FROM {ERRORS})) GROUP BY 1")
def tried(s, d):
    """All attempts within four hours, by group of fifteen users, some of them good: limits, longer lockouts and sweeps are met."""
    e = star.table(s, d, "events").where("event_type = 'error'")
    rows = e.select(F.floor(F.col("user_id") / 15).cast("string").alias("identifier"), (micros("ts") % 14_400_000_000).alias("at_us"), (F.col("event_id") % 17 == 0).alias("success"))
    return rows.groupBy("identifier", "at_us").agg(F.max("success").alias("success"))


LIMITS = """a AS (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY at_us) AS n FROM (SELECT CAST(user_id // 15 AS VARCHAR) AS identifier, epoch_us(ts) % 14400000000 AS at_us, max(event_id % 17 = 0) AS success FROM events WHERE event_type = 'error' GROUP BY 1, 2)),
l AS (SELECT DISTINCT identifier, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS recent, CAST(0 AS BIGINT) AS locked, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS at_us, true AS allowed, CAST(0 AS BIGINT) AS wait FROM a
UNION ALL SELECT identifier, n, CASE kind WHEN 'blocked' THEN recent WHEN 'full' THEN kept ELSE CASE WHEN success THEN [] ELSE list_append(kept, at_us) END END,
  CASE kind WHEN 'blocked' THEN locked WHEN 'full' THEN at_us + 900000000 * (step + 1) ELSE 0 END, CASE kind WHEN 'full' THEN least(step + 1, 5) WHEN 'ok' THEN CASE WHEN success THEN 0 ELSE step END ELSE step END,
  at_us, kind = 'ok', CASE kind WHEN 'blocked' THEN (locked - at_us) // 1000000 WHEN 'full' THEN 900 * (step + 1) ELSE 0 END
FROM (SELECT *, CASE WHEN at_us < locked THEN 'blocked' WHEN len(kept) >= 5 THEN 'full' ELSE 'ok' END AS kind FROM (
  SELECT l.identifier, a.n, recent, list_filter(recent, lambda t: t > a.at_us - 300000000) AS kept, a.at_us, a.success, CASE WHEN locked > 0 AND a.at_us >= (locked // 3600000000 + 1) * 3600000000 THEN 0 ELSE locked END AS locked, CASE WHEN locked > 0 AND a.at_us >= (locked // 3600000000 + 1) * 3600000000 THEN 0 ELSE step END AS step
  FROM l JOIN a ON a.identifier = l.identifier AND a.n = l.n + 1)))"""
LIMITED = sql("SELECT identifier, at_us, allowed, wait AS retry_after_s FROM l WHERE n > 0", recursive=LIMITS)
add("u2_limiter", lambda s, d: windows.limited(tried(s, d)), LIMITED)
add("u3_rate_status", lambda s, d: windows.rate_status(crowded(s, d), 3_600_000_000), f"SELECT identifier, count(*) FILTER (WHERE at_us % 3600000000 > 3300000000) AS attempts, 5 AS max_attempts, count(*) FILTER (WHERE at_us % 3600000000 > 3300000000) >= 5 AS at_limit FROM {ERRORS} GROUP BY 1")
SLIDES = f"(SELECT m AS window_us, identifier, count(*) AS failures, count(DISTINCT substring(md5(CAST(event_id AS VARCHAR)), 1, 8)) AS prefixes FROM (SELECT *, unnest(range(at_us // 43200000000 * 43200000000 - 129600000000, at_us // 43200000000 * 43200000000 + 43200000000, 43200000000)) AS m FROM {ERRORS}) GROUP BY 1, 2)"
add("u4_suspicious", lambda s, d: windows.suspicious(attempts(s, d), "12 hours", "48 hours").select(micros(F.col("window_start").cast("timestamp_ntz")).alias("window_us"), "identifier", "pattern", "n"), f"SELECT window_us, identifier, 'excessive_failed_attempts' AS pattern, failures AS n FROM {SLIDES} WHERE failures >= 10 UNION ALL SELECT window_us, identifier, 'credential_stuffing', prefixes FROM {SLIDES} WHERE prefixes >= 5")


def backups(s, d):
    return star.table(s, d, "events").select(F.concat(F.lit("b"), "event_id").alias("name"), micros("ts").alias("created_us"))


add("u5_retention", lambda s, d: windows.retained(backups(s, d), 1_704_326_400_000_000, 2, 60, True).select("name", "keep"), "SELECT name, (created_us >= 1704326400000000 - 2 * 86400000000 AND r <= 60) OR r = 1 AS keep FROM (SELECT 'b' || event_id AS name, epoch_us(ts) AS created_us, row_number() OVER (ORDER BY ts DESC) AS r FROM events)")
add("u6_query_log", lambda s, d: windows.query_log(star.table(s, d, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("identifier"), micros("ts").alias("at_us")), ["error"], "3", limit=20).select("event_id", "at_us"), f"SELECT event_id, at_us FROM {ERRORS} WHERE identifier = '3' ORDER BY at_us DESC LIMIT 20")
add("u6_report", lambda s, d: windows.audit_report(star.table(s, d, "events").select("event_type", F.col("user_id").alias("identifier"))), "SELECT event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_identifiers FROM events GROUP BY 1")
add("u7_active_tokens", lambda s, d: windows.active_tokens(star.table(s, d, "events").select("event_id", (micros("ts") + 3_600_000_000).alias("expires_us")), 1_704_110_400_000_000).select("event_id"), "SELECT event_id FROM events WHERE epoch_us(ts) + 3600000000 > 1704110400000000")


# sources, sinks and streams
def _backup(s, d):
    rows = star.entities(s, d).select("id", "name", "entity_type")
    return snapshots.restore(s, snapshots.backup(rows, snapshots.shared_folder(s, "backup"), "test"))


add("snk8_backup_restore", _backup, sql("SELECT id, name, entity_type FROM entities", "entities"))


def _json(s, d):
    folder = snapshots.write_json(star.entities(s, d).select("id", "name"), snapshots.shared_folder(s, "json"))
    return s.read.schema("id string, name string").json(folder)


add("snk10_json_lines", _json, sql("SELECT id, name FROM entities", "entities"))


def _snapshot(s, d):
    return snapshots.read_snapshot(s, snapshots.write_snapshot(star.entities(s, d), snapshots.shared_folder(s, "snapshot"))).groupBy("entity_type").agg(F.count("*").alias("n"))


add("snk1_snapshot", _snapshot, sql("SELECT entity_type, count(*) AS n FROM entities GROUP BY 1", "entities"))


def _limits(s, d):
    """The attempts in three files that are not in order of time, and a last one that moves the watermark past them all."""
    folder = snapshots.shared_folder(s, "attempts")
    rows = tried(s, d)
    for part in range(3):
        rows.where(F.pmod(F.xxhash64("identifier", "at_us"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    s.createDataFrame([("", 1 << 50, False)], "identifier string, at_us long, success boolean").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = s.readStream.schema("identifier string, at_us long, success boolean").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    with keyed_state(s):
        limited_stream(stream, "4 hours").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{folder}/out").where("identifier <> ''")


add("u2_limiter_stream", _limits, LIMITED)


def _sync_stream(s, d):
    """Three micro-batches of creates and updates, each based on the version before."""
    folder = snapshots.shared_folder(s, "sync")
    w = Window.partitionBy("id").orderBy("server_seq")
    v = star.versions(s, d).withColumn("before", F.lag("version").over(w))
    rows = v.select(F.col("server_seq").cast("int").alias("pos"), micros("created_at").alias("apply_us"), F.when(F.col("before").isNull(), "create").otherwise("update").alias("change_type"), "id", "version", "content", F.when(F.col("before").isNull(), F.array().cast("array<string>")).otherwise(F.array("before")).alias("parent_versions"))
    top = rows.agg(F.max("pos").alias("top"))
    rows = rows.crossJoin(top).withColumn("part", F.least(F.lit(2), F.floor(F.col("pos") * 3 / (F.col("top") + 1))))  # one row
    kind = "pos int, apply_us long, change_type string, id string, version string, content string, parent_versions array<string>"
    store = Store(s, f"{folder}/store")
    for part in range(3):  # a micro-batch is what came since the last run, in as many files as there are tasks
        rows.where(F.col("part") == part).drop("part", "top").write.mode("append").parquet(f"{folder}/in")
        sync_stream(s.readStream.schema(kind).parquet(f"{folder}/in"), store, f"{folder}/state").awaitTermination()
    return store.rows().groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("is_latest")).alias("n_latest"), F.max_by("version", F.when(F.col("is_latest"), F.col("server_seq"))).alias("latest"))


add("syn1_sync_stream", _sync_stream, sql("SELECT v.id, count(*) AS n, 1 AS n_latest, max(c.version) AS latest FROM vers v JOIN cur c USING (id) GROUP BY 1", "cur"))
