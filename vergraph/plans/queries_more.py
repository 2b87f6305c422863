"""Queries on replica files, backups, plain inserts and observers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vergraph.functions.values import is_tombstoned
from vergraph.operators import relations, replica, search, versions as ver
from vergraph.sources import change_log, digest_tree, postings, snapshots, star
from vergraph.streaming.changes import Store, sync_stream

from .oracle import sql
from .queries_data import _engine_sql, ranked
from .queries_sync import _store, flagged

QUERIES: dict = {}


def add(name, query, text=None):
    QUERIES[name] = (query, text)


def _replica(s, d):
    arrival = F.row_number().over(Window.partitionBy("id").orderBy("server_seq")) - 1
    folder = snapshots.write_replica(star.versions(s, d).withColumn("arrival", arrival), snapshots.shared_folder(s, "replica"), 16)
    return snapshots.read_replica(s, f"{folder}/*").select("id", "version", "name", F.get_json_object("content", "$.kind").alias("kind"), "arrival")


add("src3_replica_files", _replica, sql("SELECT id, version, name, user_id AS kind, CAST(row_number() OVER (PARTITION BY id ORDER BY server_seq) - 1 AS INT) AS arrival FROM vers", "vers"))


def _new_edges(s, d):
    """All edges; those that connect rooms and zones come without an id."""
    return relations.with_ids(star.relationships(s, d).withColumn("id", F.when(F.col("relationship_type") != "connects_to", F.col("id"))))


SHAPE = "substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-' || substring(h, 17, 4) || '-' || substring(h, 21, 12)"
add("snk3_edge_ids", lambda s, d: _new_edges(s, d).select("id", "relationship_type"), sql(f"SELECT CASE WHEN relationship_type = 'connects_to' THEN {SHAPE} ELSE e END AS id, relationship_type FROM (SELECT relationship_type, relationship_type || '|' || src || '|' || dst AS e, md5(relationship_type || '|' || src || '|' || dst) AS h FROM rels)", "rels"))
add("snk4_plain_insert", lambda s, d: ver.insert_plain(_store(s, d), flagged(s, d).where("is_latest").select("id", "version", "content")).groupBy("id").agg(F.count_if("is_latest").alias("n_latest"), F.count("server_seq").alias("n_numbered"), F.max("version").alias("greatest")), sql("SELECT id, 2 AS n_latest, 1 AS n_numbered, max(version) AS greatest FROM (SELECT id, version, row_number() OVER (PARTITION BY id ORDER BY server_seq) AS a, row_number() OVER (PARTITION BY id ORDER BY server_seq DESC) AS b FROM vers) WHERE a = 1 OR b = 1 GROUP BY id", "vers"))
add("flt8_listed_by_type", lambda s, d: replica.listed_by_type(star.versions(s, d).withColumn("entity_type", F.col("user_id")), "click", "server_seq").select("id", "version", "stale"), sql("SELECT id, version, user_id <> 'click' AS stale FROM cur WHERE id IN (SELECT id FROM vers WHERE user_id = 'click')", "cur"))
add("sch13_rest_search", lambda s, d: ranked(search.search_rest(star.entities(s, d), "small ring", ["device"], 1000), "name"), _engine_sql("small ring", "0.1", 100))
KINDS = ("home", "zone", "room", "device", "automation", "manual")


def _listed(s, d):
    """A backup of each type of entity; one is deleted, the others are listed."""
    root = snapshots.shared_folder(s, "backups")
    for kind in KINDS:
        snapshots.backup(star.entities(s, d).where(F.col("entity_type") == kind).select("id", "name"), f"{root}/{kind}", f"all of {kind}")
    snapshots.delete_backup(s, root, "zone")
    return snapshots.list_backups(s, root).select("name", "n_rows", "description")


add("src6_listed_backups", _listed, sql("SELECT entity_type AS name, count(*) AS n_rows, 'all of ' || entity_type AS description FROM entities WHERE entity_type <> 'zone' GROUP BY entity_type", "entities"))


def _mirrored(s, d):
    """Four rounds, one of them without a change; two backups are kept at both places."""
    root, mirror = snapshots.shared_folder(s, "backups"), snapshots.shared_folder(s, "mirror")
    v = star.versions(s, d).select("id", "version", "server_seq")
    for name, most in (("a", 100), ("b", 200), ("c", 200), ("d", 1 << 60)):
        snapshots.mirrored_backup(v.where(F.col("server_seq") <= most), root, mirror, name, 2)
    return snapshots.list_backups(s, root).withColumn("place", F.lit("root")).union(snapshots.list_backups(s, mirror).withColumn("place", F.lit("mirror"))).select("place", "name", "n_rows")


add("snk9_mirrored_backups", _mirrored, sql("SELECT place, name, n_rows FROM (VALUES ('root'), ('mirror')) p(place), (SELECT 'b' AS name, count(*) FILTER (WHERE server_seq <= 200) AS n_rows FROM vers UNION ALL SELECT 'd', count(*) FROM vers)", "vers"))


def _observed(s, d):
    """Three micro-batches of first versions; who observes them sees each number once."""
    folder = snapshots.shared_folder(s, "observed")
    rows = _store(s, d).select(F.col("server_seq").cast("int").alias("pos"), F.col("updated_us").alias("apply_us"), F.lit("create").alias("change_type"), "id", "version", "content", F.array().cast("array<string>").alias("parent_versions"))
    kind = "pos int, apply_us long, change_type string, id string, version string, content string, parent_versions array<string>"
    store, seen = Store(s, f"{folder}/store"), []
    for part in range(3):
        rows.where(F.pmod(F.xxhash64("id"), F.lit(3)) == part).write.mode("append").parquet(f"{folder}/in")
        sync_stream(s.readStream.schema(kind).parquet(f"{folder}/in"), store, f"{folder}/state", seen.append).awaitTermination()
    counts = store.rows().agg(F.count("*").alias("n_rows"), F.max("server_seq").alias("top"))
    return s.createDataFrame([(b,) for b in seen], "batch int").crossJoin(counts)  # three rows, one row


add("udf2_observed_batches", _observed, sql("SELECT b AS batch, count(DISTINCT id) AS n_rows, count(DISTINCT id) AS top FROM vers, (VALUES (0), (1), (2)) t(b) GROUP BY b", "vers"))


# the inverted index over all entities, built from the tables; a change batch of all devices stands in for the older rows
def _indexed(s, d):
    index = postings.build(star.entities(s, d))
    index.add(star.entities(s, d).where("entity_type = 'device'"))
    return index


add("sch5_indexed", lambda s, d: ranked(_indexed(s, d).search_engine("small ring", ["device"]), "name"), _engine_sql("small ring", "0.1"))
add("sch10_indexed", lambda s, d: _indexed(s, d).search_replica("brand#13").select("id"), sql("SELECT id FROM entities WHERE contains(lower(name), 'brand#13') OR contains(lower(content), 'brand#13')", "entities"))
add("flt12_indexed", lambda s, d: _indexed(s, d).name_contains("S_all%RING").select("id", "name"), sql("SELECT id, name FROM entities WHERE name ILIKE '%S_all%RING%'", "entities"))


def _halves(s, d):
    """The versions of the first nine tenths of all events, and of all."""
    v = star.versions(s, d)
    top = v.agg(F.max("server_seq").alias("m"))
    v = v.crossJoin(top)  # one row
    return v.where("server_seq <= floor(m * 9 / 10)").drop("m"), v.where("server_seq > floor(m * 9 / 10)").drop("m")


def _differing(s, d):
    """Two stores, one of which lacks the last tenth of the events."""
    now = lambda v: ver.with_latest_flag(v, F.col("server_seq")).where("is_latest").select("id", "version")
    folder, (early, late) = snapshots.shared_folder(s, "ranges"), _halves(s, d)
    a, b = digest_tree.KeptRows(s, f"{folder}/a").write(now(early)), digest_tree.KeptRows(s, f"{folder}/b").write(now(early.unionByName(late)))
    return digest_tree.differing(a, b)


add("agg6_differing_ids", _differing, sql("SELECT c.id, e.version AS version_a, c.version AS version_b FROM cur c LEFT JOIN (SELECT * FROM vers WHERE server_seq <= (SELECT max(server_seq) * 9 // 10 FROM vers) QUALIFY row_number() OVER (PARTITION BY id ORDER BY server_seq DESC) = 1) e ON e.id = c.id WHERE e.version IS DISTINCT FROM c.version", "cur"))


def _log(s, d):
    """The change feed in two appends."""
    log = change_log.ChangeLog(s, snapshots.shared_folder(s, "feed"), "id string, version string, content string, server_seq long", block=1000)
    early, late = (v.select("id", "version", "content", "server_seq") for v in _halves(s, d))
    log.append(early)
    before = early.groupBy("id").agg(F.max("server_seq").alias("server_seq"))
    log.append(late, before.join(late.select("id").distinct(), "id", "left_semi"))
    return log


add("syn10_log_page", lambda s, d: _log(s, d).page(5000, 50).select("id", "version", F.when(is_tombstoned(F.col("content")), "delete").otherwise("update").alias("change_type"), "server_seq"), sql("SELECT id, version, CASE WHEN deleted THEN 'delete' ELSE 'update' END AS change_type, server_seq FROM cur WHERE server_seq > 5000 ORDER BY server_seq LIMIT 50", "cur"))
add("flt16_log_rows", lambda s, d: _log(s, d).blocks(0, 1 << 60).select("id", "version", "server_seq"), sql("SELECT id, version, server_seq FROM cur", "cur"))
