"""Queries on writes, payloads, sets, paging and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vergraph.functions import text
from vergraph.functions.values import difference_ms, is_tombstoned, list_field, merged_content, micros, repaired_version, text_field, version_text, version_time
from vergraph.operators import differences, migrate, relations, replica, search, similarity, stats, sync, tools, traverse, versions as ver, wire
from vergraph.sources import star

from .oracle import PIN, sql
from .queries_data import DEVICES, JAC, _appended, _outcomes, current, devices, flagged, ranked
from .queries_sync import PENDING, RANKED, _edges, _single, _store, acked, edits

QUERIES: dict = {}


def add(name, query, text=None):
    QUERIES[name] = (query, text)


def documents(s, d):
    return star.table(s, d, "documents")


# writes
add("snk2_store_versions", _appended, sql("SELECT v.id, count(*) AS n, max(v.server_seq) AS max_seq, max(c.version) AS latest, 1 AS n_latest FROM vers v JOIN cur c USING (id) GROUP BY 1", "cur"))
add("snk6_upsert_edges", lambda s, d: relations.upserted_counts(star.KeyedEdges(s, d), _edges(s, d, None).withColumn("properties", F.lit('{"n":1}')).withColumn("pos", F.lit(1)), ["relationship_type", "properties"]), sql("""SELECT relationship_type, CASE relationship_type WHEN 'part_of' THEN '{"n":1}' ELSE properties END AS properties, count(*) AS n FROM rels GROUP BY ALL""", "rels"))
add("mig5_backfill", lambda s, d: ver.backfilled(star.versions(s, d).drop("server_seq")).groupBy("id").agg(F.count_if("is_latest").alias("n_latest"), F.max("server_seq").alias("max_seq")), sql("SELECT id, 1 AS n_latest, max(server_seq) AS max_seq FROM vers GROUP BY 1", "vers"))


def _upkeep_batch(s, d):
    """Every third room becomes a tombstone, and one nation gets a new edge to a new node."""
    g = star.graph(s, d)
    gone = g.latest().where("entity_type = 'room' and cast(split_part(id, '-', 2) as int) % 3 = 0").withColumn("content", F.lit('{"deleted":true}')).withColumn("pos", F.lit(1))
    new = s.createDataFrame([("hall", PIN, "room", "Hall", "{}", True, 2)], "id string, version string, entity_type string, name string, content string, is_latest boolean, pos int")
    edge = s.createDataFrame([("e", "hall", PIN, "nation-0", PIN, "located_in", "{}", 1), ("f", "hall", PIN, "nowhere", PIN, "located_in", "{}", 2)], "id string, from_entity_id string, from_entity_version string, to_entity_id string, to_entity_version string, relationship_type string, properties string, pos int")
    return g, gone.unionByName(new), edge


def _batch(s, d):
    """Every third room goes, and every connection becomes a location."""
    g = star.graph(s, d)
    gone = g.latest().where("entity_type = 'room' and cast(split_part(id, '-', 2) as int) % 3 = 0").withColumn("content", F.lit('{"deleted":true}')).withColumn("pos", F.lit(1))
    return differences.kept_up(differences.counted(g), differences.retyped(g, gone, ["connects_to"], "located_in"))


GONE = "gone AS (SELECT id FROM entities WHERE entity_type = 'room' AND CAST(split_part(id, '-', 2) AS INT) % 3 = 0)"
add("trv20_upkeep_edges", lambda s, d: relations.upkeep_counts(*_upkeep_batch(s, d), ["relationship_type"]), sql("SELECT relationship_type, count(*) AS n FROM (SELECT relationship_type, src, dst FROM rels UNION ALL SELECT 'located_in', 'hall', 'nation-0') WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) GROUP BY 1", "entities", "rels", recursive=GONE))
add("syn15_upkeep_nodes", lambda s, d: relations.upkeep(*_upkeep_batch(s, d)).entities.groupBy("entity_type").agg(F.count("*").alias("n")), sql("SELECT entity_type, count(*) AS n FROM (SELECT id, entity_type FROM entities UNION ALL SELECT 'hall', 'room') WHERE id NOT IN (SELECT id FROM gone) GROUP BY 1", "entities", recursive=GONE))
LEFT = "SELECT CASE relationship_type WHEN 'connects_to' THEN 'located_in' ELSE relationship_type END AS kind, src, dst FROM rels WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)"
add("agg1_differences", lambda s, d: _batch(s, d).types, sql(f"SELECT 'entity' AS what, entity_type AS type, count(*) AS n FROM entities WHERE id NOT IN (SELECT id FROM gone) GROUP BY 2 UNION ALL SELECT 'relationship', kind, count(*) FROM ({LEFT}) GROUP BY 2", "entities", "rels", recursive=GONE))
add("trv20_differences", lambda s, d: _batch(s, d).degrees, sql(f"SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM ({LEFT}) UNION ALL SELECT dst, 0, 1 FROM ({LEFT})) GROUP BY 1", "entities", "rels", recursive=GONE))
add("tol5_create_entity", lambda s, d: tools.created_entities(star.table(s, d, "part").select(F.lit("device").alias("entity_type"), F.col("p_name").alias("name"), F.lit("{}").alias("content")), "me", F.expr("timestamp_ntz'2025-01-01 00:00:00'")).select("entity_type", "name", "version", F.length("id").alias("id_length")), "SELECT 'device' AS entity_type, p_name AS name, '2025-01-01T00:00:00.000000+00:00-000000-me' AS version, 36 AS id_length FROM part")

# payloads
add("prj3_blob_payload", lambda s, d: wire.blob_payload(documents(s, d).select("doc_id", F.col("text").cast("binary").alias("data")), include_data=True), "SELECT doc_id, CASE WHEN text <> '' THEN base64(encode(text)) END AS data FROM documents")
PREVIEW = "'brand: ' || p_brand || ', type: ' || p_type || ', size: ' || p_size || '...'"
add("prj5_preview", lambda s, d: devices(s, d).select("id", text.content_preview(F.col("content")).alias("preview")), f"SELECT 'part-' || p_partkey AS id, {PREVIEW} AS preview FROM part")
add("prj6_search_payload", lambda s, d: wire.search_payload(star.entities(s, d).where("entity_type in ('device', 'zone')"), F.lit(1.0)), f"SELECT 'part-' || p_partkey AS id, p_name AS name, 'device' AS entity_type, 1.0::DOUBLE AS score, {PREVIEW} AS preview FROM part UNION ALL SELECT 'nation-' || n_nationkey, n_name, 'zone', 1.0, NULL FROM nation")
add("prj8_entity_payload", lambda s, d: wire.entity_payload(star.versions(s, d).withColumn("user_id", F.when(F.col("user_id") != "click", F.col("user_id"))).withColumn("parent_versions", F.lit(None).cast("array<string>"))).select("id", "version", "user_id", F.size("parent_versions").alias("n_parents")), sql("SELECT id, version, CASE user_id WHEN 'click' THEN 'unknown' ELSE user_id END AS user_id, 0 AS n_parents FROM vers", "vers"))
LAST = "SELECT user_id AS client_id, max(epoch_us(ts)) FILTER (WHERE event_type <> 'error') AS good FROM events GROUP BY 1"
FAILS = f"SELECT client_id, good, count(*) FILTER (WHERE event_type = 'error' AND epoch_us(ts) > coalesce(good, -1)) AS fails FROM events JOIN ({LAST}) ON client_id = user_id GROUP BY 1, 2"
add("syn17_sync_status", lambda s, d: wire.sync_status(stats.sync_counters(_outcomes(s, d))).select("client_id", "sync_failures", "healthy", "next_retry_us"), f"SELECT client_id, fails AS sync_failures, fails = 0 AS healthy, CASE WHEN fails > 0 THEN coalesce(good, 0) // 60000000 * 60000000 + CAST(30 * pow(2, least(fails, 6)) AS BIGINT) * 1000000 END AS next_retry_us FROM ({FAILS})")


def _answers(s, d):
    """One JSON answer of the server for every event."""
    entity = F.struct(F.struct(F.col("id")).alias("entity"))
    lost = F.array(F.struct(F.col("id").alias("entity_id"), F.lit("local_wins").alias("resolution_strategy")))
    return star.versions(s, d).select(F.to_json(F.struct(F.array(entity).alias("changes"), F.when(F.col("user_id") == "error", lost).alias("conflicts"))).alias("body"))


add("cli6_push_result", lambda s, d: wire.pushed(_answers(s, d)).groupBy("id", "conflict").agg(F.count("*").alias("n")), sql("SELECT id, NULL AS conflict, count(*) AS n FROM vers GROUP BY 1 UNION ALL SELECT id, 'local_wins', count(*) FROM vers WHERE deleted GROUP BY 1", "vers"))
add("cli7_watermarks", lambda s, d: star.versions(s, d).select("version", F.unix_micros(version_time(F.col("version"))).alias("us")), sql("SELECT version, us FROM vers", "vers"))
add("syn11_change_types", lambda s, d: ver.as_change(star.versions(s, d)).groupBy("change_type").agg(F.count("*").alias("n")), sql("SELECT CASE WHEN deleted THEN 'delete' ELSE 'update' END AS change_type, count(*) AS n FROM vers GROUP BY 1", "vers"))

# sync
add("syn6_preserved", lambda s, d: sync.apply_batch(_store(s, d), _single(s, d))[0].where("not is_latest").select("id", "version"), sql("SELECT l.id, f.version FROM k f JOIN cur l ON l.id = f.id AND l.server_seq <> f.server_seq WHERE f.n = 1", "cur", recursive=RANKED))
add("syn12_latest_map", lambda s, d: current(s, d).select("id", "version", "content"), sql("SELECT id, version, content FROM cur", "cur"))
add("syn16_drift", lambda s, d: stats.drifted(star.versions(s, d), stats.generation_marker(star.versions(s, d))).union(stats.drifted(star.versions(s, d), stats.generation_marker(star.versions(s, d).where("user_id <> 'click'")))), "SELECT * FROM (VALUES (false), (true)) t(drifted)")
LATE = "CASE WHEN abs(l.us - f.us) < 1000000 THEN l.version > f.version ELSE l.us > f.us END"
add("agg12_outcomes", lambda s, d: sync.apply_changes(_store(s, d), _single(s, d)).groupBy("outcome").agg(F.count("*").alias("n")), sql(f"SELECT CASE WHEN {LATE} THEN 'conflict_won' ELSE 'conflict_lost' END AS outcome, count(*) AS n FROM k f JOIN cur l ON l.id = f.id AND l.server_seq <> f.server_seq WHERE f.n = 1 GROUP BY 1", "cur", recursive=RANKED))
add("agg14_pending_count", lambda s, d: replica.pending_state(edits(s, d), acked(s, d)).agg(F.count("*").alias("n"), (F.count("*") > 0).alias("has_pending")), f"SELECT count(*) AS n, count(*) > 0 AS has_pending FROM ({PENDING})")


def _cycle(s, d):
    v = flagged(s, d)
    local = ver.with_latest_flag(star.versions(s, d).where("server_seq <= 600"), F.col("server_seq"))
    return replica.sync_cycle(local, v, edits(s, d).where("operation = 'create'"), 600, 1 << 30)


add("cli1_cycle_pulled", lambda s, d: _cycle(s, d)[0].where("is_latest").select("id", "version"), sql("SELECT id, version FROM cur", "cur"))
add("cli1_cycle_pushed", lambda s, d: _cycle(s, d)[1].select("id", "version"), sql("SELECT id, version FROM vers WHERE server_seq <= 600 AND id IN (SELECT id FROM vers WHERE user_id = 'click') QUALIFY row_number() OVER (PARTITION BY id ORDER BY server_seq DESC) = 1", "vers"))
add("cli1_cycle_waiting", lambda s, d: _cycle(s, d)[2].groupBy("id").agg(F.count("*").alias("n")), sql("SELECT id, count(*) AS n FROM vers WHERE user_id = 'click' AND id NOT IN (SELECT id FROM vers WHERE server_seq <= 600) GROUP BY 1", "vers"))
add("cli12_by_type", lambda s, d: replica.type_index(star.entities(s, d)).select("entity_type", "n"), sql("SELECT entity_type, count(*) AS n FROM entities GROUP BY 1", "entities"))
add("blb2_uploaded", lambda s, d: migrate.marked(documents(s, d).select("doc_id"), "uploaded", "https://blobs"), "SELECT doc_id, 'uploaded' AS sync_status, 'https://blobs' AS server_url FROM documents")
add("doc4_linked_manual", lambda s, d: migrate.linked_manual(documents(s, d).select("doc_id"), "Pump"), "SELECT doc_id, 'Pump' AS device_name, 'DOCUMENTED_BY' AS relationship_type FROM documents")
add("doc5_file_summary", lambda s, d: migrate.manual_metadata(documents(s, d).select(F.lit("a.pdf").alias("filename"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))).groupBy("summary").agg(F.count("*").alias("n")), "SELECT 'PDF Document (' || octet_length(encode(coalesce(text, ''))) || ' bytes)' AS summary, count(*) AS n FROM documents GROUP BY 1")

# lookups, joins and sets
add("flt13_types", lambda s, d: ver.filtered(star.entities(s, d), ["zone", "room"]).select("id"), sql("SELECT id FROM entities WHERE entity_type IN ('zone', 'room')", "entities"))
add("flt19_by_id", lambda s, d: ver.by_id(star.entities(s, d), "part-7").select("id", "name"), "SELECT 'part-' || p_partkey AS id, p_name AS name FROM part WHERE p_partkey = 7")
add("jon6_expansion", lambda s, d: star.graph(s, d).edges().join(star.entities(s, d).where("entity_type = 'zone'").select(F.col("id").alias("src")), "src").select("src", "dst", "relationship_type"), sql("SELECT src, dst, relationship_type FROM rels WHERE src LIKE 'nation-%'", "rels"))
add("jon7_unvisited", lambda s, d: traverse.connected(star.graph(s, d), "nation-0").select("id").distinct().join(traverse.connected(star.graph(s, d), "supplier-1").select("id"), "id", "left_anti"), sql("SELECT DISTINCT id FROM ways WHERE at_id = 'nation-0' AND id NOT IN (SELECT id FROM ways WHERE at_id = 'supplier-1')", "ways"))
add("jon8_id_set", lambda s, d: star.entities(s, d).join(star.table(s, d, "lineitem").where("l_suppkey = 1").select(F.concat(F.lit("part-"), "l_partkey").alias("id")), "id", "left_semi").select("id", "name"), "SELECT 'part-' || p_partkey AS id, p_name AS name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1)")
add("jon10_chain", lambda s, d: tools.automations_in_room(star.graph(s, d), "supplier-2").select("id", F.size("affected").alias("n")), "SELECT 'order-' || l_orderkey AS id, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 2) GROUP BY 1")
add("jon11_orphans", lambda s, d: replica.unsent_edges(star.entities(s, d).where("entity_type <> 'room'").select("id"), star.KeyedEdges(s, d)).groupBy("relationship_type").agg(F.count("*").alias("n")), sql("SELECT relationship_type, count(*) AS n FROM rels WHERE src LIKE 'supplier-%' OR src LIKE 'customer-%' GROUP BY 1", "rels"))
add("jon12_incumbents", lambda s, d: star.versions(s, d).select("id", F.col("version").alias("incoming")).join(current(s, d).where("server_seq <= 5000").select("id", F.col("version").alias("incumbent")), "id", "left"), sql("SELECT v.id, v.version AS incoming, c.version AS incumbent FROM vers v LEFT JOIN (SELECT * FROM cur WHERE server_seq <= 5000) c ON c.id = v.id", "cur"))
HIERARCHY = "walk AS (SELECT 'part-7' AS id, 0 AS depth UNION SELECT r.dst, walk.depth + 1 FROM walk JOIN rels r ON r.src = walk.id AND r.relationship_type = 'located_in' WHERE walk.depth < {})"
add("trv5_walk_2", lambda s, d: traverse.ancestors(star.graph(s, d), "part-7", "located_in", 2), sql("SELECT id, min(depth) AS depth FROM walk GROUP BY id HAVING min(depth) >= 1", "rels", recursive=HIERARCHY.format(2)))
add("trv5_walk_0", lambda s, d: traverse.ancestors(star.graph(s, d), "part-7", "located_in", 0).select("id"), "SELECT '' AS id WHERE false")
add("sim5_similar", lambda s, d: ranked(similarity.similar_engine(devices(s, d), "part-1", 0.5, 50)), "SELECT id, CAST(score AS DOUBLE) AS score FROM (" + JAC.replace("'part-0'", "'part-1'") + ") WHERE id <> 'part-1' AND score >= 0.5 ORDER BY score DESC, id LIMIT 50")
add("tol9_similar", lambda s, d: ranked(tools.call(star.graph(s, d), "find_similar_entities", entity_id="part-0", threshold=0.9, limit=5)), f"SELECT id, CAST(score AS DOUBLE) AS score FROM ({JAC}) WHERE id <> 'part-0' AND score >= 0.9 ORDER BY score DESC, id LIMIT 5")
add("set1_neighbours", lambda s, d: traverse.connected(star.graph(s, d), "nation-1").select("id", "direction"), sql("SELECT id, direction FROM ways WHERE at_id = 'nation-1'", "ways"))
add("set2_shared_words", lambda s, d: devices(s, d).select("id", F.size(F.array_intersect(text.words(F.col("name")), F.array(F.lit("small"), F.lit("ring")))).alias("shared"), F.size(F.array_union(text.words(F.col("name")), F.array(F.lit("small"), F.lit("ring")))).alias("all_words")), f"SELECT id, len(list_intersect(list_distinct(w), ['small', 'ring'])) AS shared, len(list_distinct(list_concat(w, ['small', 'ring']))) AS all_words FROM (SELECT id, string_split(lower(name), ' ') AS w FROM {DEVICES})")
add("srt1_top_in_type", lambda s, d: star.entities(s, d).withColumn("_n", F.row_number().over(Window.partitionBy("entity_type").orderBy(F.desc(F.length("name")), "id"))).where("_n <= 3").select("id", "entity_type"), sql("SELECT id, entity_type FROM entities QUALIFY row_number() OVER (PARTITION BY entity_type ORDER BY length(name) DESC, id) <= 3", "entities"))
add("srt2_orders", lambda s, d: ver.page(star.versions(s, d).select("id", "version", "created_at", "server_seq"), ["created_at", "server_seq"], 100).select("id", "version"), sql("SELECT id, version FROM vers ORDER BY us, server_seq LIMIT 100", "vers"))
add("lim1_overfetch", lambda s, d: search.search_names(star.versions(s, d), "user 1", ["note"], 5).select("id", "version"), sql("SELECT id, version FROM (SELECT * FROM (SELECT * FROM vers WHERE name ILIKE '%user 1%' ORDER BY us DESC, id, version LIMIT 15) QUALIFY row_number() OVER (PARTITION BY id ORDER BY us DESC) = 1) ORDER BY us DESC LIMIT 5", "vers"))
add("lim2_offset_page", lambda s, d: ver.page(star.relationships(s, d).select("id", "relationship_type"), ["id"], 50, 100), sql("SELECT relationship_type || '|' || src || '|' || dst AS id, relationship_type FROM rels ORDER BY 1 LIMIT 50 OFFSET 100", "rels"))

# scalar functions
add("str1_words", lambda s, d: documents(s, d).select("doc_id", F.size(text.words(F.coalesce("text", F.lit("")))).alias("n_words")), "SELECT doc_id, len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS n_words FROM documents")
add("str2_repaired", lambda s, d: star.versions(s, d).select("version", repaired_version(F.replace("version", F.lit("+00:00-"), F.lit("+00:00Z-"))).alias("repaired")), sql("SELECT version, version AS repaired FROM vers", "vers"))
add("str3_ratio", lambda s, d: devices(s, d).select("id", F.round(text.match_ratio(F.lower("name"), F.lit("small ring")), 9).alias("ratio")))
add("str4_version_text", lambda s, d: star.versions(s, d).select("server_seq", version_text(F.col("created_at"), F.col("server_seq"), F.lit("u")).alias("version")), sql("SELECT server_seq, substring(version, 1, 32) || '-' || lpad(CAST(server_seq AS VARCHAR), 6, '0') || '-u' AS version FROM vers", "vers"))
GAPS = "SELECT server_seq, us, lag(us) OVER (PARTITION BY id ORDER BY server_seq) AS before FROM vers"


def _gaps(s, d):
    before = F.lag(micros("created_at")).over(Window.partitionBy("id").orderBy("server_seq"))
    return star.versions(s, d).select("server_seq", before.alias("before"), micros("created_at").alias("us")).where("before is not null")


add("dat1_differences", lambda s, d: _gaps(s, d).select("server_seq", difference_ms(F.col("us"), F.col("before")).alias("ms")), sql(f"SELECT server_seq, CAST(trunc((before - us) / 1000) AS BIGINT) AS ms FROM ({GAPS}) WHERE before IS NOT NULL", "vers"))
add("mth1_averages", lambda s, d: traverse.degrees(star.graph(s, d)).agg(F.round(F.try_divide(F.sum("degree"), F.count("*")), 2).alias("average_degree"), F.try_divide(F.sum("degree"), F.count_if(F.col("degree") < 0)).alias("guarded")), sql("SELECT round((2 * (SELECT count(*) FROM rels)) / (SELECT count(*) FROM entities), 2) AS average_degree, CAST(NULL AS DOUBLE) AS guarded", "entities", "rels"))
add("arr1_capabilities", lambda s, d: devices(s, d).select("id", F.get(F.slice(list_field(F.col("content"), "capabilities"), 1, 1), F.lit(0)).alias("capability"), F.array_contains(list_field(F.col("content"), "capabilities"), "ECO").alias("eco")), "SELECT 'part-' || p_partkey AS id, p_type AS capability, p_type = 'ECO' AS eco FROM part")
MERGED = '{"size":1,"room":{"a":[1]}}'
add("map1_merged_content", lambda s, d: devices(s, d).withColumn("m", merged_content(F.col("content"), F.lit(MERGED))).select("id", text_field(F.col("m"), "size").alias("size"), text_field(F.col("m"), "brand").alias("brand"), text_field(F.col("m"), "room").alias("room")), "SELECT 'part-' || p_partkey AS id, '1' AS size, p_brand AS brand, '{\"a\":[1]}' AS room FROM part")
add("jsn1_content_text", lambda s, d: devices(s, d).select("id", text.content_text("content").alias("content_text")), """SELECT 'part-' || p_partkey AS id, lower('{"brand": "' || p_brand || '", "type": "' || p_type || '", "size": ' || p_size || ', "capabilities": ["' || p_type || '"]}') AS content_text FROM part""")
add("jsn2_leaves", lambda s, d: devices(s, d).select("id", F.explode(text.leaves("content")).alias("leaf")).select("id", "leaf.path", "leaf.value"), "SELECT 'part-' || p_partkey AS id, path, value FROM part, (VALUES ('brand'), ('type'), ('capabilities[0]')) t(path), LATERAL (SELECT CASE path WHEN 'brand' THEN p_brand ELSE p_type END AS value)")
add("jsn3_same_content", lambda s, d: devices(s, d).select("id", (F.to_json(F.parse_json("content")) == F.to_json(F.parse_json(merged_content(F.lit("{}"), F.col("content"))))).alias("same"), is_tombstoned(F.col("content")).alias("deleted")), "SELECT 'part-' || p_partkey AS id, true AS same, false AS deleted FROM part")
add("hsh1_digests", lambda s, d: documents(s, d).select("doc_id", F.sha2("text", 256).alias("sha"), F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s", "").alias("encoded"), (F.unbase64(F.base64(F.col("text").cast("binary"))) == F.col("text").cast("binary")).alias("round_trip")), "SELECT doc_id, sha256(text) AS sha, base64(encode(text)) AS encoded, CASE WHEN text IS NOT NULL THEN true END AS round_trip FROM documents")
