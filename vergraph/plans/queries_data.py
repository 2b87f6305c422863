"""Queries on versions, edges, statistics, search and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from vergraph.functions.text import python_tokens, tokens as spark_tokens
from vergraph.functions.values import is_tombstoned, micros, text_field, version_micros
from vergraph.operators import relations, replica, search, similarity, stats, versions as ver
from vergraph.sources import star

from .oracle import PIN, sql, tokens

QUERIES: dict = {}


def add(name, query, text=None):
    QUERIES[name] = (query, text)


def flagged(spark, d):
    """The event versions, the last of each id marked as latest."""
    return ver.with_latest_flag(star.versions(spark, d), F.col("server_seq"))


def current(spark, d):
    return flagged(spark, d).where("is_latest")


def shown(df):
    return df.select("id", "version", "server_seq")


SHOW = "SELECT id, version, server_seq FROM {} "

# sources and projections
add("src1_scan_entities", lambda s, d: star.entities(s, d).select("id", "entity_type", "name", "content"), sql("SELECT * FROM entities", "entities"))
add("src2_load_graph", lambda s, d: current(s, d).where(~is_tombstoned(F.col("content"))).select("id", "version"), sql("SELECT id, version FROM cur WHERE NOT deleted", "cur"))
add("src2_load_edges", lambda s, d: star.graph(s, d).loaded().relationships.groupBy("relationship_type").agg(F.count("*").alias("n")), sql("SELECT relationship_type, count(*) AS n FROM rels WHERE src IN (SELECT id FROM entities) AND dst IN (SELECT id FROM entities) GROUP BY 1", "entities", "rels"))
add("prj1_entity_projection", lambda s, d: flagged(s, d).select("id", "version", "entity_type", "name", "content", "user_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at")), sql("SELECT id, version, entity_type, name, content, user_id, substring(version, 1, 26) AS created_at FROM vers", "vers"))
add("prj2_edge_projection", lambda s, d: star.relationships(s, d).select("id", "from_entity_id", "from_entity_version", "to_entity_id", "relationship_type", "properties"), sql(f"SELECT relationship_type || '|' || src || '|' || dst AS id, src AS from_entity_id, '{PIN}' AS from_entity_version, dst AS to_entity_id, relationship_type, properties FROM rels", "rels"))
add("prj4_wire_changes", lambda s, d: ver.as_change(current(s, d)), sql("SELECT id, version, entity_type, name, content, user_id, CASE WHEN deleted THEN 'delete' ELSE 'update' END AS change_type FROM cur", "cur"))


def _next_version(s, d):
    rows = current(s, d).withColumn("parent_versions", F.array().cast("array<string>"))
    out = ver.new_version(rows, "editor", F.col("created_at"), F.col("server_seq"), F.lit('{"note":"x"}'))
    return out.select("id", "version", F.array_join("parent_versions", ",").alias("parents"), text_field(F.col("content"), "note").alias("note"), text_field(F.col("content"), "kind").alias("kind"))


add("prj9_new_version", _next_version, sql("SELECT id, substring(version, 1, 32) || '-' || lpad(CAST(server_seq AS VARCHAR), 6, '0') || '-editor' AS version, version AS parents, 'x' AS note, user_id AS kind FROM cur", "cur"))

# filters
add("flt1_latest_by_id", lambda s, d: shown(ver.by_id(flagged(s, d), "user-3")), sql(SHOW.format("cur") + "WHERE id = 'user-3'", "cur"))
add("flt2_exact_version", lambda s, d: ver.by_id(flagged(s, d).withColumn("kind", F.col("user_id")), "user-8", "2024-01-01T00:00:07.179575+00:00-000000-error").select("id", "version", "kind"), sql("SELECT id, version, user_id AS kind FROM vers WHERE id = 'user-8' AND version = '2024-01-01T00:00:07.179575+00:00-000000-error'", "vers"))
add("flt3_latest_by_created", lambda s, d: shown(ver.latest_by(star.versions(s, d), F.col("created_at"))), sql(SHOW.format("vers") + "QUALIFY row_number() OVER (PARTITION BY id ORDER BY us DESC) = 1", "vers"))
add("flt4_latest_by_arrival", lambda s, d: shown(ver.latest_by(star.versions(s, d), F.col("server_seq"))), sql(SHOW.format("cur"), "cur"))
add("flt5_latest_by_version", lambda s, d: shown(ver.latest_by(star.versions(s, d), F.col("version"))), sql(SHOW.format("vers") + "WHERE (id, version) IN (SELECT (id, max(version)) FROM vers GROUP BY id)", "vers"))
add("flt6_of_type", lambda s, d: ver.of_type(star.entities(s, d), "zone").select("id", "name"), sql("SELECT id, name FROM entities WHERE entity_type = 'zone'", "entities"))
add("flt7_of_type_ranked", lambda s, d: shown(ver.of_type(star.versions(s, d).withColumn("entity_type", F.col("user_id")), "click", True)), sql(SHOW.format("vers") + "WHERE user_id = 'click' QUALIFY row_number() OVER (PARTITION BY id ORDER BY us DESC, version DESC) = 1", "vers"))
add("flt9_history", lambda s, d: shown(ver.history(star.versions(s, d), "user-3")), sql(SHOW.format("vers") + "WHERE id = 'user-3'", "vers"))
add("flt10_edges_where", lambda s, d: relations.edges_where(star.relationships(s, d), None, "supplier-1", "located_in").select("from_entity_id"), sql("SELECT src AS from_entity_id FROM rels WHERE dst = 'supplier-1' AND relationship_type = 'located_in'", "rels"))
add("flt11_tombstones", lambda s, d: star.versions(s, d).where(is_tombstoned(F.col("content"))).groupBy("id").agg(F.count("*").alias("n")), sql("SELECT id, count(*) AS n FROM vers WHERE deleted GROUP BY 1", "vers"))
add("flt12_name_ilike", lambda s, d: ver.name_contains(star.entities(s, d), "RING").select("id", "name"), sql("SELECT id, name FROM entities WHERE name ILIKE '%RING%'", "entities"))
add("flt14_name_exact", lambda s, d: ver.name_is(star.entities(s, d), "Small Ring").select("id", "name"), sql("SELECT id, name FROM entities WHERE lower(name) = 'small ring'", "entities"))
PROPERTIES = {"brand": "Brand#13", "type": "ECO"}
MATCH = "CASE WHEN p_brand = 'Brand#13' THEN 1.0 WHEN lower(p_brand) LIKE '%brand#13%' THEN 0.5 ELSE 0 END + CASE WHEN p_type = 'ECO' THEN 1.0 WHEN lower(p_type) LIKE '%eco%' THEN 0.5 ELSE 0 END"
add("flt15_property_match", lambda s, d: star.entities(s, d).where("entity_type = 'device'").select("id", search.property_matches(None, PROPERTIES).alias("matches")), f"SELECT 'part-' || p_partkey AS id, CAST({MATCH} AS DOUBLE) AS matches FROM part")
add("flt16_delta_by_cursor", lambda s, d: shown(ver.changed_since(current(s, d), 500)), sql(SHOW.format("cur") + "WHERE server_seq > 500", "cur"))
add("flt17_delta_by_time", lambda s, d: shown(ver.changed_since(star.versions(s, d), None, F.expr("timestamp_ntz'2024-01-01 06:00:00'"))), sql(SHOW.format("vers") + "WHERE us > epoch_us(TIMESTAMP '2024-01-01 06:00:00')", "vers"))
add("flt18_sync_filters", lambda s, d: shown(ver.filtered(star.versions(s, d), ["note"], ["click", "view"])), sql(SHOW.format("vers") + "WHERE user_id IN ('click', 'view')", "vers"))
add("flt20_pending_rows", lambda s, d: shown(replica.with_status(current(s, d), current(s, d).select("id", F.when(F.col("user_id") == "click", "pending").otherwise("synced").alias("sync_status")), ["pending", "conflict"])), sql(SHOW.format("cur") + "WHERE user_id = 'click'", "cur"))
add("flt21_edge_validity", lambda s, d: relations.checked(star.graph(s, d)).groupBy("relationship_type", "valid").agg(F.count("*").alias("n")), sql("SELECT r.relationship_type, v.from_type IS NOT NULL AS valid, count(*) AS n FROM rels r JOIN entities a ON a.id = r.src JOIN entities b ON b.id = r.dst LEFT JOIN valid v ON v.relationship_type = r.relationship_type AND v.from_type = a.entity_type AND v.to_type = b.entity_type GROUP BY 1, 2", "entities", "rels", "valid"))
add("v1_version_parse", lambda s, d: star.versions(s, d).select("version", (version_micros(F.col("version")) - micros("created_at")).alias("off_us")), sql("SELECT version, 0 AS off_us FROM vers", "vers"))

# joins
add("jon1_equi_join", lambda s, d: star.versions(s, d).join(current(s, d).select("id", "version"), ["id", "version"]).select("id", "version", "value"), sql("SELECT v.id, v.version, v.value FROM vers v JOIN cur USING (id, version)", "cur"))
add("jon2_edges_with_endpoints", lambda s, d: relations.with_endpoints(star.KeyedEdges(s, d), star.entities(s, d).withColumn("name", F.md5("name"))).select("id", "from_type", "to_type", "from_name", "to_name"), sql("SELECT relationship_type || '|' || src || '|' || dst AS id, a.entity_type AS from_type, b.entity_type AS to_type, md5(a.name) AS from_name, md5(b.name) AS to_name FROM rels r JOIN entities a ON a.id = r.src JOIN entities b ON b.id = r.dst", "entities", "rels"))


def _moved(s, d):
    """The graph after every tenth part got a new version: its edges keep the old pins."""
    g = star.graph(s, d)
    e = g.entities.withColumn("version", F.when(F.col("id").rlike("^part-[0-9]*0$"), "2025-01-01T00:00:00.000000+00:00-000001-editor").otherwise(F.col("version")))
    return type(g)(e, g.relationships, source=g.source)


add("jon3_pinned_edges", lambda s, d: relations.pinned(_moved(s, d)).groupBy("relationship_type").agg(F.count("*").alias("n")), sql("SELECT relationship_type, count(*) AS n FROM rels WHERE NOT regexp_matches(src, '^part-[0-9]*0$') AND NOT regexp_matches(dst, '^part-[0-9]*0$') GROUP BY 1", "rels"))
add("jon4_existing_edges", lambda s, d: relations.existing_counts(star.KeyedEdges(s, d), star.entities(s, d).where("entity_type <> 'manual'"), ["relationship_type"]), sql("SELECT relationship_type, count(*) AS n FROM rels WHERE relationship_type <> 'documented_by' GROUP BY 1", "rels"))
add("jon5_existing_exact", lambda s, d: relations.existing(star.KeyedEdges(s, d), _moved(s, d).entities, exact=True).agg(F.count("*").alias("n")), sql("SELECT count(*) AS n FROM rels WHERE NOT regexp_matches(src, '^part-[0-9]*0$') AND NOT regexp_matches(dst, '^part-[0-9]*0$')", "rels"))
add("jon9_devices_rooms", lambda s, d: star.graph(s, d).edges(["located_in"]).join(star.entities(s, d).where("entity_type = 'device'").select(F.col("id").alias("src"), "name"), "src").join(star.entities(s, d).where("entity_type = 'room'").select(F.col("id").alias("dst"), F.col("name").alias("room")), "dst").groupBy("room").agg(F.count("*").alias("n_devices"), F.count_distinct("name").alias("n_names")), sql("SELECT b.name AS room, count(*) AS n_devices, count(DISTINCT a.name) AS n_names FROM rels r JOIN entities a ON a.id = r.src AND a.entity_type = 'device' JOIN entities b ON b.id = r.dst AND b.entity_type = 'room' WHERE relationship_type = 'located_in' GROUP BY 1", "entities", "rels"))
add("jon13_latest_view", lambda s, d: current(s, d).select("id", "value"), sql("SELECT v.id, v.value FROM vers v WHERE v.server_seq = (SELECT max(w.server_seq) FROM vers w WHERE w.id = v.id)", "vers"))


def _room_summaries(s, d):
    """Edges are counted by room before they meet the rooms."""
    edges = star.graph(s, d).edges(["located_in", "connects_to"])
    counts = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("relationship_type") == "located_in").alias("inside"))
    rooms = star.entities(s, d).where("entity_type = 'room'").groupBy("id").agg(F.count("*").alias("m"))
    times = lambda c: F.coalesce(F.col("m") * F.col(c), F.lit(0).cast("long"))
    return rooms.join(counts, "id", "left").select("id", times("n").alias("n_edges"), times("inside").alias("n_inside"))


add("jon14_room_summaries", _room_summaries, sql("SELECT e.id, count(r.src) AS n_edges, count(*) FILTER (WHERE r.relationship_type = 'located_in') AS n_inside FROM entities e LEFT JOIN rels r ON r.dst = e.id AND r.relationship_type IN ('located_in', 'connects_to') WHERE e.entity_type = 'room' GROUP BY 1", "entities", "rels"))
add("trv17_connected_pinned", lambda s, d: relations.connected_pinned(star.graph(s, d), "supplier-1").select("id", "name", "relationship_type", "direction"), sql("SELECT b.id, e.name, b.relationship_type, b.direction FROM ways b JOIN entities e ON e.id = b.id WHERE b.at_id = 'supplier-1'", "entities", "ways"))

# aggregates
add("agg1_type_counts", lambda s, d: stats.type_counts(star.graph(s, d)), sql("SELECT 'entity' AS what, entity_type AS type, count(*) AS n FROM entities GROUP BY 2 UNION ALL SELECT 'relationship', relationship_type, count(*) FROM rels GROUP BY 2", "entities", "rels"))
ENDS = "(SELECT count(*) FROM (SELECT src FROM rels UNION SELECT dst FROM rels))"
add("agg1_statistics", lambda s, d: stats.statistics(star.graph(s, d)).drop("average_degree_rounded"), sql(f"SELECT (SELECT count(*) FROM entities) AS total_entities, (SELECT count(*) FROM rels) AS total_relationships, 2 * (SELECT count(*) FROM rels) / (SELECT count(*) FROM entities) AS average_degree, (SELECT count(*) FROM entities) - {ENDS} AS isolated_entities", "entities", "rels"))
add("agg2_index_statistics", lambda s, d: stats.index_statistics(star.graph(s, d)), sql("SELECT (SELECT count(*) FROM entities) AS total_entities, (SELECT count(*) FROM rels) AS total_relationships, 2 * (SELECT count(*) FROM rels) / (SELECT count(*) FROM entities) AS average_degree, (SELECT count(*) FROM entities WHERE id NOT IN (SELECT src FROM rels) AND id NOT IN (SELECT dst FROM rels)) AS isolated_entities", "entities", "rels"))
add("agg3_replica_statistics", lambda s, d: stats.statistics(star.graph(s, d), clamp=True).select("total_entities", "isolated_entities"), sql(f"SELECT count(*) AS total_entities, greatest(0, count(*) - {ENDS}) AS isolated_entities FROM entities", "entities", "rels"))
add("agg4_marker", lambda s, d: stats.generation_marker(star.versions(s, d)).select("max_seq", "n_rows", micros("newest").alias("newest_us")), sql("SELECT max(server_seq) AS max_seq, count(*) AS n_rows, max(us) AS newest_us FROM vers", "vers"))


def _appended(s, d):
    """The last tenth of all events arrives as one batch on a store that holds the others, and a few of these again."""
    v = star.versions(s, d)
    last = v.agg(F.max("server_seq").alias("m"))
    v = v.crossJoin(last)  # one row
    stored = ver.with_latest_flag(v.where("server_seq <= m - floor(m / 10)"), F.col("server_seq")).drop("m")
    new = v.where("server_seq > m - floor(m / 10) - 10").withColumn("pos", F.col("server_seq")).drop("m", "server_seq")
    return ver.append_versions(stored, new).groupBy("id").agg(F.count("*").alias("n"), F.max("server_seq").alias("max_seq"), F.max_by("version", F.when(F.col("is_latest"), F.col("server_seq"))).alias("latest"), F.count_if(F.col("is_latest")).alias("n_latest"))


add("agg5_append_versions", _appended, sql("SELECT v.id, count(*) AS n, max(v.server_seq) AS max_seq, max(c.version) AS latest, 1 AS n_latest FROM vers v JOIN cur c USING (id) GROUP BY 1", "cur"))
DIGEST = "SELECT sha256(string_agg(concat(id, chr(31), version, chr(30)), '' ORDER BY id)) AS digest, count(*) AS n_entities FROM cur"
add("agg6_state_digest", lambda s, d: stats.state_digest(current(s, d)), sql(DIGEST, "cur"))
add("agg7_max_version", lambda s, d: star.versions(s, d).groupBy("id").agg(F.max("version").alias("version")), sql("SELECT id, max(version) AS version FROM vers GROUP BY 1", "vers"))
add("agg8_backfill", lambda s, d: ver.backfilled(star.versions(s, d).drop("server_seq")).select("id", "version", "is_latest", "server_seq"), sql("SELECT id, version, version = max(version) OVER (PARTITION BY id) AS is_latest, row_number() OVER (ORDER BY us, version) AS server_seq FROM vers", "vers"))
add("agg9_like_residue", lambda s, d: stats.like_residue(star.versions(s, d), "version", "%error%"), sql("SELECT count(*) AS n_rows, count(*) FILTER (WHERE version LIKE '%error%') AS n_matching FROM vers", "vers"))
add("agg10_page", lambda s, d: ver.page(star.entities(s, d).where("entity_type = 'device'").select("id", "name"), ["id"], 20, 40), sql("SELECT id, name FROM entities WHERE entity_type = 'device' ORDER BY id LIMIT 20 OFFSET 40", "entities"))
add("agg11_connected_ids", lambda s, d: star.graph(s, d).edges().select(F.col("src").alias("id")).union(star.graph(s, d).edges().select("dst")).distinct(), sql("SELECT src AS id FROM rels UNION SELECT dst FROM rels", "rels"))
add("set3_unconnected", lambda s, d: star.entities(s, d).select("id").exceptAll(star.graph(s, d).edges().select("src").distinct()), sql("SELECT id FROM entities EXCEPT SELECT src FROM rels", "entities", "rels"))


def _outcomes(s, d):
    e = star.table(s, d, "events")
    return e.select(F.col("user_id").alias("client_id"), micros("ts").alias("at_us"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") == "click", 1).otherwise(0).alias("conflicts"))


add("agg13_sync_counters", lambda s, d: stats.sync_counters(_outcomes(s, d)), "WITH g AS (SELECT user_id AS client_id, max(epoch_us(ts)) FILTER (WHERE event_type <> 'error') AS last_success_us FROM events GROUP BY 1) SELECT client_id, last_success_us, count(*) AS total_syncs, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS total_conflicts, count(*) FILTER (WHERE event_type = 'error' AND epoch_us(ts) > coalesce(last_success_us, -1)) AS sync_failures FROM events JOIN g ON g.client_id = events.user_id GROUP BY 1, 2")
add("agg15_checksums", lambda s, d: star.table(s, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum")), "SELECT doc_id, sha256(coalesce(text, '')) AS checksum FROM documents")

# search
DEVICES = "(SELECT 'part-' || p_partkey AS id, p_name AS name, p_brand, p_type FROM part)"


def _engine_sql(query: str, least: str, limit: int = 10) -> str:
    own = python_tokens(query)
    n, wanted = max(1, len(own)), "[" + ", ".join(f"'{t}'" for t in own) + "]::VARCHAR[]"
    part = lambda c, hit, each: f"CASE WHEN contains(lower({c}), '{query.lower()}') THEN {hit} ELSE {each} * len(list_intersect({tokens(c)}, {wanted})) / {n} END"
    kind = 1.0 if any(t in "device" for t in own) else 0.0
    score = f"{part('name', 3.0, 2.0)} + {kind} + {part('p_brand', 1.5, 1.0)} + 2 * ({part('p_type', 1.5, 1.0)})"
    return f"SELECT id, name, round(CAST(score AS DOUBLE), 9) AS score FROM (SELECT id, name, {score} AS score FROM {DEVICES}) WHERE score >= {least} ORDER BY score DESC, id LIMIT {limit}"


def ranked(df, *more):
    return df.select("id", *more, F.round(F.col("score").cast("double"), 9).alias("score"))


def devices(s, d):
    return star.entities(s, d).where("entity_type = 'device'")


add("sch3_scores", lambda s, d: ranked(search.score_engine(devices(s, d), "cold ring"), "name"), _engine_sql("cold ring", "-1", 10**9))
add("sch4_tokens", lambda s, d: star.entities(s, d).where("entity_type in ('zone', 'device')").select("id", F.array_join(F.array_sort(spark_tokens(F.concat_ws(" ", F.col("name"), F.lit("THE Of widget_7 a-b"), F.col("id")))), ",").alias("tokens")), sql(f"SELECT id, array_to_string(list_sort({tokens("concat_ws(' ', name, 'THE Of widget_7 a-b', id)")}), ',') AS tokens FROM entities WHERE entity_type IN ('zone', 'device')", "entities"))
add("sch5_full_text", lambda s, d: ranked(search.search_engine(star.entities(s, d), "small ring", ["device"]), "name"), _engine_sql("small ring", "0.1"))
add("sch5_stop_words", lambda s, d: ranked(search.search_engine(star.entities(s, d), "the of", ["device"]), "name"), _engine_sql("the of", "0.1"))
add("sch5_blank", lambda s, d: ranked(search.search_engine(star.entities(s, d), "  ", ["device"]), "name"), f"SELECT id, name, 0.0::DOUBLE AS score FROM {DEVICES} WHERE false")
add("sch6_properties", lambda s, d: ranked(search.search_properties(star.entities(s, d), PROPERTIES, ["device"])), f"SELECT id, CAST(m / 2 AS DOUBLE) AS score FROM (SELECT 'part-' || p_partkey AS id, {MATCH} AS m FROM part) WHERE m > 0 ORDER BY score DESC, id LIMIT 10")
NEAR = "near AS (SELECT id, min(distance) AS distance FROM (SELECT id, 1 AS distance FROM ways WHERE at_id = 'supplier-1' UNION ALL SELECT b.id, 2 FROM ways a JOIN ways b ON b.at_id = a.id WHERE a.at_id = 'supplier-1' AND a.id <> 'supplier-1') GROUP BY 1)"
QUERY7 = "CASE WHEN contains(lower(name), 'small ring') THEN 3.0 ELSE 2.0 * len(list_intersect(" + tokens("name") + ", ['ring', 'small'])) / 2 END + CASE WHEN p_type IS NULL THEN 0 WHEN contains(lower(p_type), 'small ring') THEN 3.0 ELSE 2.0 * len(list_intersect(" + tokens("p_type") + ", ['ring', 'small'])) / 2 END"
add("sch7_connected", lambda s, d: ranked(search.search_connected(star.graph(s, d), "small ring", "supplier-1"), "distance"), sql(f"SELECT id, distance, round(CAST(score * (1 + 1 / (distance + 1)) AS DOUBLE), 9) AS score FROM (SELECT e.id, distance, {QUERY7} AS score FROM near JOIN entities e USING (id) LEFT JOIN part ON 'part-' || p_partkey = e.id) WHERE score > 0 ORDER BY score DESC, id LIMIT 10", "entities", "ways", recursive=NEAR))


add("sch8_names", lambda s, d: search.search_names(star.versions(s, d), "user 1", None, 5).select("id", "version"), sql("SELECT id, version FROM (SELECT * FROM (SELECT * FROM vers WHERE name ILIKE '%user 1%' ORDER BY us DESC, id, version LIMIT 15) QUALIFY row_number() OVER (PARTITION BY id ORDER BY us DESC, version) = 1) ORDER BY us DESC, id LIMIT 5", "vers"))
add("sch10_replica", lambda s, d: search.search_replica(star.entities(s, d), "brand#13", ["device"]).select("id"), f"SELECT id FROM {DEVICES} WHERE contains(lower(name), 'brand#13') OR contains(lower(p_brand), 'brand#13')")
add("sch11_replica_ranked", lambda s, d: ranked(search.search_replica_ranked(devices(s, d), "ring", 10)), f"SELECT id, CAST(CASE WHEN lower(name) = 'ring' THEN 2.0 WHEN contains(lower(name), 'ring') THEN 1.5 ELSE 1.0 END AS DOUBLE) AS score FROM {DEVICES} WHERE contains(lower(name), 'ring') ORDER BY id LIMIT 10")
add("sch12_replica_scores", lambda s, d: ranked(search.top(search.score_replica(devices(s, d), "small ring", 1.0, 0.5), 10)), f"SELECT id, CAST(CASE WHEN lower(name) = 'small ring' THEN 2.0 WHEN contains(lower(name), 'small ring') THEN 1.0 ELSE 0.5 END AS DOUBLE) AS score FROM {DEVICES} ORDER BY score DESC, id LIMIT 10")
SHARED = "CASE WHEN contains(lower(name), 'small ring') THEN 3.0 ELSE 1.5 * (CAST(contains(lower(name), 'small') AS INT) + CAST(contains(lower(name), 'ring') AS INT)) END"
add("sch1_shared_scores", lambda s, d: ranked(search.score_shared(devices(s, d), "small ring", fuzzy=False)), f"SELECT id, CAST(({SHARED} + 0.5 * (CAST(contains(lower(p_type), 'small') AS INT) + CAST(contains(lower(p_type), 'ring') AS INT))) * CASE WHEN lower(name) = 'small ring' THEN 2 ELSE 1 END AS DOUBLE) AS score FROM {DEVICES}")
add("sch2_shared_ranked", lambda s, d: ranked(search.search_shared(devices(s, d), "smal ring", 10)))
add("sch9_names_ranked", lambda s, d: ranked(search.search_names_ranked(star.versions(s, d), "user 1", 5)))

# similarity
SET = f"list_distinct(list_concat({tokens('name')}, ['device'], {tokens('p_brand')}, {tokens('p_type')}))"
JAC = f"SELECT id, round(0.3 + 0.7 * len(list_intersect(s, r)) / len(list_distinct(list_concat(s, r))), 9) AS score FROM (SELECT id, {SET} AS s FROM {DEVICES}), (SELECT {SET} AS r FROM {DEVICES} WHERE id = 'part-0')"
add("sim2_engine", lambda s, d: ranked(similarity.similar_engine(devices(s, d), "part-0")), f"SELECT id, CAST(score AS DOUBLE) AS score FROM ({JAC}) WHERE id <> 'part-0' AND score >= 0.7 ORDER BY score DESC, id LIMIT 10")
add("sim4_replica", lambda s, d: ranked(similarity.similar_replica(devices(s, d), "part-0", 10)), f"SELECT id, round(CAST(0.5 + len(list_intersect(w, r)) / greatest(len(w), len(r)) AS DOUBLE), 9) AS score FROM (SELECT id, list_distinct(string_split(lower(name), ' ')) AS w FROM {DEVICES}), (SELECT list_distinct(string_split(lower(name), ' ')) AS r FROM {DEVICES} WHERE id = 'part-0') WHERE id <> 'part-0' ORDER BY score DESC, id LIMIT 10")
add("sim1_shared", lambda s, d: ranked(similarity.similar_shared(devices(s, d), "part-0")))
add("sim3_name_score", lambda s, d: ranked(similarity.similar_by_name_score(devices(s, d), "part-0", "small ring")))
