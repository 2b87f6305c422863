"""Queries on traversal and the domain tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from vergraph.operators import cycles, tools, traverse
from vergraph.sources import star

from .oracle import sql
from .queries_data import _engine_sql

QUERIES: dict = {}


def add(name, query, text=None):
    QUERIES[name] = (query, text)


def graph(s, d):
    return star.graph(s, d)


def reach(start: str, depth: int, condition: str = "true", steps: str = "rels") -> str:
    """Ids and their least number of hops, in SQL."""
    return f"reach AS (SELECT '{start}' AS id, 0 AS depth UNION SELECT r.dst, reach.depth + 1 FROM reach JOIN {steps} r ON r.src = reach.id WHERE reach.depth < {depth} AND ({condition}))"


def reached(start: str, depth: int, condition: str = "true", least: int = 0) -> str:
    return sql(f"SELECT id, min(depth) AS depth FROM reach GROUP BY id HAVING min(depth) >= {least}", "rels", recursive=reach(start, depth, condition))


add("trv1_bfs_1", lambda s, d: traverse.bfs(graph(s, d), "part-7", 1), reached("part-7", 1))
add("trv1_bfs_3", lambda s, d: traverse.bfs(graph(s, d), "part-7", 3), reached("part-7", 3))
add("trv1_bfs_all", lambda s, d: traverse.bfs(graph(s, d), "order-0"), reached("order-0", 12))
add("trv1_bfs_types", lambda s, d: traverse.bfs(graph(s, d), "part-7", None, ["located_in", "part_of"]), reached("part-7", 8, "relationship_type IN ('located_in', 'part_of')"))
#: Two levels of a walk from part-7 with the order of visits: by the parent's rank, then by the edge's id.
ORDERED = """e AS (SELECT src, dst, relationship_type || '|' || src || '|' || dst AS rel FROM rels),
l0 AS (SELECT 'part-7' AS id, 0 AS depth, CAST(0 AS BIGINT) AS bfs_rank),
s1 AS (SELECT dst AS id, min((bfs_rank, rel)) AS k FROM e JOIN l0 ON src = id WHERE dst NOT IN (SELECT id FROM l0) GROUP BY dst),
l1 AS (SELECT id, 1 AS depth, (SELECT count(*) FROM l0) + row_number() OVER (ORDER BY k) - 1 AS bfs_rank FROM s1),
s2 AS (SELECT dst AS id, min((bfs_rank, rel)) AS k FROM e JOIN l1 ON src = id WHERE dst NOT IN (SELECT id FROM l0 UNION SELECT id FROM l1) GROUP BY dst),
l2 AS (SELECT id, 2 AS depth, (SELECT count(*) FROM l0) + (SELECT count(*) FROM l1) + row_number() OVER (ORDER BY k) - 1 AS bfs_rank FROM s2),
walk AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)"""
add("trv1_bfs_ranked", lambda s, d: traverse.bfs_ranked(graph(s, d), "part-7", 2), sql("SELECT id, depth, bfs_rank FROM walk", "rels", recursive=ORDERED))
# the walk ends with the first zone that it comes to
ZONES = "(SELECT min(bfs_rank) FROM walk WHERE id LIKE 'nation-%')"
add("trv1_bfs_visit", lambda s, d: traverse.bfs_ranked(graph(s, d), "part-7", 2, None, lambda e: e.entity_type != "zone"), sql(f"SELECT id, depth, bfs_rank FROM walk WHERE {ZONES} IS NULL OR bfs_rank <= {ZONES}", "rels", recursive=ORDERED))
add("trv2_dfs", lambda s, d: traverse.dfs(graph(s, d), "part-7").select("id"), sql("SELECT DISTINCT id FROM reach", "rels", recursive=reach("part-7", 12)))
# over a type without cycles, pre-order is the order of the least path of edge ids to each node
CHAINS = "p AS (SELECT 'nation-0' AS id, CAST([] AS VARCHAR[]) AS k UNION ALL SELECT r.dst, list_append(k, relationship_type || '|' || src || '|' || dst) FROM p JOIN (SELECT * FROM rels WHERE relationship_type IN ('part_of', 'located_in')) r ON r.src = p.id)"
PRE = "SELECT id, CAST(row_number() OVER (ORDER BY k) - 1 AS INT) AS dfs_rank, len(k) AS depth FROM (SELECT id, min(k) AS k FROM {0} GROUP BY id)"
DFS = CHAINS.replace("nation-0", "part-7")
add("trv2_dfs_ranked", lambda s, d: traverse.dfs(graph(s, d), "part-7", None, ["located_in", "part_of"]).select("id", "dfs_rank", F.col("depth").cast("long").alias("depth")), sql(PRE.format("p"), "rels", recursive=DFS))
STOP = f"w AS ({PRE.format('p')})"
add("trv2_dfs_visit", lambda s, d: traverse.dfs(graph(s, d), "part-7", None, ["located_in", "part_of"], lambda e: e.entity_type != "zone").select("id", "dfs_rank"), sql("SELECT id, dfs_rank FROM w WHERE dfs_rank <= (SELECT min(dfs_rank) FROM w WHERE id LIKE 'nation-%')", "rels", recursive=f"{DFS}, {STOP}"))
PATHS = "paths AS (SELECT ['{0}'] AS path, '{0}' AS last UNION ALL SELECT list_append(path, r.dst), r.dst FROM paths JOIN (SELECT DISTINCT src, dst FROM rels) r ON r.src = last WHERE len(path) < {1} AND last <> '{2}' AND NOT list_contains(path, r.dst))"
add("trv3_all_paths", lambda s, d: traverse.all_paths(graph(s, d), "nation-0", "nation-20", 5).select(F.array_join("path", ">").alias("path"), "length"), sql("SELECT array_to_string(path, '>') AS path, len(path) AS length FROM paths WHERE last = 'nation-20'", "rels", recursive=PATHS.format("nation-0", 5, "nation-20")))
add("trv3_all_paths_up", lambda s, d: traverse.all_paths(graph(s, d), "part-7", "region-1", 4).select(F.array_join("path", ">").alias("path"), "length"), sql("SELECT array_to_string(path, '>') AS path, len(path) AS length FROM paths WHERE last = 'region-1'", "rels", recursive=PATHS.format("part-7", 4, "region-1")))
add("trv4_hierarchy", lambda s, d: traverse.hierarchy(graph(s, d), "automates", True).groupBy("src").agg(F.count("*").alias("n")), sql("SELECT dst AS src, count(*) AS n FROM rels WHERE relationship_type = 'automates' GROUP BY 1", "rels"))
add("trv6_ancestors", lambda s, d: traverse.ancestors(graph(s, d), "part-7", "located_in"), reached("part-7", 5, "relationship_type = 'located_in'", 1))
add("trv6_ancestors_depth", lambda s, d: traverse.ancestors(graph(s, d), "part-7", "located_in", 1), reached("part-7", 1, "relationship_type = 'located_in'", 1))
DOWN = sql("SELECT id, min(depth) AS depth FROM reach GROUP BY id HAVING min(depth) >= 1", "rels", recursive="turned AS (SELECT dst AS src, src AS dst FROM rels WHERE relationship_type = 'located_in'), " + reach("nation-0", 5, "true", "turned"))
add("trv7_descendants", lambda s, d: traverse.descendants(graph(s, d), "nation-0", "located_in"), DOWN)
add("trv8_cycle_exists", lambda s, d: cycles.cyclic_nodes(graph(s, d)), "SELECT 'nation-' || n_nationkey AS id FROM nation")
add("trv8_components", lambda s, d: cycles.strong_components(graph(s, d)), "SELECT 'nation-' || n_nationkey AS id, min('nation-' || n_nationkey) OVER (PARTITION BY n_regionkey) AS component FROM nation")
# a ring of nations in each region is all that is closed
RINGS = "paths AS (SELECT ['nation-' || n_nationkey] AS path, 'nation-' || n_nationkey AS last FROM nation UNION ALL SELECT list_append(path, r.dst), r.dst FROM paths JOIN rels r ON r.src = last WHERE r.dst > path[1] AND NOT list_contains(path, r.dst))"
add("trv8_detect_cycles", lambda s, d: cycles.detect_cycles(graph(s, d)).select(F.array_join("cycle", ">").alias("cycle")), sql("SELECT array_to_string(list_append(path, path[1]), '>') AS cycle FROM paths JOIN rels r ON r.src = last AND r.dst = path[1]", "rels", recursive=RINGS))
add("trv8_cycles_from", lambda s, d: cycles.detect_cycles(graph(s, d), "part-7", ["connects_to", "located_in"]).select(F.array_join("cycle", ">").alias("cycle")), sql("SELECT array_to_string(list_append(path, path[1]), '>') AS cycle FROM paths JOIN rels r ON r.src = last AND r.dst = path[1] WHERE path[1] IN (SELECT id FROM reach)", "rels", recursive=RINGS + ", " + reach("part-7", 12, "relationship_type IN ('connects_to', 'located_in')")))
add("trv9_cycles_through", lambda s, d: traverse.cycles_through(graph(s, d), "nation-0", 5).select(F.array_join("cycle", ">").alias("cycle")), sql("SELECT array_to_string(list_append(path, 'nation-0'), '>') AS cycle FROM paths JOIN (SELECT DISTINCT src, dst FROM rels) r ON r.src = last AND r.dst = 'nation-0' WHERE len(path) > 2", "rels", recursive=PATHS.format("nation-0", 5, "nation-0").replace(" AND last <> 'nation-0'", "")))
ENDS = "SELECT id, count(r) FILTER (WHERE o) AS out_degree, count(r) FILTER (WHERE NOT o) AS in_degree, count(r) AS degree FROM entities LEFT JOIN (SELECT src AS id, true AS o, 1 AS r FROM rels UNION ALL SELECT dst, false, 1 FROM rels) USING (id) GROUP BY id"
add("trv11_degrees", lambda s, d: traverse.degrees(graph(s, d)), sql(ENDS, "entities", "rels"))
add("trv10_centrality", lambda s, d: traverse.degrees(graph(s, d)).where("id = 'supplier-1'").select("id", F.col("degree").cast("double").alias("centrality")), sql("SELECT 'supplier-1' AS id, CAST(count(*) FILTER (WHERE src = 'supplier-1') + count(*) FILTER (WHERE dst = 'supplier-1') AS DOUBLE) AS centrality FROM rels", "rels"))
add("trv12_path_length", lambda s, d: traverse.find_path(graph(s, d), "order-0", "region-2").select("length"), sql("SELECT min(depth) AS length FROM reach WHERE id = 'region-2' HAVING count(*) > 0", "rels", recursive=reach("order-0", 10)))
add("trv13_path_hops", lambda s, d: traverse.find_path(graph(s, d), "order-0", "nation-3", 5).select(F.element_at("path", 1).alias("first"), F.element_at("path", -1).alias("last"), "length"), sql("SELECT 'order-0' AS first, 'nation-3' AS last, min(depth) AS length FROM reach WHERE id = 'nation-3' HAVING count(*) > 0", "rels", recursive=reach("order-0", 5)))
add("trv14_no_path", lambda s, d: traverse.find_path(graph(s, d), "region-0", "part-7", 9).select("length"), "SELECT 0 AS length WHERE false")
add("trv16_connected_1", lambda s, d: traverse.connected(graph(s, d), "supplier-1").select("id", "rel", "direction", "distance"), sql("SELECT id, CASE direction WHEN 'outgoing' THEN relationship_type || '|' || at_id || '|' || id ELSE relationship_type || '|' || id || '|' || at_id END AS rel, direction, 1 AS distance FROM ways WHERE at_id = 'supplier-1'", "ways"))
add("trv16_connected_2", lambda s, d: traverse.connected(graph(s, d), "nation-0", "connects_to", "outgoing", 2).select("id", "distance"), sql("SELECT id, 1 AS distance FROM ways WHERE at_id = 'nation-0' AND direction = 'outgoing' AND relationship_type = 'connects_to' UNION ALL SELECT b.id, 2 FROM (SELECT DISTINCT id FROM ways WHERE at_id = 'nation-0' AND direction = 'outgoing' AND relationship_type = 'connects_to' AND id <> 'nation-0') a JOIN ways b ON b.at_id = a.id AND b.direction = 'outgoing' AND b.relationship_type = 'connects_to'", "ways"))
add("trv16_connected_both_2", lambda s, d: traverse.connected(graph(s, d), "nation-0", None, "both", 2).groupBy("direction", "distance").agg(F.count("*").alias("n")), sql("SELECT direction, 1 AS distance, count(*) AS n FROM ways WHERE at_id = 'nation-0' GROUP BY 1 UNION ALL SELECT b.direction, 2, count(*) FROM (SELECT DISTINCT id FROM ways WHERE at_id = 'nation-0' AND id <> 'nation-0') a JOIN ways b ON b.at_id = a.id GROUP BY 1", "ways"))
add("trv18_subgraph_nodes", lambda s, d: traverse.subgraph(graph(s, d), "part-7", 1)[0], sql("SELECT 'part-7' AS id, 0 AS depth UNION SELECT id, 1 FROM ways WHERE at_id = 'part-7'", "ways"))
add("trv18_subgraph_edges", lambda s, d: traverse.subgraph(graph(s, d), "part-7", 2)[1].groupBy("relationship_type").agg(F.count("*").alias("n")), sql("SELECT relationship_type, count(*) AS n FROM (SELECT DISTINCT relationship_type, src, dst FROM rels WHERE src IN (SELECT id FROM ways WHERE at_id = 'part-7' UNION SELECT 'part-7') OR dst IN (SELECT id FROM ways WHERE at_id = 'part-7' UNION SELECT 'part-7')) GROUP BY 1", "ways"))
add("trv19_induced", lambda s, d: traverse.induced(graph(s, d), star.entities(s, d).where("entity_type in ('zone', 'room')").select("id")).groupBy("relationship_type").agg(F.count("*").alias("n")), sql("SELECT relationship_type, count(*) AS n FROM rels WHERE regexp_matches(src, '^(nation|supplier|customer)-') AND regexp_matches(dst, '^(nation|supplier|customer)-') GROUP BY 1", "rels"))

add("tol1_devices_in_room", lambda s, d: tools.devices_in_room(graph(s, d), "supplier-1"), "SELECT DISTINCT 'part-' || p_partkey AS id, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = 1")
add("tol2_device_controls", lambda s, d: tools.device_controls(graph(s, d), "part-7").select("id", F.array_join("capabilities", ",").alias("capabilities"), F.size("services").alias("n_services"), F.size("controls").alias("n_controls")), "SELECT 'part-' || p_partkey AS id, p_type AS capabilities, 0 AS n_services, 0 AS n_controls FROM part WHERE p_partkey = 7")
add("tol3_room_connections", lambda s, d: tools.room_connections(graph(s, d), "supplier-1"), "SELECT 'customer-' || c_custkey AS id, c_name AS name, 'lane-1' AS via FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 10 = s_suppkey % 10 WHERE s_suppkey = 1")
add("tol4_search", lambda s, d: tools.call(graph(s, d), "search_entities", query="small ring", entity_types=["device"], limit=5).select("id", "name"), f"SELECT id, name FROM ({_engine_sql('small ring', '0.1', 5)})")
add("tol6_relationship_check", lambda s, d: tools.checked_relationship(graph(s, d), "part-7", "supplier-3", "located_in").select("from_entity_id", "to_entity_id").union(tools.checked_relationship(graph(s, d), "supplier-3", "part-7", "located_in").select("from_entity_id", "to_entity_id")), "SELECT 'part-7' AS from_entity_id, 'supplier-3' AS to_entity_id")
add("tol7_path", lambda s, d: tools.path_between(graph(s, d), "order-0", "region-0").select("found", "length"), sql("SELECT count(*) > 0 AS found, coalesce(min(depth), 0) AS length FROM reach WHERE id = 'region-0'", "rels", recursive=reach("order-0", 10)))
add("tol7_path_missing", lambda s, d: tools.path_between(graph(s, d), "region-0", "part-7").select("found", "length"), "SELECT false AS found, 0 AS length")
add("tol8_details", lambda s, d: tools.entity_details(graph(s, d), "part-7").select("id", "name", "entity_type", "version_count", F.size("outgoing").alias("n_out"), F.size("incoming").alias("n_in")), sql("SELECT 'part-7' AS id, p_name AS name, 'device' AS entity_type, 1 AS version_count, (SELECT count(*) FROM rels WHERE src = 'part-7') AS n_out, (SELECT count(*) FROM rels WHERE dst = 'part-7') AS n_in FROM part WHERE p_partkey = 7", "rels"))
add("tol10_procedures", lambda s, d: tools.procedures_for_device(graph(s, d), "part-7"), "SELECT 'manual' AS kind, 'doc-' || doc_id AS id, coalesce(text, '') AS name FROM documents WHERE doc_id = 7 % (SELECT count(*) FROM documents)")
add("tol11_automations", lambda s, d: tools.automations_in_room(graph(s, d), "supplier-1").select("id", "name", F.array_join("affected", ",").alias("affected")), "SELECT 'order-' || o_orderkey AS id, o_orderpriority AS name, string_agg(DISTINCT 'part-' || l_partkey, ',' ORDER BY 'part-' || l_partkey) AS affected FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1) GROUP BY 1, 2")
add("tol12_update", lambda s, d: tools.updated_entity(graph(s, d), "part-7", '{"size":99,"room":"x"}', "me", F.expr("timestamp_ntz'2025-01-01 00:00:00'")).select("id", "version", F.get_json_object("content", "$.size").alias("size"), F.get_json_object("content", "$.brand").alias("brand"), F.get_json_object("content", "$.room").alias("room"), F.size("parent_versions").alias("n_parents")), "SELECT 'part-7' AS id, '2025-01-01T00:00:00.000000+00:00-000000-me' AS version, '99' AS size, p_brand AS brand, 'x' AS room, 1 AS n_parents FROM part WHERE p_partkey = 7")
