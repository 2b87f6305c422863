"""Golden results on a small house and on chains and rings."""

import random

import pytest
from pyspark.sql import functions as F

from vergraph.operators import cycles, relations, search, similarity, stats, tools, traverse
from vergraph.plans.graph import Graph

NODES = [
    ("home-1", "home", "Test Home", '{"address": "123 Test St"}'),
    ("room-kitchen", "room", "Kitchen", '{"floor": 1}'),
    ("room-hall", "room", "Hallway", '{"floor": 1}'),
    ("room-living", "room", "Living Room", '{"floor": 1}'),
    ("device-light", "device", "Kitchen Light", '{"manufacturer": "TestCorp", "capabilities": ["on_off", "brightness"], "services": ["lightbulb"]}'),
    ("device-hub", "device", "Smart Hub", '{"manufacturer": "TestCorp", "capabilities": ["bridge"]}'),
    ("automation-1", "automation", "Evening Lights", '{"enabled": true}'),
    ("procedure-1", "procedure", "Reset Kitchen Light", '{"steps": ["hold button", "release"]}'),
    ("manual-1", "manual", "Kitchen Light Manual", '{"pages": 12}'),
    ("note-1", "note", "Orphan Note", '{"text": "nothing"}'),
]
EDGES = [
    ("room-kitchen", "located_in", "home-1", "{}"),
    ("room-hall", "located_in", "home-1", "{}"),
    ("room-living", "located_in", "home-1", "{}"),
    ("device-light", "located_in", "room-kitchen", "{}"),
    ("device-hub", "located_in", "room-living", "{}"),
    ("device-hub", "controls", "device-light", "{}"),
    ("room-kitchen", "connects_to", "room-hall", '{"via": "doorway"}'),
    ("room-hall", "connects_to", "room-living", '{"via": "archway"}'),
    ("automation-1", "automates", "device-light", "{}"),
    ("procedure-1", "procedure_for", "device-light", "{}"),
    ("device-light", "documented_by", "manual-1", "{}"),
]


def build(spark, nodes, edges):
    e = spark.createDataFrame([(n[0], "v1", *n[1:], True) for n in nodes], "id string, version string, entity_type string, name string, content string, is_latest boolean")
    rows = [(f"{i:03d}", a, "v1", b, "v1", t, p, i) for i, (a, t, b, p) in enumerate(edges)]
    r = spark.createDataFrame(rows, "id string, from_entity_id string, from_entity_version string, to_entity_id string, to_entity_version string, relationship_type string, properties string, rel_ord long")
    return Graph(e, r)


@pytest.fixture(scope="module")
def house(spark):
    return build(spark, NODES, EDGES)


def rows(df):
    return sorted(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect())


def test_paths(house):
    found = {tuple(r["path"]) for r in traverse.all_paths(house, "room-kitchen", "home-1").collect()}
    assert found == {("room-kitchen", "home-1"), ("room-kitchen", "room-hall", "home-1"), ("room-kitchen", "room-hall", "room-living", "home-1")}
    assert traverse.all_paths(house, "device-hub", "home-1").count() == 3
    assert traverse.all_paths(house, "device-hub", "home-1", 6).count() == 4
    assert rows(traverse.all_paths(house, "note-1", "note-1").select("path")) == [(("note-1",),)]


def test_shortest_path(house):
    assert traverse.find_path(house, "device-hub", "home-1").first()["length"] == 2
    assert traverse.find_path(house, "home-1", "device-hub").count() == 0
    assert traverse.find_path(house, "note-1", "note-1").first()["path"] == ["note-1"]


def test_walks(house):
    assert {r["id"]: r["depth"] for r in traverse.bfs(house, "automation-1").collect()} == {"automation-1": 0, "device-light": 1, "room-kitchen": 2, "manual-1": 2, "home-1": 3, "room-hall": 3, "room-living": 4}
    assert [r["id"] for r in traverse.dfs(house, "device-light").orderBy("dfs_rank").collect()] == ["device-light", "room-kitchen", "home-1", "room-hall", "room-living", "manual-1"]
    assert [r["id"] for r in traverse.bfs_ranked(house, "device-light", 3).orderBy("bfs_rank").collect()] == ["device-light", "room-kitchen", "manual-1", "home-1", "room-hall", "room-living"]
    assert traverse.bfs(house, "missing").count() == 0


def test_hierarchy(house):
    assert rows(traverse.ancestors(house, "device-light", "located_in")) == [("home-1", 2), ("room-kitchen", 1)]
    down = {r["id"] for r in traverse.descendants(house, "home-1", "located_in").collect()}
    assert down == {"room-kitchen", "room-hall", "room-living", "device-light", "device-hub"}
    assert traverse.ancestors(house, "device-light", "located_in", 0).count() == 0
    for x in down:
        assert "home-1" in {r["id"] for r in traverse.ancestors(house, x, "located_in").collect()}


def test_statistics(house):
    s = stats.statistics(house).first()
    assert (s["total_entities"], s["total_relationships"], s["average_degree"], s["isolated_entities"]) == (10, 11, 2.2, 1)
    assert stats.index_statistics(house).first()["isolated_entities"] == 1


@pytest.mark.parametrize(("query", "score"), [("kitchen light", 7.0), ("kitchen", 3.0), ("light kitchen", 3.0), ("kitchen bedroom", 1.5)])
def test_shared_scorer(house, query, score):
    plain = house.latest().where("id = 'device-light'").withColumn("content", F.lit("{}"))
    assert search.score_shared(plain, query).first()["score"] == pytest.approx(score, abs=1e-9)


def test_shared_scorer_content(house):
    one = search.score_shared(house.latest().where("id = 'device-light'"), "kitchen light", fuzzy=False).first()
    assert one["score"] == 7.0  # (3 for the name, a half for "light" in the content), doubled
    assert one["content_highlight"] == ["Content matches 1 word(s)"]


def test_fuzzy_names(spark, house):
    from vergraph.functions.text import match_ratio

    df = spark.createDataFrame([("kitcen", "kitchen")], "a string, b string")
    assert df.select(match_ratio("a", "b").alias("r")).first()["r"] == pytest.approx(12 / 13)


def test_engine_search(house):
    found = search.search_engine(house.latest(), "kitchen light").collect()
    assert found[0]["id"] == "device-light"
    assert found[0]["matched_fields"] == ["name"]
    deep = search.score_engine(house.latest().where("id = 'procedure-1'"), "hold button").first()
    assert deep["score"] == 1.5 and deep["highlights"] == ["steps[0]: hold button..."]
    assert search.search_engine(house.latest(), " ").count() == 0


def test_similarity(house):
    assert similarity.similar_shared(house.latest(), "device-light").first()["id"] == "device-hub"
    assert similarity.similar_replica(house.latest(), "room-living", 2).count() == 2


def test_tools(house):
    assert rows(tools.devices_in_room(house, "room-kitchen")) == [("device-light", "Kitchen Light")]
    assert tools.devices_in_room(house, "home-1").count() == 0
    assert rows(tools.room_connections(house, "room-hall")) == [("room-kitchen", "Kitchen", "doorway"), ("room-living", "Living Room", "archway")]
    assert rows(tools.procedures_for_device(house, "device-light")) == [("manual", "manual-1", "Kitchen Light Manual"), ("procedure", "procedure-1", "Reset Kitchen Light")]
    assert rows(tools.automations_in_room(house, "room-kitchen")) == [("automation-1", "Evening Lights", ("device-light",))]
    controls = tools.device_controls(house, "device-hub").first()
    assert controls["capabilities"] == ["bridge"] and controls["services"] == [] and controls["controls"][0]["id"] == "device-light"
    assert tools.path_between(house, "home-1", "note-1").first()["found"] is False
    assert tools.checked_relationship(house, "device-hub", "room-hall", "located_in").count() == 1
    assert tools.checked_relationship(house, "room-hall", "device-hub", "depends_on").count() == 0
    with pytest.raises(ValueError):
        tools.call(house, "no_such_tool")
    with pytest.raises(ValueError):
        tools.call(house, "search_entities", query="x", entity_types=["spaceship"])


def test_cycles(spark):
    ring = build(spark, [(x, "device", x, "{}") for x in "abc"] + [("r", "room", "r", "{}")], [("a", "controls", "b", "{}"), ("b", "controls", "c", "{}"), ("c", "controls", "a", "{}"), ("a", "located_in", "r", "{}")])
    assert rows(cycles.detect_cycles(ring, "a")) == [(("a", "b", "c", "a"),)]
    assert rows(traverse.cycles_through(ring, "b")) == [(("b", "c", "a", "b"),)]
    assert {r["id"] for r in cycles.cyclic_nodes(ring).collect()} == {"a", "b", "c"}
    assert cycles.cyclic_nodes(ring, ["located_in"]).count() == 0


def test_dangling_edges(spark):
    g = build(spark, [("a", "room", "a", "{}"), ("b", "room", "b", "{}")], [("a", "connects_to", "gone", "{}"), ("gone", "connects_to", "b", "{}"), ("a", "connects_to", "a", "{}")])
    assert {r["id"] for r in traverse.bfs(g, "a").collect()} == {"a"}
    assert traverse.find_path(g, "a", "b").count() == 0
    assert relations.existing(g.relationships, g.entities).count() == 1
    nodes, edges = traverse.subgraph(g, "a", 1)
    assert edges.count() == 2
    assert {(r["id"], r["out_degree"], r["in_degree"]) for r in traverse.degrees(g).collect()} == {("a", 2, 1), ("b", 0, 1)}


def test_random_graphs_against_plain_python(spark):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(12)]
    edges = sorted({(rng.choice(names), "controls", rng.choice(names), "{}") for _ in range(22)})
    g = build(spark, [(n, "device", n, "{}") for n in names], edges)
    after = {n: [b for a, _, b, _ in edges if a == n] for n in names}
    depth, level = {"n0": 0}, ["n0"]
    while level:
        level = [b for a in level for b in after[a] if b not in depth and not depth.__setitem__(b, depth[a] + 1)]
    assert {r["id"]: r["depth"] for r in traverse.bfs(g, "n0").collect()} == depth
    for end in names[:5]:
        found = traverse.find_path(g, "n0", end).first()
        assert (found["length"] if found else None) == depth.get(end)

    def walk(path, out):
        if path[-1] == "n1":
            out.add(tuple(path))
        elif len(path) < 5:
            for b in after[path[-1]]:
                if b not in path:
                    walk([*path, b], out)
        return out

    assert {tuple(r["path"]) for r in traverse.all_paths(g, "n0", "n1").collect()} == walk(["n0"], set())
    assert traverse.connected(g, "n0", None, "outgoing", 1).count() == len([e for e in edges if e[0] == "n0"])
    assert g.latest().where(F.col("id") == "n0").count() == 1


def test_components_and_cycles_on_random_graphs(spark):
    rng = random.Random(8)
    for size, n in ((9, 16), (14, 20)):
        names = [f"n{i:02d}" for i in range(size)]
        edges = sorted({(rng.choice(names), "controls", rng.choice(names), "{}") for _ in range(n)})
        g = build(spark, [(x, "device", x, "{}") for x in names], edges)
        after = {x: {b for a, _, b, _ in edges if a == x} for x in names}
        reach = {x: set(after[x]) for x in names}
        for k in names:
            for x in names:
                if k in reach[x]:
                    reach[x] |= reach[k]
        want = {x: min(y for y in names if y == x or (y in reach[x] and x in reach[y])) for x in names if x in reach[x]}
        assert {r["id"]: r["component"] for r in cycles.strong_components(g).collect()} == want
        found = [r["cycle"] for r in cycles.detect_cycles(g).collect()]
        covered = {(a, b) for c in found for a, b in zip(c, c[1:], strict=False)}
        assert covered == {(a, b) for a, _, b, _ in edges if a == b or (a in reach[b])}
        for c in found:
            assert c[0] == c[-1] == min(c) and len(set(c)) == len(c) - 1 and all(b in after[a] for a, b in zip(c, c[1:], strict=False))


def test_walks_end_where_a_visit_is_refused(spark, monkeypatch):
    """On a to b and c, b to d, c to e: refused at b, the walk has a and b."""
    g = build(spark, [(x, "device", x, "{}") for x in "abcde"], [("a", "controls", "b", "{}"), ("a", "controls", "c", "{}"), ("b", "controls", "d", "{}"), ("c", "controls", "e", "{}")])
    for few in (traverse.FEW, 0):  # on the driver, and as tables
        monkeypatch.setattr(traverse, "FEW", few)
        monkeypatch.setattr(traverse.few_rows, "__defaults__", (few,))
        for at, want in (("b", "ab"), ("c", "abc"), ("x", "abcde"), ("a", "a")):
            assert "".join(r["id"] for r in traverse.bfs_ranked(g, "a", None, None, lambda e, at=at: e.name != at).orderBy("bfs_rank").collect()) == want
        assert {r["id"] for r in traverse.bfs(g, "a", 1, None, lambda e: e.depth < 1).collect()} == {"a", "b"}
    for at, want in (("b", "ab"), ("d", "abd"), ("c", "abdc"), ("x", "abdce")):
        assert "".join(r["id"] for r in traverse.dfs(g, "a", None, None, lambda e, at=at: e.name != at).orderBy("dfs_rank").collect()) == want


def test_few_and_many_agree(spark, monkeypatch):
    """Walks and two-sided paths on the driver and as tables; least ids among equals."""
    rng = random.Random(12)
    names = [f"n{i:02d}" for i in range(30)]
    edges = sorted({(rng.choice(names), "controls", rng.choice(names), "{}") for _ in range(70)})
    g = build(spark, [(x, "device", x, "{}") for x in names], edges)
    after = {x: sorted({b for a, _, b, _ in edges if a == x}) for x in names}
    best, level = {"n00": ["n00"]}, ["n00"]
    while level:
        ahead = {}
        for a in level:
            for b in after[a]:
                if b not in best:
                    ahead[b] = min(ahead.get(b, [*best[a], b]), [*best[a], b])
        best |= ahead
        level = list(ahead)
    for few in (traverse.FEW, 3):
        monkeypatch.setattr(traverse, "FEW", few)
        monkeypatch.setattr(traverse.few_rows, "__defaults__", (few,))
        assert {r["id"]: r["depth"] for r in traverse.bfs(g, "n00").collect()} == {k: len(p) - 1 for k, p in best.items()}
        for end in names[1:30:6]:
            found = traverse.find_path(g, "n00", end, 20).first()
            assert (found["path"] if found else None) == best.get(end)


def test_two_sided_paths_reach_few_ids(spark):
    """On two fans that meet in the middle, neither is walked to its end."""
    edges = [("s", "controls", "m0", "{}"), ("m0", "controls", "m1", "{}"), ("m1", "controls", "t", "{}")]
    edges += [("m1", "controls", f"f{i}", "{}") for i in range(300)] + [(f"b{i}", "controls", "m0", "{}") for i in range(300)]
    names = sorted({x for a, _, b, _ in edges for x in (a, b)})
    found, reached = traverse._two_sided(build(spark, [(x, "device", x, "{}") for x in names], edges), "s", "t", 10, None)
    assert found.first()["path"] == ["s", "m0", "m1", "t"] and reached <= 6


def test_pruned_paths(spark):
    """Nodes from which the end is too far are never on a prefix."""
    edges = [("s", "controls", "a", "{}"), ("a", "controls", "t", "{}")] + [("s", "controls", f"x{i}", "{}") for i in range(40)] + [(f"x{i}", "controls", f"x{j}", "{}") for i in range(40) for j in range(0, 40, 5) if i != j]
    names = sorted({x for a, _, b, _ in edges for x in (a, b)})
    g = build(spark, [(x, "device", x, "{}") for x in names], edges)
    assert rows(traverse.all_paths(g, "s", "t", 5)) == [(("s", "a", "t"), 3)]
    inside = traverse._hops(g, "t", 4, None)
    assert {r["dst"] for r in inside.collect()} == {"s", "a", "t"}  # of 42 nodes
    assert rows(traverse.all_paths(g, "s", "gone", 5)) == [] and rows(traverse.cycles_through(g, "s", 5)) == []


def test_stored_adjacency(spark, tmp_path):
    """A step from few ids reads buckets, a step from many does not shuffle the edges."""
    from vergraph.sources import adjacency

    names = [f"n{i:04d}" for i in range(2000)]
    edges = [(names[i], "controls", names[(i * 7 + k) % 2000], "{}") for i in range(2000) for k in range(3)] + [("n0000", "controls", "gone", "{}")]
    plain = build(spark, [(x, "device", x, "{}") for x in names], edges)
    kept = adjacency.stored(plain, f"t{random.getrandbits(60):x}")
    g = Graph(plain.entities, plain.relationships, lambda: kept)
    for back in (False, True):
        want = sorted(map(tuple, plain.steps(None, back, False).edges.collect()))
        assert sorted(map(tuple, kept.steps(None, back, False).edges.collect())) == want
        few = kept.steps(None, back).from_few(names[:2])
        assert 2 <= few.count() <= 8
        few.collect()
        scan = few._jdf.queryExecution().executedPlan().collectLeaves().head()
        assert scan.metrics().apply("numOutputRows").value() < 2500  # of 6001: the other buckets are not read
        many = kept.steps(None, back).from_many(spark.table(kept.by_src).select("src").distinct(), 1 << 40)
        plan = many._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(src") + plan.count("Exchange hashpartitioning(dst") <= (1 if back else 0)
    assert {r["id"]: r["depth"] for r in traverse.bfs(g, "n0000", 3).collect()} == {r["id"]: r["depth"] for r in traverse.bfs(plain, "n0000", 3).collect()}
    for end in ("n0123", "n1999"):
        assert traverse.find_path(g, "n0000", end).first() == traverse.find_path(plain, "n0000", end).first()
    again = adjacency.stored(plain, kept.by_src.removeprefix("vergraph_by_src_"))
    assert (again.by_src, again.by_dst) == (kept.by_src, kept.by_dst)


def test_paths_over_few_edges(spark, monkeypatch):
    """Where one end has many ids around it, the other end's edges are enough (F9)."""
    edges = [("s", "controls", "a", "{}"), ("a", "controls", "b", "{}"), ("b", "controls", "t", "{}"), ("a", "controls", "t", "{}")] + [(f"x{i}", "controls", "t", "{}") for i in range(60)]
    names = sorted({x for a, _, b, _ in edges for x in (a, b)})
    g = build(spark, [(x, "device", x, "{}") for x in names], edges)
    want = [(("s", "a", "b", "t"), 4), (("s", "a", "t"), 3)]
    for few in (traverse.FEW, 20):
        monkeypatch.setattr(traverse, "FEW", few)
        monkeypatch.setattr(traverse.few_rows, "__defaults__", (few,))
        assert rows(traverse.all_paths(g, "s", "t", 4)) == want
    assert traverse._near_ends(g, "s", "t", 3, None).count() == 4  # of 64
    monkeypatch.setattr(traverse.few_rows, "__defaults__", (0,))
    assert traverse._near_ends(g, "s", "t", 3, None) is None  # both ends are large: back from the end
    assert rows(traverse.all_paths(g, "s", "t", 4)) == want


def test_cycles_over_few_edges(spark, monkeypatch):
    """What only leads to the start is not walked back (F6)."""
    edges = [("a", "controls", "b", "{}"), ("b", "controls", "c", "{}"), ("c", "controls", "a", "{}"), ("b", "controls", "a", "{}")] + [(f"x{i}", "controls", "a", "{}") for i in range(60)]
    names = sorted({x for a, _, b, _ in edges for x in (a, b)})
    g = build(spark, [(x, "device", x, "{}") for x in names], edges)
    monkeypatch.setattr(traverse, "FEW", 20)
    monkeypatch.setattr(traverse.few_rows, "__defaults__", (20,))
    assert rows(traverse._near_ends(g, "a", "a", 5, None).select("id")) == [("a|b",), ("b|a",), ("b|c",), ("c|a",)]
    assert rows(traverse.cycles_through(g, "a", 5)) == [(("a", "b", "c", "a"),)]
