"""Counts kept up by differences against counts from everything."""

import random

from pyspark.sql import functions as F

from vergraph.operators import differences
from vergraph.plans.graph import Graph, cut
from vergraph.sources import star

NODES = "id string, version string, entity_type string, name string, content string, is_latest boolean, pos int"
EDGES = "id string, from_entity_id string, from_entity_version string, to_entity_id string, to_entity_version string, relationship_type string, properties string, pos int"


def test_random_batches(spark):
    """Nodes come, go, come back and change their type; edges come, move, and wait for their ends."""
    rng = random.Random(9)
    names = [f"n{i}" for i in range(14)]

    def node(pos):
        return (rng.choice(names), "v", rng.choice(["room", "device"]), "x", rng.choice(["{}", "{}", '{"deleted":true}']), True, pos)

    def edge(pos):
        return (f"e{rng.randrange(25)}", rng.choice(names), "v", rng.choice(names), "v", rng.choice(["controls", "located_in"]), "{}", pos)

    def frames(n, m):
        return spark.createDataFrame([node(k) for k in range(n)], NODES), spark.createDataFrame([edge(k) for k in range(m)], EDGES)

    nodes, edges = frames(12, 20)
    empty = Graph(nodes.limit(0).drop("pos"), edges.limit(0).drop("pos"))
    graph = differences.applied(empty, nodes, edges)
    counts = differences.counted(graph)
    for batch in ((3, 4), (5, 0), (0, 6), (1, 1)):
        graph = Graph(cut(graph.entities), cut(graph.relationships))
        nodes, edges = frames(*batch)
        signed = differences.differences(graph, nodes, edges)
        counts = differences.kept_up(counts, signed)
        counts = differences.Counts(cut(counts.degrees), cut(counts.types))
        graph = differences.applied(graph, nodes, edges)
        want = differences.counted(graph)
        assert sorted(map(tuple, counts.degrees.collect())) == sorted(map(tuple, want.degrees.collect()))
        assert sorted(map(tuple, counts.types.collect())) == sorted(map(tuple, want.types.collect()))
        loaded = graph.loaded()
        total = counts.totals().first()
        assert (total["total_entities"], total["total_relationships"]) == (loaded.entities.count(), loaded.relationships.count())
        ids = {r[c] for r in loaded.relationships.collect() for c in ("from_entity_id", "to_entity_id")}
        assert {r["id"] for r in counts.connected().collect()} == ids and total["connected_entities"] == len(ids)


def test_retyped_edges_are_not_made(spark, monkeypatch):
    """Nodes go and come, and all edges of a type change it: as by the edges themselves."""
    g = star.graph(spark, "/root/testdata/sf0.001")
    kept = g.entities.where("id <> 'supplier-4'")
    g = Graph(kept, g.relationships, source=g.source)
    nodes = g.latest().where("id rlike '^(customer|supplier|nation)-.*[37]$'").withColumn("content", F.lit('{"deleted":true}'))
    nodes = cut(nodes.unionByName(star.entities(spark, "/root/testdata/sf0.001").where("id = 'supplier-4'")).withColumn("pos", F.lit(1)))
    edges = g.relationships.where("relationship_type = 'connects_to'").withColumn("relationship_type", F.lit("located_in")).withColumn("pos", F.lit(1))
    want = differences.counted(differences.applied(Graph(g.entities, g.relationships), nodes, edges))
    want = [sorted(map(tuple, df.collect())) for df in (want.types, want.degrees)]
    monkeypatch.setattr(star, "_near", None)
    got = differences.kept_up(differences.counted(g), differences.retyped(g, nodes, ["connects_to"], "located_in"))
    assert [sorted(map(tuple, df.collect())) for df in (got.types, got.degrees)] == want
