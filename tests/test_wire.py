"""Payloads, upkeep of the loaded graph, drift and the sync cycle."""

import base64

from pyspark.sql import functions as F

from vergraph.functions.text import content_preview
from vergraph.operators import relations, replica, stats, versions as ver, wire
from vergraph.plans.graph import Graph

EDGE = "id string, from_entity_id string, from_entity_version string, to_entity_id string, to_entity_version string, relationship_type string, properties string"


def test_preview(spark):
    rows = spark.createDataFrame([('{"z":1,"a":"x","m":"' + "y" * 60 + '","b":2}',), ("{}",), (None,)], "content string")
    got = [r[0] for r in rows.select(content_preview(F.col("content"))).collect()]
    assert got == ["z: 1, a: x, m: " + "y" * 50 + "...", None, None]


def test_blob_payload(spark):
    rows = spark.createDataFrame([(1, bytearray(b"ab" * 60)), (2, bytearray()), (3, None)], "id int, data binary")
    assert wire.blob_payload(rows).columns == ["id"]
    got = {r["id"]: r["data"] for r in wire.blob_payload(rows, include_data=True).collect()}
    assert base64.b64decode(got[1]) == b"ab" * 60 and "\n" not in got[1] and got[2] is None and got[3] is None


def test_entity_payload(spark):
    rows = spark.createDataFrame([(None, None, "room", None, None, "", None)], "id string, version string, entity_type string, name string, content string, user_id string, parent_versions array<string>")
    assert tuple(wire.entity_payload(rows).first()) == ("", "", "room", "", "{}", "unknown", [])


def test_pushed(spark):
    bodies = ['{"changes":[{"entity":{"id":"a"}},{"entity":null}],"conflicts":[{"entity_id":"b"}]}', "{}", None]
    got = sorted(map(tuple, wire.pushed(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()))
    assert got == [("a", None), ("b", "conflict")]


def test_upkeep(spark):
    node = "id string, version string, entity_type string, name string, content string, is_latest boolean"
    nodes = spark.createDataFrame([(i, "1", "room", i, "{}", True) for i in "abc"], node)
    edges = spark.createDataFrame([("ab", "a", "1", "b", "1", "connects_to", "{}"), ("bc", "b", "1", "c", "1", "connects_to", "{}")], EDGE)
    batch = spark.createDataFrame([("c", "2", "room", "c", '{"deleted":true}', True, 1), ("d", "1", "room", "d", "{}", True, 2)], node + ", pos int")
    new = spark.createDataFrame([("ad", "a", "1", "d", "1", "connects_to", "{}", 1), ("ax", "a", "1", "x", "1", "connects_to", "{}", 2)], EDGE + ", pos int")
    out = relations.upkeep(Graph(nodes, edges), batch, new)
    assert sorted(r["id"] for r in out.entities.collect()) == ["a", "b", "d"]
    assert sorted(r["id"] for r in out.relationships.collect()) == ["ab", "ad"]


def versions(spark, rows):
    return spark.createDataFrame(rows, "id string, version string, server_seq long, t long").withColumn("created_at", F.expr("timestamp_seconds(t)")).withColumn("updated_at", F.col("created_at"))


def test_drift(spark):
    rows = versions(spark, [("a", "1", 1, 1), ("a", "2", 2, 2)])
    assert not stats.drifted(rows, stats.generation_marker(rows)).first()[0]
    assert stats.drifted(rows, stats.generation_marker(rows.where("server_seq = 1"))).first()[0]
    assert stats.drifted(rows, stats.generation_marker(rows.where("false"))).first()[0]


def test_cycle(spark):
    server = ver.with_latest_flag(versions(spark, [("a", "1", 1, 1), ("b", "1", 2, 2), ("a", "2", 3, 3)]), F.col("server_seq"))
    local = ver.with_latest_flag(versions(spark, [("a", "1", 1, 1), ("c", "1", 0, 1)]), F.col("server_seq"))
    edits = spark.createDataFrame([("c", "create", 1), ("gone", "update", 1)], "id string, operation string, at_us long")
    after, push, left = replica.sync_cycle(local, server, edits, 1)
    assert sorted((r["id"], r["version"]) for r in after.where("is_latest").collect()) == [("a", "2"), ("b", "1"), ("c", "1")]
    assert [r["id"] for r in push.collect()] == ["c"] and [r["id"] for r in left.collect()] == ["gone"]
