"""The inverted index against the scans: results, rows read, and upkeep."""

import random

import pytest
from pyspark.sql import functions as F

from vergraph.operators import search, versions
from vergraph.sources import postings

SCHEMA = "id string, entity_type string, name string, content string"


def entity(rng, i):
    word = lambda: rng.choice("small ring large widget Kühl_box 100% kitchen light the of an ab".split())
    kind = rng.choice(["device", "room", "manual"])
    content = rng.choice([None, "{}", '{"a":"%s %s"}' % (word(), word()), '{"a":{"b":["%s","x %s y"]},"n":3}' % (word(), word())])
    return (f"e{i:03d}", kind, " ".join(word() for _ in range(rng.randrange(1, 4))).title(), content)


@pytest.fixture(scope="module")
def kept(spark):
    rng = random.Random(4)
    rows = {r[0]: r for r in (entity(rng, i) for i in range(150))}
    index = postings.build(spark.createDataFrame(list(rows.values()), SCHEMA))
    return rng, rows, index


def scored(df):
    return [(r["id"], r["name"], round(r["score"], 9), r["matched_fields"]) for r in df.collect()]


def same_as_scans(spark, index, rows, queries):
    plain = spark.createDataFrame(list(rows.values()), SCHEMA)
    for q in queries:
        for types, limit in ((None, 5), (["device", "room"], 1000)):
            assert scored(index.search_engine(q, types, limit)) == scored(search.search_engine(plain, q, types, limit)), (q, limit)
        assert {r["id"] for r in index.search_replica(q).collect()} == {r["id"] for r in search.search_replica(plain, q).collect()}, q
    for q in ("RING", "k_hl", "%", "100%", "l r%g", "ab"):
        assert {r["id"] for r in index.name_contains(q).collect()} == {r["id"] for r in versions.name_contains(plain, q).collect()}, q
        assert {r["id"] for r in index.name_contains(q, False).collect()} == {r["id"] for r in versions.name_contains(plain, q, False).collect()}, q


def test_same_as_scans(spark, kept):
    _, rows, index = kept
    same_as_scans(spark, index, rows, ["small ring", "ring", "Kühl_box", "the of", "ab", "device ring", "*", "nothing here"])


def test_reads_fewer_rows(spark, kept):
    _, _, index = kept
    found = spark.table(index.terms_table).where(F.col("term").isin([postings.NAME + g for g in postings.trigrams("kühl")]))  # as ``hits`` reads
    assert found.collect()
    rows_read = found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()
    assert 0 < rows_read < spark.table(index.terms_table).count() / 2


def test_kept_up_from_changes(spark, kept):
    rng, rows, index = kept
    for at in (0, 40):
        changed = [entity(rng, i) for i in range(at, at + 60)] + [entity(rng, 150 + at)]
        gone = [f"e{i:03d}" for i in range(100 + at, 105 + at)]
        rows.update({r[0]: r for r in changed})
        for g in gone:
            rows.pop(g, None)
        index.add(spark.createDataFrame(changed, SCHEMA), spark.createDataFrame([(g,) for g in gone], "id string"))
        same_as_scans(spark, index, rows, ["small ring"])
    index.compact()
    assert index.delta is None
    same_as_scans(spark, index, rows, ["small ring", "light"])


def test_postings_of_a_term_are_dealt(spark, monkeypatch):
    """A term of every row is written by several tasks, to one bucket."""
    monkeypatch.setattr(postings, "PART_ROWS", 20)
    monkeypatch.setattr(postings, "TASK_ROWS", 5)
    rows = spark.createDataFrame([(f"e{i}", "device", "Small Ring", '{"a":"b"}') for i in range(160)], SCHEMA)
    index = postings.build(rows)
    term = spark.table(index.terms_table).where(F.col("term") == postings.NAME + "sma")
    files = {r["f"] for r in term.select(F.input_file_name().alias("f")).distinct().collect()}
    assert term.count() == 160 and len(files) > 2
    assert len({f.rsplit("_", 1)[1] for f in files}) == 1  # the bucket is in the file's name
    assert index.name_contains("small").count() == 160


def test_common_terms_are_not_posted(spark, monkeypatch):
    """Results are those of the scans, also where some or all terms of a query are common (F2, F3, F4)."""
    monkeypatch.setattr(postings, "COMMON_ROWS", 25)
    rng = random.Random(9)
    rows = {r[0]: r for r in (entity(rng, i) for i in range(100))}
    index = postings.build(spark.createDataFrame(list(rows.values()), SCHEMA))
    most = spark.table(index.terms_table).groupBy("term").count().agg(F.max("count")).first()[0]
    assert most <= 25 and postings.TEXT + '{"a' in index.common
    changed = [entity(rng, i) for i in range(90, 110)]
    rows.update({r[0]: r for r in changed})
    index.add(spark.createDataFrame(changed, SCHEMA))
    same_as_scans(spark, index, rows, ["small ring", '{"a"', "light"])


def test_names_of_common_terms(spark, monkeypatch):
    """A pattern of rare and common trigrams reads the rare ones; one of common ones is a scan (F3)."""
    monkeypatch.setattr(postings, "COMMON_ROWS", 20)
    index = postings.build(spark.createDataFrame([(f"e{i}", "device", f"Small Ring {i}", "{}") for i in range(60)], SCHEMA))
    assert index._containing(["small"], (postings.NAME,)) is None and index.name_contains("sMall").count() == 60
    assert [r["id"] for r in index.name_contains("small%g 47").collect()] == ["e47"]
    assert index._containing(["small", "g 47"], (postings.NAME,)).count() == 1
