"""The ordered fold against a plain model, and its boundary cases."""

import random

import pytest
from pyspark.sql import functions as F

from vergraph.functions.values import backoff_seconds, difference_ms, is_tombstoned, merged_content, remote_wins, version_time
from vergraph.operators import migrate, replica, sync, versions as ver, windows

STORED = "id string, version string, is_latest boolean, updated_us long, content string, server_seq long"
CHANGES = "pos int, apply_us long, change_type string, id string, version string, content string, parent_versions array<string>"
BASE = 1_700_000_000_000_000


def version(us, user="u"):
    from datetime import datetime, timedelta, timezone

    return (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)).strftime("%Y-%m-%dT%H:%M:%S.%f+00:00") + f"-000000-{user}"


def version_us(v):
    from datetime import datetime, timezone

    try:
        return int(round((datetime.fromisoformat(v[:32]) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1e6))
    except ValueError:
        return None


def model(stored, changes):
    """The fold in plain Python: outcomes by position, current version by id."""
    now = {s[0]: {"v": s[1], "us": s[3], "deleted": "deleted" in s[4]} for s in stored}
    seen = {s[0]: {s[1]} for s in stored}
    out = {}
    for pos, apply_us, kind, id_, v, _, parents in sorted(changes):
        s = now.get(id_)
        parents = parents or []
        lost = False
        if kind == "delete":
            if s is None or s["deleted"]:
                out[pos] = "noop"
                continue
            out[pos] = "tombstone"
        elif s is None:
            out[pos] = "insert"
        elif s["v"] == v:
            out[pos] = "noop"
            continue
        elif s["v"] in parents:
            out[pos] = "fast_forward"
        else:
            remote = version_us(v)
            remote = s["us"] if remote is None else remote
            ms = int((remote - s["us"]) / 1000)
            wins = v > s["v"] if abs(ms) < 1000 else remote > s["us"]
            out[pos] = "conflict_won" if wins else "conflict_lost"
            lost = not wins
        if v in seen.setdefault(id_, set()):
            continue
        seen[id_].add(v)
        if not lost:
            now[id_] = {"v": v, "us": apply_us, "deleted": kind == "delete"}
    return out, {k: x["v"] for k, x in now.items()}


def test_fold_matches_model(spark):
    rng = random.Random(11)
    stored = [(f"e{i}", version(BASE, "s"), True, BASE, "{}", i + 1) for i in range(12)]
    pool = {f"e{i}": [version(BASE, "s")] for i in range(20)}
    changes = []
    for pos in range(240):
        id_ = f"e{rng.randrange(20)}"
        v = rng.choice(pool[id_]) if rng.random() < 0.15 else version(BASE + rng.randrange(-3_000_000, 3_000_000), rng.choice("abc"))
        parents = [rng.choice(pool[id_])] if rng.random() < 0.6 else []
        pool[id_].append(v)
        changes.append((pos, BASE + pos * 300_000, "delete" if rng.random() < 0.1 else "update", id_, v, "{}", parents))
    s, c = spark.createDataFrame(stored, STORED), spark.createDataFrame(changes, CHANGES)
    outcomes, now = model(stored, changes)
    assert {r["pos"]: r["outcome"] for r in sync.apply_changes(s, c).collect()} == outcomes
    rows, _ = sync.apply_batch(s, c)
    rows = rows.cache()
    assert {r["id"]: r["version"] for r in rows.where("is_latest").collect()} == now
    seqs = sorted(r["server_seq"] for r in rows.collect())
    assert seqs == list(range(1, len(seqs) + 1))
    again = sync.apply_batch(rows, c.where("change_type <> 'delete'"))[0]
    assert again.count() == rows.count()  # a replay inserts nothing


def test_one_hot_id(spark):
    """A chain of fast-forwards on one id, in shuffled order over many partitions."""
    n = 5000
    chain = [version(BASE + i * 1000, "c") for i in range(n + 1)]
    changes = [(i, BASE + i * 1000, "update", "hot", chain[i + 1], "{}", [chain[i]]) for i in range(n)]
    random.Random(3).shuffle(changes)
    s = spark.createDataFrame([("hot", chain[0], True, BASE, "{}", 1)], STORED)
    rows, log = sync.apply_batch(s, spark.createDataFrame(changes, CHANGES).repartition(13))
    assert {r["outcome"]: r["count"] for r in log.groupBy("outcome").count().collect()} == {"fast_forward": n}
    assert [r["version"] for r in rows.where("is_latest").collect()] == [chain[n]]


def test_fold_of_nulls_and_nothing(spark):
    s = spark.createDataFrame([("a", version(BASE), True, None, None, 1)], STORED)
    odd = [(0, None, None, None, None, None, None), (1, 5, "update", "a", None, None, None), (2, 5, "delete", "zz", "v", None, None), (3, 5, "update", "a", version(BASE + 9), None, None)]
    got = {r["pos"]: (r["outcome"], r["inserted"], r["parents"]) for r in sync.apply_changes(s, spark.createDataFrame(odd, CHANGES)).collect()}
    assert got == {0: ("insert", False, []), 1: ("conflict_lost", False, [version(BASE)]), 2: ("noop", False, []), 3: ("conflict_lost", True, [version(BASE)])}
    assert sync.apply_changes(s, spark.createDataFrame([], CHANGES)).count() == 0
    assert sync.apply_changes(s.limit(0), spark.createDataFrame(odd[3:], CHANGES)).first()["outcome"] == "insert"


@pytest.mark.parametrize(("ms_us", "wins"), [(999_999, False), (1_000_000, True), (-999_999, False), (-1_000_000, False), (0, False)])
def test_tie_window(spark, ms_us, wins):
    df = spark.createDataFrame([(BASE, "v2", BASE + ms_us, "v1")], "l long, lv string, r long, rv string")
    assert df.select(remote_wins(F.col("l"), F.col("lv"), F.col("r"), F.col("rv")).alias("w")).first()["w"] is wins
    assert df.select(difference_ms(F.col("l"), F.col("r")).alias("d")).first()["d"] == int(ms_us / 1000)


def test_values(spark):
    one = spark.range(1)
    for text, truth in (("true", True), ("false", False), ("0", False), ('""', False), ('"yes"', True), ("null", False), ("[]", False), ("[1]", True)):
        assert one.select(is_tombstoned(F.lit(f'{{"deleted":{text}}}')).alias("d")).first()["d"] is truth
    assert one.select(merged_content(F.lit('{"a":1,"b":{"c":2}}'), F.lit('{"b":3,"d":"x"}')).alias("m")).first()["m"] == '{"a":1,"b":3,"d":"x"}'
    for v in ("2024-01-01T00:00:00.500000+00:00-000001-a", "2024-01-01T00:00:00.500000+00:00Z-a-b"):
        assert one.select(F.unix_micros(version_time(F.lit(v))).alias("t")).first()["t"] == 1_704_067_200_500_000
    assert one.select(version_time(F.lit("nonsense")).alias("t")).first()["t"] is None
    assert [one.select(backoff_seconds(F.lit(n)).alias("s")).first()["s"] for n in (0, 3, 9)] == [30, 240, 1920]


def test_paging_drains_once(spark):
    rows = spark.createDataFrame([(f"e{9 - i}", f"v{i}", True, i, "note", "n", "{}", "u", i + 1) for i in range(7)], "id string, version string, is_latest boolean, updated_at long, entity_type string, name string, content string, user_id string, server_seq long")
    seen, cursor = [], 0
    while cursor is not None:
        seen += [r["id"] for r in sync.pull_page(rows, cursor, size=2).orderBy("server_seq").collect()]
        cursor = sync.next_cursor(rows, cursor, 2).first()["next_cursor"]
    assert seen == [f"e{9 - i}" for i in range(7)]


def test_pending_and_pull(spark):
    edits = spark.createDataFrame([("a", "create", 1), ("a", "update", 2), ("b", "update", 3), ("c", "create", 4)], "id string, operation string, at_us long")
    acks = spark.createDataFrame([("c",)], "id string")
    assert {(r["id"], r["operation"]) for r in replica.pending_state(edits, acks).collect()} == {("a", "create"), ("b", "update")}


def test_migration(spark):
    rows = spark.createDataFrame([("e1", "n", "u", '{"data_b64": "aGk=", "mime_type": "image/png", "x": 1}'), ("e2", "n", "u", '{"images": [{"data_b64": "aGk=", "label": "L"}, {"y": 2}]}'), ("e3", "n", "u", '{"blob_id": "b"}'), ("e4", None, None, None)], "id string, name string, user_id string, content string")
    out, blobs = migrate.extract_blobs(rows)
    assert blobs.count() == 2 and {r["size"] for r in blobs.collect()} == {2}
    assert not any("data_b64" in (r["content"] or "") for r in out.collect())
    assert migrate.extract_blobs(out)[1].count() == 0


def test_limiter(spark):
    limiter, at = windows.Limiter(), 0
    for _ in range(5):
        assert limiter.attempt(at, False) == (True, 0)
        at += 1_000_000
    waits = []
    for _ in range(8):
        allowed, wait = limiter.attempt(at, False)
        waits.append(wait)
        at += 1 + wait * 1_000_000
        limiter.recent = [at - 1] * 5
    assert waits == [900, 1800, 2700, 3600, 4500, 5400, 5400, 5400]
    df = spark.createDataFrame([("x", 1_000_000 * i, False) for i in range(7)], "identifier string, at_us long, success boolean")
    assert [r["allowed"] for r in windows.limited(df).orderBy("at_us").collect()] == [True] * 5 + [False] * 2


def test_latest_is_unique(spark):
    rows = spark.createDataFrame([("a", "v1", 1), ("a", "v2", 2), ("b", "v1", 1)], "id string, version string, created_at long")
    flags = ver.with_latest_flag(rows, F.col("created_at"))
    assert {(r["id"], r["version"]) for r in flags.where("is_latest").collect()} == {("a", "v2"), ("b", "v1")}
    assert [r["server_seq"] for r in ver.numbered(rows, ["created_at", "id"], "server_seq").orderBy("server_seq").collect()] == [1, 2, 3]


def test_fold_of_sides_that_are_dealt_by_id(spark):
    """Stored rows and changes are dealt once more after their union, though both were
    dealt by id before: parts that are merged while it runs are not parts of the union."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = spark.createDataFrame([(f"e{i}", "v1", True, 1, "{}") for i in range(20)], "id string, version string, is_latest boolean, updated_us long, content string").repartition(n, "id")
    changes = spark.createDataFrame([(i, 2, "update", f"e{i}", "v2", "{}", ["v1"]) for i in range(20)], "pos int, apply_us long, change_type string, id string, version string, content string, parent_versions array<string>").repartition(n, "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        log = sync.apply_changes(stored, changes)
        above = log._jdf.queryExecution().executedPlan().toString().partition("Union")[0]
        assert "Exchange hashpartitioning" in above
        assert {r["outcome"] for r in log.collect()} == {"fast_forward"}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_edges_rewritten_in_place(spark):
    """As a batch that names them all, some of them hung elsewhere, some without an end."""
    from vergraph.sources import star

    small = "/root/testdata/sf0.001"
    types = ["part_of", "connects_to"]
    edges = star.relationships(spark, small).where(F.col("relationship_type").isin(*types))
    known = star.entities(spark, small).where("id not in ('supplier-3', 'nation-5')")
    bad = (F.col("from_entity_id") == "nation-3") & (F.col("relationship_type") == "part_of")
    moved = F.col("from_entity_id").isin("nation-4", "customer-7")
    patch = {"properties": F.lit("x"), "to_entity_id": F.when(bad, F.lit("region-99")).when(moved, F.lit("region-0")).otherwise(F.col("to_entity_id"))}
    batch = edges.select(*[patch[c].alias(c) if c in patch else F.col(c) for c in edges.columns]).withColumn("pos", F.lit(1))
    want = sync.edge_changes(known, edges, batch)[0]
    got = sync.rewritten_edges(known, star.KeyedEdges(spark, small).of_types(types), patch)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_repeated_events_are_one_stored_row_and_one_change(spark, tmp_path):
    import duckdb

    from vergraph.plans import queries_sync

    rows = "SELECT e.* FROM '/root/testdata/sf0.001/events.parquet' e, range(3)"
    duckdb.sql(f"COPY ({rows}) TO '{tmp_path}/events.parquet'")
    query, text = queries_sync.QUERIES["syn4_blind_update"]
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
        want = db.execute(text).fetchall()
    assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(want)
