"""Stores that are read by range: digest trees and the change log."""

import random



from vergraph.sources import digest_tree
from vergraph.sources.change_log import ChangeLog

ROWS = "id string, version string"


def as_rows(state):
    return sorted(state.items())


def test_digest_tree_finds_what_differs(spark, tmp_path):
    rng = random.Random(2)
    a = {f"e{i}": f"v{rng.randrange(3)}" for i in range(3000)}
    b = dict(a)
    for i in rng.sample(range(3000), 5):
        b[f"e{i}"] = "other"
    del b["e7"]
    b["new"] = "v0"
    x, y = (digest_tree.KeptRows(spark, f"{tmp_path}/{n}").write(spark.createDataFrame(as_rows(s), ROWS)) for n, s in (("a", a), ("b", b)))
    want = sorted(((k, a.get(k), b.get(k)) for k in a.keys() | b.keys() if a.get(k) != b.get(k)), key=str)
    assert sorted(map(tuple, digest_tree.differing(x, y).collect()), key=str) == want
    assert digest_tree.differing(x, x).count() == 0
    wrong = digest_tree.descended(x.tree(), y.tree())
    assert wrong.count() <= len(want)
    parts = sorted({r["prefix"][: digest_tree.PART] for r in wrong.collect()})
    read = x.rows(parts)
    assert len(parts) <= 7 and read.collect() and read._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value() <= len(parts)  # of 256
    assert digest_tree.descended(x.tree().limit(0), spark.createDataFrame([], ROWS).transform(digest_tree.tree)).count() == 0


def test_digest_tree_is_kept_up(spark):
    rng = random.Random(3)
    state = {f"e{i}": "v0" for i in range(400)}
    now = digest_tree.tree(spark.createDataFrame(as_rows(state), ROWS))
    for step in range(3):
        changes = []
        for k in rng.sample(sorted(state), 30):
            new = None if rng.random() < 0.3 else f"v{step}x{rng.randrange(9)}"
            changes.append((k, state[k], new))
            state.pop(k) if new is None else state.update({k: new})
        changes.append((f"new{step}", None, "v0"))
        state[f"new{step}"] = "v0"
        now = digest_tree.kept_up(now, spark.createDataFrame(changes, "id string, old_version string, new_version string"))
    want = digest_tree.tree(spark.createDataFrame(as_rows(state), ROWS))
    assert sorted(map(tuple, now.collect())) == sorted(map(tuple, want.collect()))


def test_change_log_pages(spark, tmp_path):
    """Pages drain once, read their own blocks only, and see appends in between."""
    rng = random.Random(6)
    log, current, seq = ChangeLog(spark, f"{tmp_path}/log", "id string, version string, server_seq long", block=100), {}, 0

    def append(n):
        nonlocal seq
        rows, replaced = [], []
        before = dict(current)
        for _ in range(n):
            seq += 1
            id_ = f"e{rng.randrange(150)}"
            rows.append((id_, f"v{seq}", seq))
            current[id_] = seq
        replaced = [(before[i],) for i in {r[0] for r in rows} if i in before]
        log.append(spark.createDataFrame(rows, "id string, version string, server_seq long"), spark.createDataFrame(replaced, "server_seq long"))

    append(700)
    append(300)
    seen, cursor = [], 0
    for k in range(100):
        page = [r["server_seq"] for r in log.page(cursor, 40).orderBy("server_seq").collect()]
        if not page:
            break
        seen += page
        cursor = page[-1]
        if k == 1:
            append(120)
    assert len(seen) == len(set(seen)) and set(current.values()) <= set(seen) and seen == sorted(seen)
    assert sorted(r["server_seq"] for r in log.blocks(0, 1 << 40).collect()) == sorted(current.values())
    one = log._read("rows", log.columns, 9, 10)
    assert {r["server_seq"] // 100 for r in one.collect()} == {9} and one.count() <= 100  # of 1,120
    assert all("/block=9/" in f for f in one.inputFiles())  # other folders are not listed
    assert log.page(10_000).count() == 0 and ChangeLog(spark, f"{tmp_path}/none", log.columns).page(0).count() == 0
