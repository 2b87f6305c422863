"""Keyed state in streams: against plain models, over restarts, and by what a batch writes."""

import os
import random

from pyspark.sql import functions as F

from vergraph.operators import sync, windows
from vergraph.streaming.attempts import limited_stream
from vergraph.streaming.changes import LOG, Store, keyed_state, sync_stream

from .test_sync import BASE, CHANGES, STORED, model, version

ATTEMPTS = "identifier string, at_us long, success boolean"


def plain_limits(attempts):
    """Dictionaries and a sweep on every hour, as a server would run them."""
    recent, locked, step, out, hour = {}, {}, {}, [], 3_600_000_000
    swept = 0
    for at, who, ok in sorted((a[1], a[0], a[2]) for a in attempts):
        while swept + hour <= at:
            swept += hour
            for w in [w for w, end in locked.items() if end < swept]:
                del locked[w]
                step.pop(w, None)
        if who in locked and at < locked[who]:
            out.append((who, at, False, (locked[who] - at) // 1_000_000))
            continue
        locked.pop(who, None)
        recent[who] = [t for t in recent.get(who, []) if t > at - 300_000_000]
        if len(recent[who]) >= 5:
            times = step.get(who, 0) + 1
            locked[who], step[who] = at + 900_000_000 * times, min(times, 5)
            out.append((who, at, False, 900 * times))
            continue
        out.append((who, at, True, 0))
        if ok:
            for d in (recent, locked, step):
                d.pop(who, None)
        else:
            recent[who].append(at)
    return sorted(out)


def attempts_of(seed, n=900, hours=9):
    rng = random.Random(seed)
    return [(w, at, rng.random() < 0.02) for w, at in {(rng.choice("ab"), rng.randrange(hours * 3_600_000_000)) for _ in range(n)}]


def test_limits_with_sweeps(spark):
    rows = attempts_of(1)
    got = windows.limited(spark.createDataFrame([*rows, ("c", None, True)], ATTEMPTS).repartition(5)).collect()
    want = plain_limits(rows)
    assert sorted(tuple(r) for r in got) == want
    assert {w[3] for w in want} >= {0, 900, 1800}
    assert windows.limited(spark.createDataFrame([], ATTEMPTS)).count() == 0
    steady = windows.Limiter(locked_until=10, step=3)
    assert not steady.idle(11) and steady.idle(windows.SWEEP_US) and windows.Limiter().idle(0)


def test_limits_on_a_stream(spark, tmp_path):
    """Attempts in any order within the watermark give the batch's answers, over a
    restart; later ones are left out."""
    rows = attempts_of(2, n=300, hours=5)
    files = [rows[:100], rows[100:200], rows[200:], [("", 100 * 3_600_000_000, False)], [("a", 5, False)], [("", 200 * 3_600_000_000, False)]]

    def run(stop):
        for k, own in list(enumerate(files))[stop[0] : stop[1]]:
            spark.createDataFrame(own, ATTEMPTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
            stream = spark.readStream.schema(ATTEMPTS).parquet(f"{tmp_path}/in/*")
            with keyed_state(spark):
                limited_stream(stream, "6 hours").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    run((0, 2))
    run((2, 6))
    got = spark.read.parquet(f"{tmp_path}/out").where("identifier <> ''").collect()
    assert sorted(tuple(r) for r in got) == plain_limits(rows)


def changes_of(seed, n=240):
    rng = random.Random(seed)
    stored = [(f"e{i}", version(BASE, "s"), True, BASE, "{}", i + 1) for i in range(12)]
    pool = {f"e{i}": [version(BASE, "s")] for i in range(20)}
    changes = []
    for pos in range(n):
        id_ = f"e{rng.randrange(20)}"
        v = rng.choice(pool[id_]) if rng.random() < 0.15 else version(BASE + rng.randrange(-3_000_000, 3_000_000), rng.choice("abc"))
        parents = [rng.choice(pool[id_])] if rng.random() < 0.6 else None
        pool[id_].append(v)
        changes.append((pos, BASE + pos * 300_000, "delete" if rng.random() < 0.1 else "update", id_, v, "{}", parents))
    return stored, changes


def test_sync_stream_is_the_fold(spark, tmp_path):
    """Three runs of the stream, one batch each, against one fold over all changes."""
    stored, changes = changes_of(5)
    before = spark.createDataFrame(stored, STORED)
    store, seen = Store(spark, f"{tmp_path}/store"), []
    store.begin(before)
    for k in range(3):
        spark.createDataFrame([c for c in changes if c[0] // 80 == k], CHANGES).repartition(2).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(CHANGES).parquet(f"{tmp_path}/in/*")
        sync_stream(stream, store, f"{tmp_path}/state", seen.append).awaitTermination()
        if k == 1:
            store.compact(seen[-1])
    outcomes, now = model(stored, changes)
    log = spark.read.schema(LOG).parquet(f"{tmp_path}/store/log/*")
    assert {r["pos"]: r["outcome"] for r in log.collect()} == outcomes
    rows = store.rows().collect()
    assert {r["id"]: r["version"] for r in rows if r["is_latest"]} == now
    assert sorted(r["server_seq"] for r in rows) == list(range(1, len(rows) + 1))
    want = sync.apply_batch(before, spark.createDataFrame(changes, CHANGES))[0].select("id", "version", "is_latest", "content", "server_seq")
    assert sorted(map(tuple, store.rows().select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    # a batch that runs again overwrites its own folders
    store.append(spark.createDataFrame(log.where("pos >= 160").collect(), LOG), seen[-1])
    assert sorted(map(tuple, store.rows().select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_a_batch_costs_what_it_brings(spark, tmp_path):
    """Ten changes on 20,000 stored rows: ten rows are written, and nothing old."""
    stored = spark.range(20_000).select(F.concat(F.lit("e"), "id").alias("id"), F.lit("v0").alias("version"), F.lit(True).alias("is_latest"), F.lit(BASE).alias("updated_us"), F.lit("{}").alias("content"), (F.col("id") + 1).alias("server_seq"))
    store = Store(spark, f"{tmp_path}/store")
    store.begin(stored)
    for k in range(2):
        spark.createDataFrame([(10 * k + i, BASE + k, "update", f"e{i * 1999}", f"v{k + 1}", "{}", [f"v{k}"]) for i in range(10)], CHANGES).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(CHANGES).parquet(f"{tmp_path}/in/*")
        sync_stream(stream, store, f"{tmp_path}/state").awaitTermination()
    numbers = store._numbers("added")
    for n, top in zip(numbers, (20_010, 20_020), strict=True):
        own = spark.read.parquet(f"{tmp_path}/store/added/{n}")
        assert (own.count(), own.agg(F.max("server_seq")).first()[0]) == (10, top)
        size = sum(os.path.getsize(os.path.join(d, f)) for kind in ("added", "log", "acks", "marks") for d, _, names in os.walk(f"{tmp_path}/store/{kind}/{n}") for f in names)
        assert size < 40_000
    assert store._numbers("snapshots") == [-1]
    rows = store.rows()
    assert (rows.count(), rows.where("is_latest").count(), rows.where("is_latest and version = 'v2'").count()) == (20_020, 20_000, 10)


def test_micro_batches_are_written_by_many_tasks(spark):
    """What is fed to the stream comes from as many tasks as there are, not from one a micro-batch."""
    from glob import glob

    from vergraph.plans.queries_sync import QUERIES as sync_queries

    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(glob(f"{shared}/vergraph/sync-*"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sync_queries["syn1_sync_stream"][0](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (folder,) = set(glob(f"{shared}/vergraph/sync-*")) - before
    assert len(glob(f"{folder}/in/*.parquet")) > 3 and len(glob(f"{folder}/store/added/*")) == 3
