"""Operator 12 against a plain dictionary of prefixes, and against its SQL."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from vergraph.llm import queries, trie

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string, conv string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "k", "c") for r in rows], SCHEMA).repartition(3)


def plain(rows, rebuild):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())):
        own.setdefault(c, []).append((role or "", text or ""))
    built = dict(own)
    if rebuild:
        for c in own:
            h = zlib.crc32(str(c).encode()) % 6
            built[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + own[c][h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for k, members in nodes.items():
        under = [m for m in nodes if m[: len(k)] == k]
        leaves = sum(not any(len(n) == len(m) + 1 and n[: len(m)] == m for n in nodes) for m in under)
        saved = sum((len(nodes[m]) - 1) * len(m[-1][1]) for m in under if m)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(k))
        children = sum(len(n) == len(k) + 1 and n[: len(k)] == k for n in nodes)
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed, n=60, kinds=3):
    rng = np.random.default_rng(seed)
    out = [(c, t, ["user", "assistant", None][int(rng.integers(0, 3))], [None, "", "hi", "why é", "so"][int(rng.integers(0, kinds))]) for c in range(-3, n) for t in range(int(rng.integers(1, 7)))]
    out += [(500 + k, t, "user", "same") for k in range(30) for t in range(4)]  # copies
    out += [(600, t, "user", "long" if t % 50 else "x" * 5000) for t in range(40)]
    out += [(700, None, "user", "null turn"), (700, 0, "user", "next"), (700, 0, "user", "next"), (700, 0, "aide", "next"), (None, 0, "user", "nobody")]
    return out


@pytest.mark.parametrize("most", [trie.MOST, 50, 0])
@pytest.mark.parametrize("rebuild", [False, True])
def test_against_dictionary(spark, most, rebuild):
    """Peeled inside tasks, level by level in Spark, and both."""
    rows = rows_of(1, n=25)
    if most == 0:
        rows = [r for r in rows if r[0] != 600]  # 40 levels, each a job
    make = trie.trie_of_rebuilt if rebuild else trie.trie_of
    got = make(frame(spark, rows), most).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, rebuild)


def test_turnless_and_empty(spark):
    assert trie.trie_of_rebuilt(frame(spark, [])).count() == 0
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    got = trie.trie_of_rebuilt(frame(spark, [(c, 0, "user", "gone")])).collect()  # no head to take, all own turns cut
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_many_copies(spark):
    """The ids of one node come in many pieces."""
    rows = [(c * 7, 0, "user", "same") for c in range(3000)]
    got = {r["depth"]: r for r in trie.trie_of(frame(spark, rows)).collect()}
    assert got[1]["ends_sha256"] == hashlib.sha256(",".join(str(c * 7) for c in range(3000)).encode()).hexdigest()
    assert (got[1]["n_convs"], got[1]["saved_tokens"], got[0]["n_children"]) == (3000, 2999 * 4, 1)


def test_against_sql(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.read.parquet(f"{SMALL}/conversations.parquet").unionByName(frame(spark, rows_of(5)).select("conv_id", "turn", "role", "text").withColumn("conv_id", F.col("conv_id") + 300)).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL["op12_prefix_trie"])
    columns = [c[0] for c in want.description]
    got = queries.op12_prefix_trie(spark, str(tmp_path))
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)
