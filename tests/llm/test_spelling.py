"""Operator 13 against plain loops over all pairs, and against its SQL."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from vergraph.llm import queries, spelling

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n long, word string, list string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "w", "l") for i, t in rows], SCHEMA).repartition(3)


def near(x, y):
    x, y = sorted((x, y), key=len)
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def plain(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            counts[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 31 == 0 else low] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    best = {w: sorted((-n[y], y) for y in n if near(w, y)) for w in n}
    form = {w: b[0][1] if b and -b[0][0] >= 10 * n[w] else None for w, b in best.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n[w], len(best[w]), n[form[w]] if form[w] else None) for w in n), key=str)


def rows_of(seed):
    rng = np.random.default_rng(seed)
    letters = "abÉé×"

    def word(size, kinds):
        return "".join(letters[i] for i in rng.integers(0, kinds, size))

    rows = [(i, " ".join(word(int(rng.integers(6, 10)), 2 + i % 2) for _ in range(60))) for i in range(25)]
    chain = ["aabbaabb", "aabbaabbb", "aabbaabbbé", "aabbaabbbéé"]
    rows += [(100 + k, f"{w}, " * (3 * 12**k)) for k, w in enumerate(chain)]
    rows += [(200, None), (201, ""), (202, "123 !!"), (203, "Zürichsee zürichsee ZÜRICHSEE"), (None, "baabaab baabaab baabaaé"), (204, "tie-tie"), (205, "x" * 700 + " " + "x" * 700 + " " + "x" * 699 + " " + "x" * 699)]
    return rows + [(206, "gleichesWort gleichesWort")] * 2


@pytest.mark.parametrize(("most", "block"), [(spelling.MOST, spelling.BLOCK_BYTES), (5, 4096), (1, 1 << 20)])
def test_against_all_pairs(spark, most, block):
    """Whole lists, lists divided until one position is left, and many blocks."""
    rows = rows_of(2)
    got = spelling.variants(frame(spark, rows), most=most, block_bytes=block)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert any(r[2] not in (r[0], r[1]) for r in want)  # a chain


def test_lengths_around_powers_of_two(spark):
    """A pair of which one word is one longer meets wherever the lengths lie."""
    rng = np.random.default_rng(5)
    rows = []
    for k, size in enumerate([15, 16, 17, 31, 32, 33, 63, 64, 65]):
        word = "".join("abcé"[i] for i in rng.integers(0, 4, size))
        at = int(rng.integers(0, size + 1))
        rows.append((k, f"{word} " * 40 + f"{word[:at]}z{word[at:]} " * 3))
    got = spelling.variants(frame(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_empty(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, [(1, None), (2, "short words only here")])).count() == 0


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op13_spelling"])
    columns = [c[0] for c in want.description]
    got = queries.op13_spelling(spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)
