"""Operator 2 against plain loops: features, tails, and what a fit comes to."""

import math
import re

import numpy as np
import pytest

from vergraph.llm import kernels, quality

M = (1 << 64) - 1


def plain_hash(word: bytes) -> int:
    x, power = 0, 1
    for b in word:
        x = (x + int(kernels.LETTER[b]) * power) & M
        power = power * int(kernels.BYTE_BASE) & M
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x ^= x >> 33
        x = x * factor & M
    return x ^ (x >> 33)


def plain_features(text: str | None) -> set[int]:
    raw = (text or "").encode()
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw)
    words = re.findall(rb"[0-9a-z\x80-\xff]+", low)
    index = {plain_hash(w) >> (64 - quality.BITS) for w in words}
    index = {i + 256 if i < 256 else i for i in index}
    letters = len(re.findall(rb"[^\x20\x09-\x0d]", raw))
    plain, upper = len(re.findall(rb"[0-9A-Za-z\x80-\xff]", raw)), len(re.findall(rb"[A-Z]", raw))
    some, n = max(letters, 1), len(words)
    measures = [(letters - plain) / some, upper / some, raw.count(b"|") / some * 5, 1 - len(index) / max(n, 1), min(plain / max(n, 1) / 20, 1), min(math.log2(n + 1) / 16, 1)]
    return index | {16 * i + int(sum(m >= e for e in quality.EDGES)) for i, m in enumerate(measures)}


def tails(model, index):
    f = sum(model.w[i] for i in index)
    return [1 - 1 / (1 + math.exp(-max(-40, min(40, t - f)))) for t in model.t]


TEXTS = ["plain words of a text", "LOUD!! TEXT | WITH | BARS", "a a a a a", None, "", " \n\t ", "12.5% «ok» Ünï 中文", "x" * 500, "word " * 4000, "tie", "tie"]


def test_queries_rows_by_plain_loops(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, f"{'good' if i % 3 else 'bad'} text number {i % 7} here") for i in range(60)] + [(None, "no id")]
    labels = [(100 + i, int(i % 3 > 0), int(i % 3 == 0 and i % 2)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, 1, "g") for i, t in rows], "doc_id long, text string, label int, grade string")
    graded = quality.grades_of(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    model = quality.fit(docs, graded)
    want = []
    for i, t in rows:
        p = tails(model, plain_features(t))
        want.append((i, sum(p), *p, p[-1] >= quality.LEAST))
    got = sorted(map(tuple, quality.grade_texts(docs, graded).collect()), key=str)
    by = {}
    for w in want:
        by.setdefault(w[0], []).append(w)
    assert len(got) == len(want)
    for g in got:
        assert any(g[0] == w[0] and g[4] == w[4] and g[1:4] == pytest.approx(w[1:4], abs=1e-9) for w in by[g[0]])


def loss(model, rows, grade):
    total = 0.0
    for index, y in zip(rows, grade, strict=True):
        p = [1.0, *tails(model, index), 0.0]
        total -= math.log(max(p[y] - p[y + 1], 1e-12))
    return total / len(rows)


def test_equal_rows_get_the_shares_of_their_grades():
    """One feature only: the best tails are the shares of the grades."""
    grade = np.array([0] * 20 + [1] * 50 + [2] * 130)
    rows = [np.array([7], "<i4")] * len(grade)
    model = quality.CumulativeLink(3)
    model.fit(rows, grade)
    assert tails(model, [7]) == pytest.approx([0.9, 0.65], abs=0.04)
    assert model.t[0] < model.t[1]


def test_a_fit_is_near_a_minimum():
    """A fit ends when the loss stays for a few rounds, before the minimum: it has 85 %
    of what going on down the slope of finite differences reaches, and the same signs."""
    rng = np.random.default_rng(2)
    rows, grade = [], []
    for _ in range(300):
        index = np.unique(rng.integers(0, 12, 4)).astype("<i4")
        rows.append(index)
        grade.append(int(np.clip(np.round((index < 4).sum() - (index > 8).sum() + 1 + rng.normal(0, 0.5)), 0, 2)))
    model = quality.CumulativeLink(3)
    model.fit(rows, np.array(grade), l1=0.0, l2=0.0)
    x = np.array([np.isin(np.arange(12), r) for r in rows], float)

    def of(place):
        f, t = x @ place[2:], np.array([-np.inf, *place[:2], np.inf])
        below = 1 / (1 + np.exp(-np.clip(t[None, :] - f[:, None], -40, 40)))
        return -np.log(np.maximum(below[np.arange(300), np.array(grade) + 1] - below[np.arange(300), grade], 1e-12)).mean()

    place = np.concatenate([model.t, model.w[:12]])
    reached, start = of(place), of(np.zeros(14) + np.array([-0.7, 0.7] + [0] * 12))
    assert reached == pytest.approx(loss(model, rows, grade), abs=1e-6) and model.t[0] < model.t[1]
    signs = [k for k in range(12) if abs(model.w[k]) > 0.5]
    assert len(signs) >= 6
    for _ in range(400):  # down the slope of finite differences, from where the fit ended
        slope = np.array([(of(place + d) - of(place - d)) / 2e-4 for d in np.eye(14) * 1e-4])
        place = place - 0.5 * slope
    assert start - reached > 0.85 * (start - of(place))
    assert all(np.sign(model.w[k]) == np.sign(place[2 + k]) for k in signs)


def test_features_come_to_the_driver_in_pieces(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * k % 97}" for k in range(1 + i % 23))) for i in range(120)], "doc_id long, text string")
    graded = docs.selectExpr("doc_id", "cast(doc_id % 3 as int) as grade")
    whole = quality.fit(docs, graded)
    came, fetch = [], type(docs).toArrow

    def fetched(df):
        table = fetch(df)
        if "index" in table.column_names:
            came.append(sum(len(x.as_py()) for x in table["index"]))
        return table

    monkeypatch.setattr(type(docs), "toArrow", fetched)
    monkeypatch.setattr(quality, "PIECE_BYTES", 2_000, raising=False)
    pieces = quality.fit(docs, graded)
    assert len(came) > 1 and max(came) <= 2_000
    assert np.array_equal(whole.w, pieces.w) and np.array_equal(whole.t, pieces.t)
    # a row that is larger than a piece comes alone; what is over the bound of all stays away
    came.clear()
    monkeypatch.setattr(quality, "PIECE_BYTES", 1)
    quality.fit(docs, graded, max_bytes=1_000)
    assert len(came) > 1 and sum(came) <= 1_000
