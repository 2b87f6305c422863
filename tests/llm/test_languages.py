"""Operator 11 against plain loops, by held-out accuracy, and over odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from vergraph.llm import languages

SMALL = "/root/testdata/sf0.01"
STEMS = {"aa": "thing other there with from have".split(), "bb": "lichten unger schaft keiten zwischen für".split(), "cc": "niño señor corazón mañana porque ciudad".split()}


def text(lang: str, seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(STEMS[lang][i] for i in rng.integers(0, 6, n)).capitalize()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, l, "s", len(t or ""), "x", 1) for i, t, l in rows], "doc_id long, text string, lang string, source string, languages int, held_out string, row long")


@pytest.fixture(scope="module")
def rows():
    out = [(i, text("abc"[i % 3] * 2, i, 5 + i % 40), "abc"[i % 3] * 2) for i in range(300)]
    return out + [(900, text("aa", 1, 60) + ". " + text("bb", 2, 40), None), (901, None, "aa"), (902, "", "bb"), (903, "12 ** 34", "cc"), (904, "«»", None), (905, "für", None), (905, "für", None), (None, text("cc", 5, 9), "cc"), (906, text("bb", 8, 400_000), None), (907, "中文" * 5, None)]


def test_split_and_predictions(spark, rows):
    got = languages.identify(frame(spark, rows).repartition(5)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _, _ in rows)
    want = dict((i, l) for i, _, l in rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        assert r["shares"] == sorted(r["shares"], reverse=True)
        if r["doc_id"] is None:
            assert r["lang_pred"] == "cc"
        elif r["doc_id"] < 300:
            assert r["lang_pred"] == want[r["doc_id"]]
    by = {r["doc_id"]: r for r in got}
    assert all((by[i]["lang_pred"], by[i]["score"], by[i]["languages"]) == ("und", 0.0, []) for i in (901, 902, 903, 904))
    assert by[905]["lang_pred"] == by[906]["lang_pred"] == "bb"
    assert by[907]["lang_pred"] in STEMS
    assert by[900]["languages"] == ["aa", "bb"] and abs(by[900]["shares"][0] - 0.6) < 0.05


def test_empty_and_unlabelled(spark, rows):
    assert languages.identify(frame(spark, [])).count() == 0
    got = languages.identify(frame(spark, [(i, t, None) for i, t, _ in rows[:9]])).collect()
    assert len(got) == 9 and {r["lang_pred"] for r in got} == {"und"}


def test_word_probabilities(spark):
    """Plain interpolated n-gram counts give the same logs (orders without hashing: few cells clash)."""
    train = [("aa", "then the other thing"), ("bb", "lichten über ungern")]
    grams = {k: {} for k, _ in train}
    for lang, t in train:
        for w in t.split():
            raw = b" " + w.encode() + b" "
            for j in range(1, len(raw)):
                for n in range(1, min(4, j + 1) + 1):
                    g = raw[j - n + 1 : j + 1]
                    grams[lang][g] = grams[lang].get(g, 0) + 1

    def log_p(lang, w):
        c, raw, out = grams[lang], b" " + w.encode() + b" ", 0.0
        for j in range(1, len(raw)):
            p = 1 / 256
            for n in range(1, min(4, j + 1) + 1):
                g = raw[j - n + 1 : j + 1]
                under = sum(v for k, v in c.items() if len(k) == 1) if n == 1 else c.get(g[:-1], 0)
                p = (c.get(g, 0) + languages.SMOOTHING * p) / (under + languages.SMOOTHING)
            out += np.log(min(p, 1))
        return out

    model = languages.fit(spark.createDataFrame([(t, l) for l, t in train], "text string, lang string"))
    words = "then über there ungern xyz".split()
    bag = languages.Bag(pa.array([" ".join(words)]))
    logs = model.word_logs(bag)
    for k, w in enumerate(words):
        assert np.allclose(logs[bag.word[k]], [log_p("aa", w), log_p("bb", w)], rtol=1e-4)
    folded = languages.fit(spark.createDataFrame([(t, l) for l, t in train], "text string, lang string"), 2 << 20)
    assert folded.fold > 0 and folded.word_logs(bag)[bag.word[0]].argmax() == 0


def test_mixture_steps():
    """Against expectation-maximisation in plain loops, and every set of two by brute force."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        m, kinds = int(rng.integers(1, 40)), 4
        p = rng.random((m, kinds)) ** 4 + 1e-9
        n = rng.integers(1, 5, m).astype(float)
        share = languages.language_sets(p, n, np.zeros(m, np.int64), 0.5)[0]
        assert abs(share.sum() - 1) < 1e-9

        def level(chosen, p=p, n=n):
            now = np.full(len(chosen), 1 / len(chosen))
            for _ in range(3000):
                w = p[:, chosen] * now
                now = (w / w.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
            return (n * np.log((p[:, chosen] * now).sum(axis=1))).sum(), now

        chosen = [int(k) for k in np.flatnonzero(share)]
        reached, exact = level(chosen)
        assert np.abs(exact - share[chosen]).max() < 0.1
        cost = 0.25 * np.log(n.sum() + 1)
        single = max(level([k])[0] for k in range(kinds))
        assert reached - cost * (len(chosen) - 1) >= single - 0.2
    assert (languages.language_sets(np.ones((2, 1)), np.ones(2), np.array([0, 1]), 1.0) == 1).all()


def test_accuracy_on_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = languages.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.99
