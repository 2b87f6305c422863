"""The pipeline over the smallest tables, stage by stage."""

import re
from collections import Counter

import numpy as np

import corpus_pipeline
from vergraph.llm import minhash, quality

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = corpus_pipeline.table(spark, SMALL, "documents")
    before = docs.columns
    labels = corpus_pipeline.table(spark, SMALL, "labels")
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    pieces = corpus_pipeline.run(spark, SMALL)
    ids = {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()}
    all_ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert ids <= all_ids and len(ids) > 0.6 * len(all_ids) and len(ids & toxic) <= 0.35 * len(toxic)
    first = corpus_pipeline.STAGES[0][1](spark, docs, SMALL)
    assert first.columns == before
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "decontamination", "packing"]


def test_empty(spark):
    docs = corpus_pipeline.table(spark, SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() == 0
        docs = docs if "sequence_id" in out.columns else out


def text_pairs(n):
    """Pairs of texts with a similarity from 0.80 to under 0.85."""
    for k in range(n):
        base = [f"w{k}x{i}" for i in range(204)]
        cut = base[:50] + ["other"] + base[51:90] + ["more"] + base[91:130] + ["again"] + base[131:170] + ["last"] + base[171:]
        yield " ".join(base), " ".join(cut)


def test_near_copies_at_the_stage_threshold(spark):
    rows = [(2 * k + j, text, len(text)) for k, pair in enumerate(text_pairs(30)) for j, text in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2 * k for k in range(30)]
    assert minhash.near_duplicates(docs).where("kept").count() == 60
    for percent in (50, 80, 85, 95):
        bands, size = minhash.layout(percent)
        assert bands * size <= minhash.HASHES and (1 - (percent / 100) ** size) ** bands < 5e-7
    assert minhash.layout(85) == (25, 5)


def test_rows_are_told_apart_without_ids(spark):
    """Repeated rows, null ids, and one id with two texts."""
    text = {k: " ".join(f"{k}{i}" for i in range(120)) for k in "abcdef"}
    near = {k: t.replace(f"{k}60 ", "") for k, t in text.items()}
    rows = [(1, text["a"]), (1, text["a"]), (None, text["b"]), (None, text["c"]), (2, text["d"]), (2, text["e"]), (3, near["d"]), (4, near["e"]), (2, near["e"].replace("e20 ", "")), (5, text["f"] + " " + text["c"])]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, True), (1, 1, False), (None, None, True), (None, None, True), (2, 2, True), (2, 2, True), (3, 2, False), (4, 2, False), (2, 2, False), (5, 5, True)], key=str)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    left = {(r["doc_id"], r["text"]) for r in corpus_pipeline.cut_repeats(spark, kept, SMALL).collect()}
    assert kept.count() == 6 and {i for i, _ in left} == {1, None, 2, 5}
    assert (1, text["a"]) in left and (None, text["b"]) in left and (None, "") in left and (2, text["d"]) in left
    assert all(t.startswith(text["f"]) and len(t) < len(text["f"]) + 5 for i, t in left if i == 5)


LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_near(texts):
    """Which rows stay: the first of the smallest id in each component."""
    sets = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    meet = {}
    for i, s in enumerate(sets):
        for g in s if texts[i][0] is not None else ():
            meet.setdefault(g, []).append(i)
    both = Counter((a, b) for own in meet.values() for k, a in enumerate(own) for b in own[k + 1 :])
    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    best = {}
    for i, (name, _) in enumerate(texts):
        best.setdefault(find(i), []).append((name is None, name, i))
    return {min(own)[2] for own in best.values()}


def brute_cut(raw):
    """Texts without their repeated strings of 200 bytes, in whole characters."""
    counts = Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if counts[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        left, at = b"", 0
        for a, e in np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8)]))).reshape(-1, 2).tolist():
            while a < e and b[a] & 0xC0 == 0x80:
                a += 1
            while e > a and e < len(b) and b[e] & 0xC0 == 0x80:
                e -= 1
            left, at = left + b[at:a], e
        out.append((left + b[at:]).decode())
    return out


def test_run_against_brute_force(spark, tmp_path):
    """The whole pipeline over a table with odd rows: nulls, repeated rows, near
    copies, shared passages, benchmark passages, a long text, clashing names."""
    import public_tokenizers
    from tokenizers import Tokenizer

    source = spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars < 4000").orderBy("doc_id").collect()[:90]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("length(text) > 100").first()["text"]
    rows = [(r["doc_id"], r["text"], r["source"]) for r in source]
    base, other = next(t for _, t, _ in rows if t and 1500 < len(t)), [t for _, t, _ in rows if t and len(t) > 900][1]
    rows += [(None, base.replace(" ", "  ", 3), "x"), (rows[5][0], rows[5][1], rows[5][2]), (5000, None, None), (5001, "", "x"), (5002, base[:1200] + " " + other[:800], "x"), (5003, other[:300] + " " + item + " " + other[:250], "y"), (5004, " ".join(f"{w} {i}" for i, w in enumerate((base + other).split() * 12)), "z")]
    folder = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, "k") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, runs long, row long, key string").repartition(3)
    docs.write.parquet(f"{folder}/documents.parquet")
    for name, frame in (("labels", labels), ("benchmark", spark.read.parquet(f"{SMALL}/benchmark.parquet"))):
        frame.write.parquet(f"{folder}/{name}.parquet")

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.select_quality(spark, docs, folder)
    graded = quality.grade_texts(docs, quality.grades_of(labels)).where("keep").collect()
    texts = [(r["doc_id"], r["text"], r["source"]) for r in kept.collect()]
    assert Counter(t[0] for t in texts) == Counter(r["doc_id"] for r in graded) and 60 < len(texts)
    stay = brute_near([t[:2] for t in texts])
    texts = [t for i, t in enumerate(texts) if i in stay]
    cut = brute_cut([(t or "").encode() for _, t, _ in texts])
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = LETTERS.findall(low(r["text"]))
        k = min(10, len(w))
        windows |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1 if k else 0)}
    sizes = {len(w) for w in windows}
    clean = []
    for (i, _, s), t in zip(texts, cut, strict=True):
        w = LETTERS.findall(low(t))
        if not any(tuple(w[a : a + k]) in windows for k in sizes for a in range(len(w) - k + 1)):
            clean.append((i, t, s or ""))
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t, s in clean:
        ids = np.array(own.encode(t, add_special_tokens=False).ids + [1], "<u4")
        want[i, s, len(ids)] += 1
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, folder)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{folder}/{name}")
        out = spark.read.parquet(f"{folder}/{name}")
    assert Counter((r["doc_id"], r["text"], r["source"] or "") for r in out.collect()) == Counter(clean)
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    pieces = corpus_pipeline.run(spark, folder).toPandas()
    got = Counter()
    for (i, s, n), p in pieces.groupby(["doc_id", "queue", "doc_tokens"], dropna=False):
        assert p.length.sum() % n == 0
        got[None if np.isnan(i) else int(i), s, int(n)] += int(p.length.sum()) // n
    assert got == want
    assert pieces.length.sum() == sum(n * k for (_, _, n), k in want.items()) and pieces.sequence_id.max() == (pieces.length.sum() - 1) // 2048


def test_lazy_results_stay(spark):
    """Stages called alone delete nothing that a lazy result still reads."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(60)), 1) for i in range(4)], "doc_id long, text string, n_chars long")
    lazy = minhash.near_duplicates(docs)
    even = corpus_pipeline.drop_near_duplicates(spark, docs.where("doc_id % 2 = 0"), SMALL)
    odd = corpus_pipeline.drop_near_duplicates(spark, docs.where("doc_id % 2 = 1"), SMALL)
    corpus_pipeline.select_quality(spark, docs, SMALL).count()
    assert (lazy.where("kept").count(), even.count(), odd.count()) == (4, 2, 2)


def test_two_runs_at_once(spark, tmp_path):
    """Runs share nothing, and leave only their results behind."""
    import os
    from concurrent.futures import ThreadPoolExecutor

    from vergraph.llm import workspace

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars < 2000")
    for k in range(2):
        docs.where(f"doc_id % 2 = {k}").write.parquet(f"{tmp_path}/{k}/documents.parquet")
        for name in ("labels", "benchmark"):
            spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{k}/{name}.parquet")
    shared = workspace.shared_dir(spark).removeprefix("file:") + "/vergraph"
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    with ThreadPoolExecutor(2) as pool:
        results = list(pool.map(lambda k: corpus_pipeline.run(spark, f"{tmp_path}/{k}"), range(2)))
    for k, pieces in enumerate(results):
        ids = {r["doc_id"] % 2 for r in pieces.select("doc_id").distinct().collect()}
        assert ids == {k}
    left = set(os.listdir(shared)) - before
    assert len(left) == 2 and all(os.listdir(f"{shared}/{x}") == ["packing"] for x in left)
