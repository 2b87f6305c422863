"""The ten operators against brute force on small fixtures with odd rows."""

import hashlib
import html
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vergraph.llm import ann, brown, decontaminate, html_text, kernels, minhash, packing, quality, repeats, sharding, suffix, token_store

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


PASSAGE = prose(900, 60)
ROWS = [
    (0, prose(0, 120)), (1, prose(0, 120)), (2, prose(0, 119) + " omega"), (3, None), (4, ""), (5, "   \n\t "), (6, "one two"), (7, "one two"), (8, "One TWO"),
    (9, prose(9, 80) + " " + PASSAGE + " " + prose(10, 40)), (10, prose(11, 50) + "\n" + PASSAGE + "\n" + prose(12, 90)), (11, "é" * 300), (12, "x" + "é" * 260 + "y"),
    (13, "ab " * 400), (14, prose(14, 9000)), (15, prose(15, 30)), (16, "Ünï-cödé 中文 <|endoftext|> it's 12.5% «ok»\r\nnext"), (17, prose(17, 200)), (17, prose(17, 200)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "hot" if i % 3 else ("rare" if i else None), len(t or ""), "x") for i, t in ROWS], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def low(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(0, 50))
        t = rng.integers(0, int(rng.integers(1, 5)) + 1, n).astype(np.uint8)
        if rng.random() < 0.3 and n:
            t = np.tile(t[: max(1, n // 5)], 5)[:n]
        n = len(t)
        sa = suffix.suffix_array(t, 8)
        values = t.tolist()
        assert sa.tolist() == sorted(range(n), key=lambda i: values[i:])
        before, lcp = suffix.permuted_lcp(t, sa)
        for r in range(1, n):
            i, j, k = int(sa[r]), int(sa[r - 1]), 0
            while max(i, j) + k < n and values[i + k] == values[j + k]:
                k += 1
            assert (before[i], lcp[i]) == (j, k)


@pytest.mark.parametrize(("hot", "stretch"), [(2000, 4 << 20), (0, 4 << 20), (2000, 1500)])
def test_repeats(docs, empty, hot, stretch):
    """With hot = 0 every repeated key is split further, with a short stretch long
    rows are cut; nothing may change."""
    raw = [(i, (t or "").encode()) for i, t in ROWS]
    counts = Counter(b[k : k + 200] for _, b in raw for k in range(len(b) - 199))
    want = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if counts[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(b) else 0))
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    got = [tuple(r) for r in repeats.report(repeats.find_repeats(docs, hot=hot, stretch=stretch)).collect()]
    assert sorted(got) == sorted(want)
    if hot and stretch > 1500:
        assert repeats.report(repeats.find_repeats(empty)).count() == 0
        left = {r["doc_id"]: r["text"] for r in repeats.without_repeats(repeats.find_repeats(docs)).collect()}
        assert left[0] == "" and PASSAGE not in left[9] and left[6] == "one two"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_near_duplicates(spark, docs, empty):
    base = prose(50, 300).split()
    more = [(100 + k, " ".join(base[:k] + ["changed"] * 3 + base[k + 3 :])) for k in range(0, 60, 4)]
    rows = [r for r in ROWS if r[0] != 17] + more + [(17, prose(17, 200))]
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and sets[b]:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r) for r in minhash.near_duplicates(frame).collect()}
    assert got == {i: (i, len(sets[i]), find(i), find(i) == i) for i in ids}
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.near_duplicates(docs).count() == len(ROWS)


def test_many_components_in_a_band(spark, monkeypatch):
    """Chunks of two members: groups meet in pairs and nothing is lost."""
    monkeypatch.setattr(minhash, "CHUNK", 2)
    base = prose(70, 400).split()
    rows = [(k, " ".join(base[: 400 - 3 * k] + [f"other{k}x{i}" for i in range(3 * k)])) for k in range(0, 60)] + [(100 + k, " ".join(base[:300] + [f"end{k}x{i}" for i in range(100)])) for k in range(12)]
    sets = {i: shingles(t) for i, t in rows}
    want = {i: {i} for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and want[a] is not want[b]:
                want[a] |= want[b]
                for i in want[b]:
                    want[i] = want[a]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: min(own) for i, own in want.items()} and len({min(own) for own in want.values()}) > 10


def encoded(end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [(i, np.array(t.encode(x or "", add_special_tokens=False).ids + [end], "<u4")) for i, x in ROWS]


def test_token_store(spark, docs, empty):
    folder = token_store.write_store(docs)
    want, start = [], 0
    for i, ids in encoded(2):
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_store.read_store(spark, folder).collect()) == want
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in token_store.read_ids(spark, folder).collect()) == sorted((i, tuple(ids.tolist())) for i, ids in encoded(2))
    chunks = spark.read.parquet(f"{folder}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert token_store.read_store(spark, token_store.write_store(empty)).count() == 0
    bad = chunks.withColumn("ids", F.concat(F.lit(b"\x01\x00"), F.expr("substring(ids, 3)")))
    bad.write.parquet(f"{folder}-bad/chunks")
    for name in ("recipes", "manifest"):
        spark.read.parquet(f"{folder}/{name}").write.parquet(f"{folder}-bad/{name}")
    with pytest.raises(Exception, match="damaged"):
        token_store.read_store(spark, f"{folder}-bad").collect()


TOKENS = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|> a <|endoftext|>", "Hello<|endoftext|>", "hello.<|startoftext|>X", "HELLO hello HeLLo", "İstanbul ıI ſ K", "l'été L'ÉTÉ it's IT'S", "<|endoftext|", "a\u00a0b\u2003c"]


def test_ids_are_those_of_the_library(spark, tmp_path):
    """Added tokens in any case and order; tokenizers that cut in other ways; wide ids."""
    import public_tokenizers
    from tokenizers import AddedToken, Tokenizer, models, pre_tokenizers

    from vergraph.llm import encoding

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    for texts in (TOKENS, TOKENS[::-1], sorted(TOKENS, key=len)):
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        want = [tuple(own.encode(t, add_special_tokens=False).ids) for t in texts]
        got = {r["doc_id"]: tuple(r["ids"]) for r in token_store.read_ids(spark, token_store.write_store(rows)).collect()}
        assert [got[i][:-1] for i in range(len(texts))] == want
    coder = encoding.encoder(path)
    assert coder.pieces and coder.letters_alone
    spaced = Tokenizer.from_file(path)
    spaced.add_tokens([AddedToken("new york"), AddedToken("foo")])
    words = Tokenizer(models.WordLevel({"[UNK]": 0, "Alpha": 1, "alpha": 70_000, ".": 3}, "[UNK]"))
    words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    for name, other in (("spaced", spaced), ("words", words)):
        file = str(tmp_path / f"{name}.json")
        other.save(file)
        texts = ["I like new york and foobar", "alpha Alpha. alpha", *TOKENS]
        raw = [t.encode() for t in texts]
        ids, counts = encoding.WordEncoder(file).encode(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [other.encode(t, add_special_tokens=False).ids for t in texts]
    wide = str(tmp_path / "words.json")
    rows = spark.createDataFrame([(1, "alpha alpha Alpha")], "doc_id long, text string")
    assert token_store.read_ids(spark, token_store.write_store(rows, tokenizer=wide)).first()["ids"] == [70_000, 70_000, 1, 2]
    assert token_store.read_store(spark, token_store.write_store(rows, tokenizer=wide)).first()["ids_crc32"] == zlib.crc32(np.array([70_000, 70_000, 1, 2], "<u4").tobytes())
    with pytest.raises(ValueError):
        token_store.write_store(rows, tokenizer=wide, width=2)


def test_crc_join():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.bytes(int(rng.integers(0, 40))), rng.bytes(int(rng.integers(0, 3000)))
        assert token_store.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_packing(spark, docs, empty):
    one = docs.dropDuplicates(["doc_id"])
    pieces = packing.pack(one, window=64, quantum=8).toPandas()
    ids = dict(encoded(1))
    for i, own in pieces.sort_values("start").groupby("doc_id"):
        at = 0
        for p in own.itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[i][at : at + p.length].tobytes()) and p.doc_tokens == len(ids[i])
            at += p.length
        assert at == len(ids[i])
    assert set(pieces.doc_id) == set(ids)
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == np.append(0, np.cumsum(own.length)[:-1]).tolist() and own.length.sum() <= 64
    assert len(set(pieces.sequence_id)) * 64 - pieces.length.sum() < 64 and set(pieces.sequence_id) == set(range(len(set(pieces.sequence_id))))
    assert packing.pack(empty).count() == 0


def test_windows_keep_their_shares(spark):
    """Every window has each queue's target share, to a quantum, until a queue runs dry."""
    rng = np.random.default_rng(6)
    rows = [(i, prose(3000 + i, int(rng.integers(5, 90))), ["a", "b", "c"][0 if i % 6 < 4 else i % 6 - 3]) for i in range(300)] + [(1000 + i, "one", f"small {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for weights in (None, {"a": 1, "b": 2, "c": 1}):
        pieces = packing.pack(docs, window=128, quantum=8, weights=weights).cache()
        tokens = {r["queue"]: r["n"] for r in pieces.groupBy("queue").agg(F.sum("length").alias("n")).collect()}
        total = sum(tokens.values())
        assert len(tokens) == 43 and pieces.agg(F.max("sequence_id")).first()[0] == (total - 1) // 128
        target = {q: n / total for q, n in tokens.items()} if weights is None else {"a": 0.25, "b": 0.5, "c": 0.25}
        shares = packing.window_shares(pieces).toPandas()
        dry = min(tokens[q] / target[q] for q in "abc") // 128 - 12  # short quanta come last
        for q in "abc":
            own = shares[(shares["queue"] == q) & (shares.sequence_id < dry)]
            assert len(own) > 5 and (abs(own.share - target[q]) <= 2 * 8 / 128 + 1e-9).all()
            assert abs(own.share.mean() - target[q]) < 0.02  # what is owed is carried on


def test_decontaminate(spark, docs, empty):
    items = spark.createDataFrame([(1, PASSAGE[:120]), (2, "one two"), (3, None), (4, "..."), (22, "ONE, two!"), (5, prose(15, 30))], "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows: dict = {}
    for i, t in [(r["item_id"], r["text"]) for r in items.collect()]:
        w = pattern.findall(low(t))
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    want = []
    for i, t in ROWS:
        w, hit, found = pattern.findall(low(t)), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    found |= windows[tuple(w[a : a + k])]
                    hit |= set(range(a, a + k))
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    twice = docs.union(spark.createDataFrame([(6, "nothing of it", "en", None, 0, ""), (2, PASSAGE, "en", None, 0, "")], DOCS))  # ids that repeat with other texts
    hit = {i for i, *_, c in want if c}
    for part in (10**6, 200):
        got = decontaminate.report(decontaminate.find_contamination(docs, items, part_bytes=part))
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
        got = [tuple(r)[:3] for r in decontaminate.report(decontaminate.find_contamination(twice, items, part_bytes=part)).collect()]
        assert len(got) == len(ROWS) + 2 and (6, 3, 0) in got and (6, 2, 2) in got and sum(g[0] == 2 for g in got) == 2
        kept = decontaminate.drop_contaminated(twice, items, part_bytes=part)
        assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([i for i, _ in ROWS if i not in hit] + [6])
        clash = docs.withColumnsRenamed({"extra": "runs", "lang": "row"})
        cut = decontaminate.remove_spans(clash, items, part_bytes=part)
        assert cut.columns == clash.columns
        cut = {r["doc_id"]: r["text"] for r in cut.collect()}
        assert cut[6] == "" and cut[8] == "" and cut[3] is None and cut[15] == "" and len(cut) == len({i for i, _ in ROWS})
    assert decontaminate.report(decontaminate.find_contamination(empty, items)).count() == 0
    none = items.limit(0)
    assert decontaminate.report(decontaminate.find_contamination(docs, none)).where("contaminated").count() == 0


@pytest.mark.parametrize("chunk", [100_000, 2])
def test_sharding(docs, empty, chunk, monkeypatch):
    """In one chunk of runs, and in many that come back by file."""
    monkeypatch.setattr(sharding, "CHUNK", chunk)
    got = sharding.shard_by_load(docs, 3).collect()
    assert len(got) == len(ROWS)
    size = {i: len((t or "").encode()) + 1 for i, t in ROWS}
    assert all(r["size"] == size[r["doc_id"]] for r in got)
    texts = dict(ROWS)
    assert all(r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in got)
    for s in {r["shard"] for r in got}:
        own = [r["slot"] for r in got if r["shard"] == s]
        assert sorted(own) == list(range(len(own)))
    where: dict = {}
    for r in got:
        where.setdefault(texts[r["doc_id"]] or "", set()).add(r["shard"])
    assert all(len(v) == 1 for v in where.values())
    assert sharding.shard_by_load(empty).count() == 0
    # the same loads as one group at a time from a heap
    loads = [0] * 3
    for load in sorted((sum(size[i] for i, t in ROWS if (t or "") == g) for g in {t or "" for _, t in ROWS}), reverse=True):
        loads[loads.index(min(loads))] += load
    assert sorted(sum(r["size"] for r in got if r["shard"] == s) for s in range(3)) == sorted(loads)


def test_runs_are_dealt_as_from_a_heap():
    rng = np.random.default_rng(12)
    for _ in range(300):
        shards = int(rng.integers(1, 9))
        runs = [(int(x), int(rng.integers(1, 200))) for x in set(rng.integers(1, 50, 6).tolist())] + [(5000, 1)] * int(rng.integers(2))
        loads = [0] * shards
        for load, got in sharding.schedule(sorted(runs, reverse=True), [0] * shards):
            want = [0] * shards
            for _ in range(dict(runs)[load]):
                s = loads.index(min(loads))
                loads[s] += load
                want[s] += 1
            assert got == want


def test_language_model(docs, empty):
    rows = {(r["doc_id"], r["held_out"]): r for r in brown.fit_and_score(docs, classes=4, clustered=8, known=16).collect()}
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", low(t)), zlib.crc32(str(i).encode()) % 7 == 2) for i, t in ROWS]
    c = Counter(w for _, words, held in tokens if not held for w in words)
    n_docs = sum(not held for *_, held in tokens)
    n, v = sum(c.values()) + n_docs, len(c) + 1
    for i, words, held in tokens:
        r = rows[i, held]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words) + math.log10((n_docs + 1) / (n + v + 1))
        assert r["base_score"] == pytest.approx(base) and r["n_tokens"] == len(words) + 1 and r["n_known"] == sum(w in c for w in words) + 1
        assert r["train_tokens"] == n and r["score"] < 0
    assert sum(r["score"] for r in rows.values()) > sum(r["base_score"] for r in rows.values())
    assert brown.fit_and_score(empty).count() == 0


def word_key(word: str) -> np.ndarray:
    raw = np.frombuffer(word.encode(), np.uint8)
    return kernels.Words(raw, np.array([0, len(raw)]), kernels.NOT_SPACE).hash


def class_finder(model, rare):
    rows = {r["key"]: r["cls"] for r in rare.collect()}

    def class_of(word):
        key = word_key(word)
        slot = int(model.slots(key)[0])
        return int(model.cls[slot]) if slot < model.size else rows.get(int(key.view(np.int64)[0]), model.tail)

    return class_of


def test_every_training_word_is_placed(spark):
    """Rare words that behave as frequent ones join their classes, in the table or not."""
    left, right = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rng = np.random.default_rng(8)
    pick = lambda words: words[min(int(rng.exponential(6)), 39)]
    texts = [" ".join(w for _ in range(20) for w in (pick(left), pick(right))) for _ in range(60)] + ["a39 b39 b38"]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    words = Counter(w for t in texts for w in t.split())
    for known in (8, 1000):
        model, rare = brown.fit(train, classes=4, clustered=6, known=known)
        class_of = class_finder(model, rare)
        rows = rare.collect()
        assert (model.cls < 4).all() and all(r["cls"] < 4 for r in rows) and len(model.cls) + len(rows) == len(words)
        assert sum(model.counts) + sum(r["n"] for r in rows) == sum(words.values()) == model.total - len(texts)
        assert np.allclose((10 ** model.log_transition[:, :6]).sum(axis=1), 1)
        sides = [{class_of(w) for w in side if words[w] > 3} for side in (left, right)]
        assert not sides[0] & sides[1]


@pytest.mark.parametrize("known", [3, 12, 1000])
def test_scores_by_brute_force(docs, known):
    """Given the words' classes, every score follows from plain counts, wherever
    a word's class is kept; after any word all outcomes sum to one."""
    train = docs.where(~brown.held_out())
    model, rare = brown.fit(train.select("text"), classes=4, clustered=8, known=known)
    class_of = class_finder(model, rare)
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", low(t)), zlib.crc32(str(i).encode()) % 7 == 2) for i, t in ROWS]
    count = Counter(w for _, words, held in tokens if not held for w in words)
    tail, end, start = 4, 5, 6
    table = np.zeros((7, 7))
    for _, words, held in tokens:
        if not held:
            c = [start, *map(class_of, words), end]
            np.add.at(table, (c[:-1], c[1:]), 1)
            for k, w in enumerate(words):
                if count[w] == 1:  # what stands around it, but for rare words around rare ones
                    for side, other in ((-1, words[k - 1] if k else None), (1, words[k + 1] if k + 1 < len(words) else None)):
                        if other is None or model.slots(word_key(other))[0] < model.size:
                            cell = (c[k], tail) if side < 0 else (tail, c[k + 2])
                            table[cell] += 1
    filled = [any(class_of(w) == c for w in count) or c >= tail for c in range(6)]
    unigram = table.sum(axis=0)[:6] + filled
    move = np.log10(np.maximum((table[:, :6] + brown.PRIOR * unigram / unigram.sum()) / (table[:, :6].sum(axis=1, keepdims=True) + brown.PRIOR), 1e-300))
    members, sizes = Counter(map(class_of, count)), Counter()
    for w, n in count.items():
        sizes[class_of(w)] += n

    def emit(w):
        c = class_of(w)
        return math.log10((count[w] + 1) / (sizes[c] + members[c])) if c != tail else 0.0

    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in brown.score(docs.select("doc_id", "text", brown.held_out().alias("held_out")), model, rare).collect()}
    for i, words, _ in tokens:
        c = [start, *map(class_of, words), end]
        assert got[i, len(words) + 1] == pytest.approx(sum(move[a, b] for a, b in zip(c, c[1:], strict=False)) + sum(map(emit, words)), abs=1e-6)
    for before in ("", "alpha", "omega", "neverseen"):
        row = move[class_of(before) if before else start]
        total = sum(10 ** (row[class_of(w)] + emit(w)) for w in count) + 10 ** row[tail] + 10 ** row[end]
        assert total == pytest.approx(1)


def test_exchange_finds_groups():
    rng = np.random.default_rng(2)
    pairs = np.zeros((20, 20))
    for i in range(20):
        for j in range(20):
            if i % 2 != j % 2:
                pairs[i, j] = rng.integers(20, 60)
    own = brown.exchange(pairs, 2)
    assert len({own[i] for i in range(0, 20, 2)}) == 1 and len({own[i] for i in range(1, 20, 2)}) == 1 and own[0] != own[1]


def test_quality(spark, empty):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(400):
        words = prose(1000 + i, int(rng.integers(20, 80))).split()
        grade = i % 3
        if grade == 0:
            words[int(rng.integers(len(words)))] = "vile"
        text = " ".join(w.upper() + "!!" for w in words) if grade == 1 else " ".join(words)
        rows.append((i, text))
        if i < 300:
            labels.append((i, int(grade != 1), int(grade == 0)))
    frame = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    given = spark.createDataFrame([*labels, (None, 1, 0), (5000, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.grade_texts(frame, quality.grades_of(given)).collect()}
    assert len(got) == 402
    right = [got[i]["keep"] == (i % 3 == 2) for i in range(300, 400)]
    assert sum(right) >= 97
    assert all(got[i]["p_1"] >= got[i]["p_2"] for i in range(400))
    kept = quality.select_texts(frame, quality.grades_of(given))
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["keep"]}
    twice = frame.union(frame.where("doc_id < 30"))  # copies of a document count once, few bytes of features are few rows
    again = {r["doc_id"]: r for r in quality.grade_texts(twice, quality.grades_of(given)).collect()}
    assert all(again[i]["p_2"] == got[i]["p_2"] for i in got)
    few = quality.fit(frame, quality.grades_of(given), max_bytes=5000)
    assert few is not None and few.w.astype(bool).sum() < 200
    nothing = given.limit(0)
    assert quality.grade_texts(frame, quality.grades_of(nothing)).where("keep").count() == 402
    assert quality.grade_texts(empty, quality.grades_of(given)).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 15))
    x[300:500] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 15), (902, [float("nan")] * 15), (903, [1.0, None] + [0.0] * 13), (904, [1.0, 2.0]), (None, x[0].tolist())]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int").repartition(3)
    got: dict = {}
    for r in ann.search(frame, F.col("vec_id") % 20 == 0, block=256).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 900, 20):
        s = ann.inner_products(x[q][None, :], x)
        order = [j for j in np.lexsort((np.arange(900), -s)).tolist() if j != q][:20]
        assert [r[0] for r in got[q]] == list(range(1, 21))
        assert [r[2] for r in got[q]] == sorted((r[2] for r in got[q]), reverse=True)
        assert all(r[2] == pytest.approx(s[r[1]]) for r in got[q])
        hits += len({r[1] for r in got[q]} & set(order))
    assert set(got) == set(range(0, 900, 20)) and hits >= 0.97 * 20 * 45
    again: dict = {}  # in many blocks, tiles and waves with a rising floor
    for r in ann.search(frame, F.col("vec_id") % 20 == 0, sample=256, floor_sample=64, block=40, tile=10).orderBy("query_id", "rank").collect():
        again.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(again) == set(got) and sum(len({r[1] for r in got[q]} & {r[1] for r in again[q]}) for q in got) >= 0.97 * 20 * 45
    few = ann.search(frame.where("vec_id < 5"), F.col("vec_id") % 20 == 0)
    assert few.count() == 4
    assert ann.search(frame.where("vec_id = 900"), F.col("vec_id") % 20 == 0).count() == 0


def test_recall_beyond_the_sample(spark):
    """Against brute force on four times as many vectors as the codebooks and floors see."""
    rng = np.random.default_rng(31)
    x = rng.normal(size=(20_000, 24)) * rng.uniform(0.5, 2, (20_000, 1))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.search(frame, F.col("vec_id") % 400 == 0, sample=4096, floor_sample=512).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 20_000, 400):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.97 * 20 * 50


def test_html(spark):
    page = (
        "<html><head><title>T</title><script>if (a < b) '<p>no</p>'</script></head><body><nav><ul><li><a href=1>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies.</div>"
        "<article><h1>Head &amp; line</h1><p>First\n  text of the <b>page</b>.<p>Second&nbsp;&#233;.</p><form><p>Subscribe</p></form><section id=comments><p>I like it.</p></section></article><footer>&copy; x</footer></body></html>"
    )
    assert html_text.main_text(page) == "Head & line\nFirst text of the page.\nSecond é."
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p>Only one short line here"), (4, "u", "<p>Only one short line here"), (5, "u", "<div" + "<p>" * 5000)]
    got = html_text.extract_main_text(spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, extra int")).collect()
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["text"] for r in got}[4] == "Only one short line here"
    assert html_text.second_pass([1, 0, 0, 0, -1], [False] * 5) == [1, 1, 1, -1, -1]


def test_html_containers_with_names():
    text = "This is the text of the article, and it is long enough to be one that was written for the page by people who have more to say. It goes on for a while."
    article = f"<article><h1>Head</h1><p>{text}</p></article>"
    for name in ("class='content-with-sidebar'", "class='no-sidebar'", "id='page-has-header'", "class='layout-sidebar'", "class='social'", "class=\"a widget-area\""):
        for inner in (article, article.replace("article>", "main>")):
            page = f"<body><div class=ad><p>{text} Buy.</p></div><div {name}><div>{inner}</div></div><div class='site-footer'><p>{text} Imprint.</p></div></body>"
            assert html_text.main_text(page) == f"Head\n{text}"
    page = "<body><div class='{}'><p>" + text + "</p><p>" + text + " More.</p></div><div class='{}'><p>" + text + " Left out.</p></div></body>"
    assert html_text.main_text(page.format("page-sidebar", "comments")) == f"{text}\n{text} More."
    for name in ("ad", "site-header", "cookie-notice", "sidebar-left", "comments", "nav-links", "ad-slot-2"):
        page = f"<body><p>{text}</p><p>{text} More.</p><div class='{name}'><p>{text} Left out.</p></div></body>"
        assert html_text.main_text(page) == f"{text}\n{text} More."
    page = f"<body>{article}<div id=comments><article><p>{text} A comment.</p></article></div></body>"
    assert html_text.main_text(page) == f"Head\n{text}"


def test_lost_chunk(spark, docs):
    folder = token_store.write_store(docs)
    chunks = spark.read.parquet(f"{folder}/chunks")
    lost = chunks.orderBy("digest").first()["digest"]
    chunks.where(F.col("digest") != F.lit(bytes(lost))).write.parquet(f"{folder}-lost/chunks")
    for name in ("recipes", "manifest"):
        spark.read.parquet(f"{folder}/{name}").write.parquet(f"{folder}-lost/{name}")
    for read in (token_store.read_store, token_store.read_ids):
        with pytest.raises(Exception, match="missing"):
            read(spark, f"{folder}-lost").collect()


def test_html_marks_are_evidence():
    text = "This is the text of the article, and it is long enough to be one that was written for the page by people who have more to say. It goes on for a while."
    body = f"<h1>Head</h1><p>{text}</p><p>Short one.</p><p>{text} More.</p>"
    want = f"Head\n{text}\nShort one.\n{text} More."
    nav = "<ul><li><a href=/a>One link</a></li><li><a href=/b>Another link</a></li></ul>"
    for start, end in (("<form action=/x>", "</form>"), ("<div class='layout has-sidebar'>", "</div>"), ("<div class='post-content no-sidebar'>", "</div>"), ("<div class='elementor-widget-text'>", "</div>"), ("<div class='wrapper header-fixed'>", "</div>")):
        for inner in (body, f"<article>{body}</article>"):
            assert html_text.main_text(f"<body>{start}{nav}<div>{inner}</div>{end}<footer><p>{text} Imprint.</p></footer></body>") == want
    # an article element with little of the page's good text marks nothing
    teaser = f"<body><div>{body}</div><article><a href=/x>A teaser with a link to some other page of the site</a></article></body>"
    assert html_text.main_text(teaser) == want
    # inside an article links still go
    assert html_text.main_text(f"<article><p>{text}</p><p><a href=/>Some other text that is all link, in an article</a></p><p>{text}</p></article>") == f"{text}\n{text}"
    # without any name or mark the measures alone decide
    assert html_text.main_text(f"<body><div>{nav}</div><div>{body}</div><div><a href=/>Terms of use</a> <a href=/>Contact</a></div></body>") == want
    for page in ("<div>" * 20_000 + "</x>" * 20_000, "<noscript>" * 20_000 + "text", "<p>" + "<b class='" * 20_000):
        start = time.time()
        html_text.main_text(page)
        assert time.time() - start < 5


def test_html_without_article_marks(spark):
    """The rules find the marked articles of whole pages when the marks are gone."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in pages:
        marked = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        gold = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|h2|h3|ul|ol|li|div|blockquote|table|tr|td)\b[^>]*>", re.sub(r"<br/?>\s*", " ", marked))]
        gold = "\n".join(b for b in gold if b)
        assert html_text.main_text(r["html"]) == gold
        assert html_text.main_text(re.sub("</?article>", "", r["html"])) == gold


ARTICLE = "This is the text of the article, and it is long enough to be one that was written for the page by people who have more to say."


@pytest.mark.parametrize(
    "page",
    [
        '<div title="The hidden valley"><article><p>%s</p></article></div>', '<article><p title="hidden gem">%s</p></article>', '<section data-overflow="hidden"><p>%s</p></section>', '<div data-id="sidebar"><p>%s</p></div>',
        '<div data-role="navigation"><p>%s</p></div>', '<div title="class=comments"><p>%s</p></div>', "<div title=it's><p>%s</p></div>", "<p><img alt=o'clock src=x>%s</p>", '<div data-x=a"b class=x><p>%s</p></div>', "<div class = 'text'\n><p>%s</p></div>",
    ],
)
def test_html_attributes_lose_no_text(page):
    assert html_text.main_text(f"<body>{page % ARTICLE}</body>") == ARTICLE


def test_html_names_inside_a_line():
    page = f"<article><p>{ARTICLE} A sentence <span class='share'>with</span> words <b class=\"related\">in</b> <span class='notice'>it</span>.</p><p><span class='ad'>{ARTICLE} Buy it.</span></p></article>"
    assert html_text.main_text(page) == f"{ARTICLE} A sentence with words in it."


def test_html_attributes_against_a_parser():
    from html.parser import HTMLParser

    found = []

    class Tags(HTMLParser):
        def handle_starttag(self, tag, attrs):
            found.append({k: v or "" for k, v in reversed(attrs)})

    rng, compared = np.random.default_rng(4), 0
    pieces = ["class", "id", "data-id", "hidden", "title", " = ", "=", "'", '"', "'a b'", '"it\'s > x"', "x=y", "/", " ", "\n", "it's", "o'clock", '"hidden"', "hidden=hidden", " class=ad ", "é"]
    for _ in range(12000):
        # an equals sign where a name should begin is read in more than one way, and quotes may stay open
        text = " ".join(["".join(pieces[i] for i in rng.integers(0, len(pieces), 4)) for _ in range(3)])
        if re.search(r"(^|[\s/=\"'])\s*=", text) or text.count('"') % 2 or text.count("'") % 2:
            continue
        page = f"<div {text}>"
        found.clear()
        Tags(convert_charrefs=False).feed(page)
        m = html_text.TOKEN.match(page)
        own = {}
        for name, value in html_text.ATTRIBUTE.findall(m[3]):
            own.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') else value)
        assert page.startswith(m[0])
        if found and m[0] == page:
            compared += 1
            assert {k: own.get(k) for k in ("class", "id", "hidden", "title")} == {k: found[0].get(k) for k in ("class", "id", "hidden", "title")}, page
    assert compared > 300


def test_html_deep_nesting_is_linear():
    for inner in ("<p>This is paragraph number {} of the text and it is there for the page.</p>", "<article><p>This is number {} of the teasers and it is there for the page.</p></article>"):
        page = "".join(f"<div class='x-widget'>{inner.format(i)}" for i in range(1600)) + "</div>" * 1600
        start = time.time()
        html_text.main_text(page)
        assert time.time() - start < 1
