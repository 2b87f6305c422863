"""Operator 11: language identification as inference of a multilingual mixture.

A text is a bag of words, each drawn from one of the languages in it.  A
language gives a word the probability of its letters, byte by byte, each after
up to three bytes before it: n-gram counts of orders 1 to 4 over all training
texts, each order smoothed by the one below.  Expectation-maximisation
estimates what share of the words each language of a set has.  The set grows
greedily from the best single language; another one joins as long as the
likelihood gains more than ``penalty`` * log(words) / 2.  The prediction is the
language with the largest share (ties: the smaller name), its score that share.

Training counts come from one scan, summed by language and n-gram in Spark.  The
driver takes the finished table only: n-grams of orders 3 and 4 are hashed to
2**18 cells, so it has at most 590,080 numbers a language; where there are so
many languages that it would pass ``model_bytes``, cells are folded in halves
until it does not.  The table is broadcast and predicting is one more scan.

Defined cases: a null text, or one without a letter, is 'und' with score 0 and
no languages.  A null doc_id counts as the empty text for the split.  Null lang
trains nothing; without any labelled text everything is 'und'.  Repeated rows
train as often as they are there and are predicted one by one.  Very long texts
are read whole, their hashes made stretch by stretch.  An empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import U64, Words, byte_class, ragged, slices
from .workspace import drop_staged, ship, stage

#: Bits of the cells of each order of n-grams, 1 to 4; orders 1 and 2 have a cell each.
BITS = (8, 16, 18, 18)
BASE = np.cumsum([0, *(1 << b for b in BITS)])
MODEL_BYTES, PENALTY, SMOOTHING = 128 << 20, 6.0, 2.0
SPREAD = U64(0x9E3779B97F4A7C15)
#: Small letters, and every byte of a character beyond ASCII.
INSIDE = byte_class(lambda b: 0x61 <= b <= 0x7A or b >= 0x80)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Bag:
    """The words of a slice of texts: each different one once, with its n-grams."""

    def __init__(self, column: pa.Array):
        batch = pa.record_batch([pc.utf8_lower(column)], ["text"])
        ((_, data, off),) = slices(iter([batch]), "text", 1 << 62)
        words = Words(data, off, INSIDE, fold=False)
        self.rows, self.row, self.count = batch.num_rows, words.row, words.count
        self.hash, first, self.word = np.unique(words.hash, return_index=True, return_inverse=True)
        self.n = len(first)
        start, size = words.start[first], words.end[first] - words.start[first]
        # a space before and after every different word
        self.bytes = np.full(int(size.sum()) + self.n + 1, 0x20, np.uint8)
        at = np.cumsum(size + 1) - size
        self.bytes[ragged(at, size)] = data[ragged(start, size)] if self.n else 0
        #: The positions of letters and end spaces, their words, and how many bytes a word has before them.
        self.at = ragged(at, size + 1)
        self.of = np.repeat(np.arange(self.n), size + 1)
        self.before = self.at - np.repeat(at, size + 1) + 1
        self.lettered = self._lettered(data, off)

    def only(self, mask: np.ndarray) -> Bag:
        """The n-grams of some of the different words; for ``cells`` only."""
        out, inside = copy(self), mask[self.of]
        out.n = int(mask.sum())
        out.at, out.before, out.of = self.at[inside], self.before[inside], (np.cumsum(mask) - 1)[self.of[inside]]
        return out

    def _lettered(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        small = np.append(0, np.cumsum((data >= 0x61) & (data <= 0x7A)))
        out = small[off[1:]] > small[off[:-1]]
        for r in np.flatnonzero(~out & (self.count > 0)):  # only characters beyond ASCII
            out[r] = any(map(str.isalpha, data[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace")))
        return out

    def cells(self, order: int, fold: int, at: np.ndarray) -> np.ndarray:
        """The cell of the ``order`` bytes that end at each of the positions."""
        value = np.zeros(len(at), U64)
        for k in range(order - 1, -1, -1):
            value = (value << U64(8)) | self.bytes[np.maximum(at - k, 0)].astype(U64)
        bits = BITS[order - 1]
        cell = (value * SPREAD) >> U64(64 - bits) if order > 2 else (value * SPREAD) & U64((1 << bits) - 1)
        return (cell >> U64(fold)).astype(np.int64) + (int(BASE[order - 1]) >> fold)


class Counts:
    """Counts by 64-bit key, folded as they grow."""

    def __init__(self, most: int = 2_000_000):
        self.most, self.parts, self.held = most, [], 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> bool:
        """True when it is time to take what was counted."""
        self.parts.append((keys, n))
        self.held += len(keys)
        if self.held < 2 * self.most:
            return False
        self.parts = [self.take()]
        self.held = len(self.parts[0][0])
        return self.held > self.most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate([p[i] for p in self.parts]) if self.parts else np.zeros(0, np.int64) for i in (0, 1))
        self.parts, self.held = [], 0
        found, back = np.unique(keys, return_inverse=True)
        return found, np.bincount(back, weights=n, minlength=len(found)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: list[str] = []
    place: dict[str, int] = {}
    counts, cells = Counts(), int(BASE[-1])

    def taken() -> pa.RecordBatch:
        keys, n = counts.take()
        lang = pa.DictionaryArray.from_arrays(pa.array(keys // cells, pa.int32()), pa.array(names, pa.string())).cast(pa.string())
        return pa.record_batch([lang, pa.array(keys % cells, pa.int32()), pa.array(n)], ["lang", "cell", "n"])

    for part, _, _ in slices(batches, "text"):
        bag = Bag(part.column("text"))
        own = np.empty(bag.rows, np.int64)
        for r, name in enumerate(part.column("lang").to_pylist()):
            if name not in place:
                place[name] = len(names)
                names.append(name)
            own[r] = place[name]
        if not bag.n:
            continue
        kinds = own[bag.row]
        grams = [bag.cells(order, 0, bag.at) for order in range(1, 5)]
        for lang in np.unique(kinds).tolist():
            weight = np.bincount(bag.word[kinds == lang], minlength=bag.n)[bag.of]
            for order, cell in enumerate(grams, 1):
                n = np.bincount(cell - BASE[order - 1], weights=np.where(bag.before + 1 >= order, weight, 0))
                found = np.flatnonzero(n)
                if counts.add(lang * cells + BASE[order - 1] + found, n[found]):
                    yield taken()
    if names:
        yield taken()


class Model:
    """Counts of n-grams by language, as the workers need them."""

    def __init__(self, names: list[str], fold: int, table: np.ndarray):
        self.names, self.fold, self.table = names, fold, table
        self.total = table[: 256 >> min(fold, 8)].sum(axis=0, dtype=float)

    def word_logs(self, bag: Bag) -> np.ndarray:
        """Log probability of each different word in each language."""
        p = np.full((len(bag.at), len(self.names)), SMOOTHING / 256, np.float32)
        under = np.broadcast_to(self.total.astype(np.float32), p.shape)
        for order in range(1, 5):
            if order > 1:
                under = self.table[bag.cells(order - 1, self.fold, bag.at - 1)]
            here = self.table[bag.cells(order, self.fold, bag.at)]
            here += p
            here /= under + np.float32(SMOOTHING)
            np.minimum(here, 1, out=here)
            here *= np.float32(SMOOTHING)
            p = here if order == 1 else np.where((bag.before + 1 >= order)[:, None], here, p)
        ends = np.searchsorted(bag.of, np.arange(bag.n))
        return np.add.reduceat(np.log(p / np.float32(SMOOTHING)), ends, axis=0, dtype=float)


class Known:
    """Log probabilities of the words that came first, up to ``most`` of them."""

    def __init__(self, model: Model, most: int = 1 << 18):
        self.model, self.most = model, most
        self.hash, self.logs = np.zeros(0, U64), np.zeros((0, len(model.names)))

    def logs_of(self, bag: Bag) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hash, bag.hash), max(0, len(self.hash) - 1))
        have = self.hash[at] == bag.hash if len(self.hash) else np.zeros(bag.n, bool)
        out = np.empty((bag.n, self.logs.shape[1]))
        out[have] = self.logs[at[have]]
        if not have.all():
            out[~have] = new = self.model.word_logs(bag.only(~have))
            if len(self.hash) < self.most:
                keys = np.concatenate([self.hash, bag.hash[~have]])
                order = np.argsort(keys)
                self.hash, self.logs = keys[order], np.concatenate([self.logs, new])[order]
        return out


def fit(docs: DataFrame, model_bytes: int = MODEL_BYTES) -> Model | None:
    """``docs``: text, lang of the training rows.  None when nothing is labelled."""
    ship(docs.sparkSession)
    labelled = docs.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    counts = labelled.mapInArrow(_count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    counts = stage(counts, "language-counts")
    most = model_bytes // 4 // int(BASE[-1] >> 8)  # of languages, with tables folded eight times
    names = sorted(r["lang"] for r in counts.select("lang").distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} languages do not fit into model_bytes")
    if not names:
        return None
    fold = 0
    while len(names) * 4 * (int(BASE[-1]) >> fold) > model_bytes:
        fold += 1
    ids = counts.sparkSession.createDataFrame(list(enumerate(names)), "language int, lang string")
    folded = counts.join(F.broadcast(ids), "lang").groupBy("language", F.shiftright("cell", fold).alias("cell")).agg(F.sum("n").cast("float").alias("n"))  # at most ``most`` names
    rows = folded.toArrow()  # at most one number for each cell of the table, which is bounded
    table = np.zeros(((int(BASE[-1]) >> fold) + 1, len(names)), np.float32)
    table[rows["cell"].to_numpy(), rows["language"].to_numpy()] = rows["n"].to_numpy()
    drop_staged(counts)
    return Model(names, fold, table)


def shares(p: np.ndarray, n: np.ndarray, row: np.ndarray, bounds: np.ndarray, now: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation for many texts at once, each with as many
    languages.  ``p``: likelihoods of the (text, word) pairs in the text's languages,
    ``n`` their counts, ``row`` their texts, ``bounds`` where a text's pairs start,
    ``now`` the shares to start from.  Returns shares, mixed likelihoods of the
    pairs, log likelihoods of the texts."""
    total = np.add.reduceat(n, bounds)[:, None]
    for _ in range(rounds):
        w = p * now[row]
        w *= (n / w.sum(axis=1))[:, None]
        after = np.add.reduceat(w, bounds, axis=0) / total
        change = np.abs(after - now).max(initial=0)
        now = after
        if change < 2e-3:
            break
    mixed = (p * now[row]).sum(axis=1)
    return now, mixed, np.add.reduceat(n * np.log(mixed), bounds)


def language_sets(p: np.ndarray, n: np.ndarray, row: np.ndarray, penalty: float) -> np.ndarray:
    """Shares of the languages in texts 0, 1, ... (ascending in ``row``, each with a
    pair): zero outside a text's set."""
    bounds = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    least = penalty * np.log(np.add.reduceat(n, bounds) + 1) / 2
    texts, kinds = len(bounds), p.shape[1]
    single = np.add.reduceat(n[:, None] * np.log(p), bounds, axis=0)
    best, level = np.zeros((texts, kinds)), single.max(axis=1)
    active, sets = np.arange(texts), single.argmax(axis=1)[:, None]
    best[active, sets[:, 0]] = 1
    mixed = p[np.arange(len(row)), sets[row, 0]]
    while len(active) and sets.shape[1] < kinds:  # all active texts have sets of one size
        at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        # what a tenth of each further language would add, for the choice of the next one
        gain = np.add.reduceat(n[:, None] * np.log(0.9 + 0.1 * (p / mixed[:, None])), at, axis=0)
        np.put_along_axis(gain, sets, -np.inf, axis=1)
        wider = np.column_stack([sets, gain.argmax(axis=1)])
        start = np.column_stack([0.9 * np.take_along_axis(best[active], sets, axis=1), np.full(len(active), 0.1)])
        now, mixed, reached = shares(np.take_along_axis(p, wider[row], axis=1), n, row, at, start)
        better = reached - level[active] > least[active]
        active, sets = active[better], wider[better]
        level[active], best[active] = reached[better], 0
        best[active[:, None], sets] = now[better]
        inside = better[row]
        p, n, mixed, row = p[inside], n[inside], mixed[inside], (np.cumsum(better) - 1)[row[inside]]
    return best


def _predict(shared, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names, known_words = np.array(model.names, object), Known(model)
        for part, _, _ in slices(batches, "text"):
            bag = Bag(part.column("text"))
            share = np.zeros((bag.rows, len(names)))
            if bag.n:
                logs = known_words.logs_of(bag)
                p = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -60))
                pairs, n = np.unique(bag.row * bag.n + bag.word, return_counts=True)
                row = pairs // bag.n
                usable = bag.lettered[row]
                texts, dense = np.unique(row[usable], return_inverse=True)
                if len(texts):
                    share[texts] = language_sets(p[pairs[usable] % bag.n], n[usable].astype(float), dense, penalty)
            top = share.argmax(axis=1)
            known = share.sum(axis=1) > 0
            order = np.argsort(-share, axis=1, kind="stable")
            sizes = (share > 0).sum(axis=1)
            picked = order[np.arange(len(names))[None, :] < sizes[:, None]]
            rows = np.repeat(np.arange(bag.rows), sizes)
            bounds = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            columns = [
                part.column("doc_id"), part.column("held_out"), pa.array(np.where(known, names[top], "und"), pa.string()), pa.array(np.minimum(share[np.arange(bag.rows), top], 1.0)),
                pa.ListArray.from_arrays(bounds, pa.array(names[picked], pa.string())), pa.ListArray.from_arrays(bounds, pa.array(np.minimum(share[rows, picked], 1.0))),
            ]
            yield pa.record_batch(columns, ["doc_id", "held_out", "lang_pred", "score", "languages", "shares"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", penalty: float = PENALTY, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred, score; languages and shares: the text's set, largest first."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"), held_out(id_col).alias("held_out"))
    model = fit(rows.where("not held_out").select("text", "lang"), model_bytes)
    out = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>"
    rows = rows.select("doc_id", "held_out", "text")
    if model is None:
        nothing = F.array().cast("array<string>"), F.array().cast("array<double>")
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), nothing[0].alias("languages"), nothing[1].alias("shares"))
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), penalty), out)
