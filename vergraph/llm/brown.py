"""Operator 9: scoring by a class-based bigram model with exchange clustering.

1. One scan counts the training words.  The ``known`` most frequent ones are
   broadcast with their counts and classes (a bounded table); the others are
   the rare words.
2. A second scan writes, for every word outside the core, the words before and
   after each of its occurrences, dealt by word; bigrams inside the core (the
   ``clustered`` most frequent words) as counts; and bigrams of two rare words.
3. The exchange algorithm moves the words of the core one by one between
   ``classes`` classes while that raises the likelihood of the class bigram
   model.
4. All other known words are then exchanged in rounds on executors: each goes
   to the class that explains best what stood around it, given the classes of
   the round before.  A round that does not raise the likelihood is taken back
   and ends the exchange.
5. The rare words are placed the same way, all of them, given the classes of
   the known words.  Bigrams of two rare words join their classes.
6. The last scan scores: log10 P(class | class before) + log10 P(word | class).
   Transitions are smoothed with the class unigram, emissions by adding one.
   Counts and classes of rare words come from a join.

The first class follows a start class; every text ends with one end token, a
class of its own.  Words that no training text holds form the tail class: they
follow, and are followed by, what training words of a single occurrence are.
The probabilities of all words, the end and one unseen word sum to one.

Nulls and empties: a null or word-less text is its end token alone.  A null
doc_id counts as the empty text in the fold rule.  Repeated rows are scored
and counted one by one.  With no training rows N = V = 0: every token scores
log10(1) in the base.  Very long texts are read in slices of words.  Equal
counts are ordered by the words' hashes.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import NOT_SPACE, U64, HashIndex, Tally, Words, binary_rows, slices, text_bytes
from .workspace import drop_staged, ship, stage

CLASSES, CLUSTERED, KNOWN, PRIOR, ROUNDS = 64, 2048, 262_144, 16.0, 2
#: Stands for the end of a text among word hashes.
END = U64(0x14057B7EF767814F)
#: Words of a task that are sorted by word and written at once.
CHUNK_WORDS = 2_000_000
KNOWN_WORD, RARE_WORD, CORE_CELL, RARE_PAIR = range(4)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _count_words(batches):
    """Counts of the words of a task's texts, and of the texts under END."""
    tally = Tally()

    def rows(keys, n):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    docs = 0
    for batch, data, off in slices(batches, "text"):
        docs += batch.num_rows
        if tally.add(Words(data, off, NOT_SPACE).hash):
            yield rows(*tally.take())
    yield rows(*tally.take())
    yield rows(np.array([END]), np.array([docs], np.int64))


def most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the words whose count no more than ``most`` words
    reach; found from a histogram of counts, so at most ``most`` rows are collected."""
    level = F.floor(F.log2("n") * 64).cast("long")
    steps = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()  # 64 rows per doubling of the count
    total, least = 0, None
    for r in sorted(steps, key=lambda r: -r["level"]):
        total += r["words"]
        if total > most:
            break
        least = r["least"]
    if least is None:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    found = counts.where(F.col("n") >= least).select("key", "n").toArrow()
    keys, n = found["key"].to_numpy().view(U64), found["n"].to_numpy()
    order = np.lexsort((keys, -n))
    return keys[order], n[order]


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int, rounds: int = 8) -> np.ndarray:
    """Class of each word, from the matrix of its bigram counts (word, next)."""
    k = len(pairs)
    own = np.arange(k) % max(1, classes)
    if k <= classes:
        return own
    member = np.zeros((k, classes))
    member[np.arange(k), own] = 1
    g = member.T @ pairs @ member
    right, left = pairs @ member, pairs.T @ member  # counts of w before class c, after class c
    for _ in range(rounds):
        moved = 0
        for w in range(k):
            a, self_n = own[w], pairs[w, w]
            r, le = right[w].copy(), left[w].copy()
            g[a] -= r
            g[:, a] -= le
            g[a, a] += self_n
            r[a] -= self_n
            le[a] -= self_n
            x = xlogx(g)
            rows, cols = g.sum(axis=1), g.sum(axis=0)
            d = np.diagonal(g)
            gain = (xlogx(g + r) - x).sum(axis=1) + (xlogx(g + le[:, None]) - x).sum(axis=0)
            gain += xlogx(d + r + le + self_n) + xlogx(d) - xlogx(d + r) - xlogx(d + le)
            gain -= xlogx(rows + r.sum() + self_n) - xlogx(rows) + xlogx(cols + le.sum() + self_n) - xlogx(cols)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9 * abs(gain[a]):
                b = a
            g[b] += r
            g[:, b] += le
            g[b, b] += self_n
            if b != a:
                moved += 1
                own[w] = b
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
                left[:, a] -= pairs[w]
                left[:, b] += pairs[w]
        if moved * 200 < k:
            break
    return own


class Model:
    """What a scan needs: bounded tables of counts and classes.  Slots number the
    known words by falling count; after them come the rare words, END and START."""

    def __init__(self, known: np.ndarray, counts: np.ndarray, total: int, types: int, docs: int, classes: int):
        order = np.argsort(known)
        self.index, self.rank = HashIndex(known[order]), np.append(order, 0).astype(np.int32)
        self.counts, self.size = counts, len(known)
        self.total, self.types, self.docs = total, types, docs
        self.tail, self.end, self.start, self.width = classes, classes + 1, classes + 2, classes + 3
        self.cls = np.full(len(known), self.tail, np.int16)
        self.log_transition = np.zeros((classes + 3, classes + 3))
        self.log_size = np.zeros(classes + 3)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of words; those that are not in the table all get ``size``."""
        at = self.index.find(keys)
        return np.where(at >= 0, self.rank[at], self.size).astype(np.int32)

    def of_slot(self) -> np.ndarray:
        """Classes by slot, the tail for rare words."""
        return np.concatenate([self.cls, np.array([self.tail, self.end, self.start], np.int16)])


SCANNED = "kind byte, key long, n long, slot int, around binary"


def _neighbours(shared, core: int):
    """Rows of all four kinds: (word, slot, codes of the slots before and after
    each occurrence), core cells with counts, and pairs of rare words."""

    def run(batches):
        model: Model = shared.value
        rare, end, start = model.size, model.size + 1, model.size + 2
        parts, held = [], 0

        def rows(kind, key, n=None, slot=None, around=None):
            size = len(key)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, kind, np.int8)), pa.array(key), pa.array(n) if n is not None else pa.nulls(size, pa.int64()), pa.array(slot, pa.int32()) if slot is not None else pa.nulls(size, pa.int32()), around if around is not None else pa.nulls(size, pa.binary())],
                ["kind", "key", "n", "slot", "around"],
            )

        def take():
            key, slot, before, after = (np.concatenate(x) for x in zip(*parts, strict=True))
            inside = slot < core
            cell = np.concatenate([before[inside & (before < core)].astype(np.int64) * core + slot[inside & (before < core)], core * core + 2 * slot[inside & (before == start)], core * core + 2 * slot[inside & (after == end)] + 1])
            cell, n = np.unique(cell, return_counts=True)
            yield rows(CORE_CELL, cell, n)
            key, slot, before, after = (x[~inside] for x in (key, slot, before, after))
            order = np.argsort(key, kind="stable")
            key, slot, before, after = key[order], slot[order], before[order], after[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(key)))
            around = np.empty(2 * len(key), "<u4")
            at = np.arange(len(key)) + np.repeat(first, count)
            around[at] = before
            around[at + np.repeat(count, count)] = after
            kind = np.where(slot[first] == rare, RARE_WORD, KNOWN_WORD).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key[first].view(np.int64)), pa.nulls(len(first), pa.int64()), pa.array(slot[first]), binary_rows(around, 2 * count)], ["kind", "key", "n", "slot", "around"])

        empty = 0
        for _, data, off in slices(batches, "text"):
            words = Words(data, off, NOT_SPACE)
            slot, n, full = model.slots(words.hash), len(words.hash), words.count > 0
            before, after = np.append(start, slot[:-1])[:n].astype(np.int32), np.append(slot[1:], end)[:n].astype(np.int32)
            before[words.first[:-1][full]] = start
            after[words.first[1:][full] - 1] = end
            at = np.flatnonzero((slot == rare) & (before == rare))
            if len(at):
                yield rows(RARE_PAIR, words.hash[at - 1].view(np.int64), words.hash[at].view(np.int64))
            parts.append((words.hash, slot, before, after))
            empty += int((~full).sum())
            held += n
            if held > CHUNK_WORDS:
                yield from take()
                parts, held = [], 0
        if parts:
            yield from take()
        if empty:
            yield rows(CORE_CELL, np.array([core * core + 2 * core]), np.array([empty]))

    return run


def _contexts(shared, core: int):
    """slot, key, cells, n: what stood around a word, one row for each word of a
    batch (its rows are next to each other).  Cells: the class before; or, from
    ``width`` on, the class after; or, from 2 * ``width`` on, the class after
    where that is a word of the core or the end, which have no rows of their own."""

    def run(batches):
        model: Model = shared.value
        width, wide = model.width, 3 * model.width
        before = model.of_slot().astype(np.int64)
        after = before + width
        after[:core] += width
        after[model.size + 1] += width
        for batch in batches:
            if not batch.num_rows:
                continue
            key, slot, around = longs(batch.column("key")), longs(batch.column("slot")), batch.column("around")
            raw, off = text_bytes(around)
            codes, off = raw.view("<u4"), off // 4
            many = np.diff(off)
            new = np.append(True, key[1:] != key[:-1])
            place = np.arange(len(codes)) - np.repeat(off[:-1], many)
            cell = np.repeat((np.cumsum(new) - 1) * wide, many) + np.where(place < np.repeat(many // 2, many), before[codes], after[codes])
            cell, n = np.unique(cell, return_counts=True)
            first = np.flatnonzero(new)
            size = np.bincount(cell // wide, minlength=len(first))
            yield pa.RecordBatch.from_arrays([pa.array(slot[first]), pa.array(key[first]), binary_rows((cell % wide).astype("<i2"), size), binary_rows(n.astype("<i8"), size)], ["slot", "key", "cells", "n"])

    return run


CONTEXTS = "slot int, key long, cells binary, n binary"


def _words_of(batches, wide: int):
    """Blocks of words (slots, keys, contexts [word, cell]) from rows sorted by
    word; the last word of a batch waits for the next one."""
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, slot = longs(batch.column("key")), longs(batch.column("slot"))
        cells, off = text_bytes(batch.column("cells"))
        n = text_bytes(batch.column("n"))[0].view("<i8")
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        word = np.searchsorted(first, np.arange(len(key)), side="right") - 1
        seen = np.bincount(np.repeat(word, np.diff(off) // 2) * wide + cells.view("<i2"), weights=n, minlength=len(first) * wide).astype(np.int64).reshape(-1, wide)
        slots, keys = slot[first], key[first]
        if kept is not None and kept[1][0] == keys[0]:
            seen[0] += kept[2][0]
        elif kept is not None:
            slots, keys, seen = np.append(kept[0], slots), np.append(kept[1], keys), np.concatenate([kept[2], seen])
        kept = slots[-1:], keys[-1:], seen[-1:]
        if len(keys) > 1:
            yield slots[:-1], keys[:-1], seen[:-1]
    if kept is not None:
        yield kept


def _transitions(shared, final: bool):
    """Counts (before * width + class) of the pairs that end in a word outside
    the core, and of those from such a word to one of the core or the end."""

    def run(batches):
        model: Model = shared.value
        w, tail = model.width, model.tail
        table = np.zeros((w, w), np.int64)
        for slots, _, seen in _words_of(batches, 3 * w):
            cls = model.cls[slots].astype(np.int64)
            before, after = seen[:, :w].copy(), seen[:, 2 * w :].copy()
            if final:  # pairs with a rare word are counted where those are placed
                before[:, tail] = 0
            else:  # rare words as one class
                after[:, tail] += seen[:, w + tail]
            _add(table, cls, before, after)
            if final:
                _add_once(table, seen, model, model.counts[slots] == 1)
        cell = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(table.ravel()[cell])], ["cell", "n"])

    return run


def _add(table: np.ndarray, cls: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
    """Counts of the pairs (class before, own class) and (own class, class after)."""
    np.add.at(table.T, cls, before)
    np.add.at(table, cls, after)


def _add_once(table: np.ndarray, seen: np.ndarray, model: Model, once: np.ndarray) -> None:
    """What stands around words of one occurrence is counted for the tail as well."""
    w, tail = model.width, model.tail
    before, after = seen[once, :w].sum(axis=0), seen[once, w : 2 * w].sum(axis=0) + seen[once, 2 * w :].sum(axis=0)
    before[tail] = after[tail] = 0
    table[:, tail] += before
    table[tail] += after


def _best(seen: np.ndarray, logs: np.ndarray, w: int) -> np.ndarray:
    """The class of each word that explains what stood around it best."""
    return np.argmax(seen[:, : 2 * w] @ logs + seen[:, 2 * w :] @ logs[w:], axis=1)


def _place_known(shared, logs: np.ndarray):
    def run(batches):
        model: Model = shared.value
        for slots, _, seen in _words_of(batches, 3 * model.width):
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(_best(seen, logs, model.width), pa.int32())], ["slot", "cls"])

    return run


def _place_rare(shared, logs: np.ndarray):
    """(key, cls, n) of rare words, and under n = null the cells (key) and counts
    (value) of their pairs with known words."""

    def run(batches):
        model: Model = shared.value
        w, tail = model.width, model.tail
        table = np.zeros((w, w), np.int64)
        for _, keys, seen in _words_of(batches, 3 * w):
            cls, n = _best(seen, logs, w), seen[:, :w].sum(axis=1)
            before, after = seen[:, :w].copy(), seen[:, w : 2 * w] + seen[:, 2 * w :]
            before[:, tail] = after[:, tail] = 0  # pairs of two rare words come from a join
            _add(table, cls, before, after)
            _add_once(table, seen, model, n == 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(cls, pa.int32()), pa.array(n), pa.nulls(len(keys), pa.int64())], ["key", "cls", "n", "value"])
        cell = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.nulls(len(cell), pa.int32()), pa.nulls(len(cell), pa.int64()), pa.array(table.ravel()[cell])], ["key", "cls", "n", "value"])

    return run


def likelihood(table: np.ndarray) -> float:
    """Of the class bigram model, but for a term that no class changes."""
    return float(xlogx(table).sum() - xlogx(table.sum(axis=1)).sum() - xlogx(table.sum(axis=0)).sum())


def _summed(cells: DataFrame, width: int) -> np.ndarray:
    """The table of (cell, n): at most width ** 2 rows reach the driver."""
    found = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(width * width)
    table[found["cell"].to_numpy()] = found["n"].to_numpy()
    return table.reshape(width, width)


def _log_contexts(table: np.ndarray, model: Model) -> np.ndarray:
    """log P(class before | class) over log P(class after | class)."""
    tail, classes = model.tail, model.tail
    part = table[:, :classes], table[:classes].T
    logs = np.concatenate([np.log((x + 0.5) / (x.sum(axis=0) + 0.5 * model.width)) for x in part])
    logs[[tail, model.width + tail]] = 0  # words without a class say nothing
    return logs


def fit(train: DataFrame, classes: int = CLASSES, clustered: int = CLUSTERED, known: int = KNOWN, prior: float = PRIOR, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model, and class and count (key, cls, n) of the training words that
    are not in its table."""
    spark = train.sparkSession
    ship(spark)
    sc = spark.sparkContext
    texts, end = train.select("text"), F.lit(int(END.view(np.int64)))
    counts = stage(texts.mapInArrow(_count_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "lm-counts")
    docs = (counts.where(F.col("key") == end).agg(F.sum("n")).first()[0]) or 0
    words = counts.where(F.col("key") != end)
    sums = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    keys, n = most_frequent(words, known)
    drop_staged(counts)
    model = Model(keys, n, (sums["n"] or 0) + docs, sums["v"] + (docs > 0), docs, classes)
    core, width = min(clustered, int((n > 1).sum())), model.width  # a word of one occurrence is no model for others
    shared = sc.broadcast(model)
    scanned = stage(texts.mapInArrow(_neighbours(shared, core), SCANNED), "lm-scanned")
    found = scanned.where(F.col("kind") == CORE_CELL).groupBy("key").agg(F.count("*"), F.sum("n").alias("n")).select("key", "n").toArrow()  # at most clustered ** 2 + 2 * clustered + 1 rows
    cells = np.zeros(core * core + 2 * core + 1)
    cells[found["key"].to_numpy()] = found["n"].to_numpy()
    del found
    pairs = stage(scanned.where(F.col("kind") == RARE_PAIR).select(F.col("key").alias("a"), F.col("n").alias("b")), "lm-rare-pairs")
    around = scanned.where(F.col("kind") <= RARE_WORD).select("slot", "key", "around").repartition("key").sortWithinPartitions("slot", "key")
    around = stage(around, "lm-around")
    drop_staged(scanned)
    matrix = cells[: core * core].reshape(core, core)
    model.cls[:core] = exchange(matrix, classes)
    fixed = np.zeros((width, width))  # of pairs inside the core, with start and end
    member = np.zeros((core, width))
    member[np.arange(core), model.cls[:core]] = 1
    fixed += member.T @ matrix @ member
    fixed[model.start] += cells[core * core : -1 : 2] @ member
    fixed[:, model.end] += cells[core * core + 1 : -1 : 2] @ member
    fixed[model.start, model.end] += cells[-1]
    del matrix, cells, member

    best = None
    for step in range(rounds + 1):
        shared = sc.broadcast(model)
        seen = stage(around.where(F.col("slot") < model.size).mapInArrow(_contexts(shared, core), CONTEXTS).repartition("key").sortWithinPartitions("slot", "key"), "lm-contexts")
        table = fixed + _summed(seen.mapInArrow(_transitions(shared, False), "cell long, n long"), width)
        reached = likelihood(table)
        if step and best is not None and reached <= best[0]:
            drop_staged(seen)
            break
        if step:
            if best is not None:
                drop_staged(best[2])
            best = reached, model.cls.copy(), seen
        if step == rounds:
            break
        found = seen.mapInArrow(_place_known(shared, _log_contexts(table, model)), "slot int, cls int").toArrow()  # at most ``known`` rows
        model.cls[found["slot"].to_numpy()] = found["cls"].to_numpy()
        if not step:
            drop_staged(seen)
    model.cls = best[1]
    shared = sc.broadcast(model)
    table = fixed + _summed(best[2].mapInArrow(_transitions(shared, True), "cell long, n long"), width)
    placed = around.where(F.col("slot") == model.size).mapInArrow(_contexts(shared, core), CONTEXTS).repartition("key").sortWithinPartitions("slot", "key")
    placed = stage(placed.mapInArrow(_place_rare(shared, _log_contexts(table, model)), "key long, cls int, n long, value long"), "lm-rare")
    table += _summed(placed.where("n is null").select(F.col("key").alias("cell"), F.col("value").alias("n")), width)
    rare = placed.where("n is not null").select("key", "cls", "n")
    sides = [rare.select(F.col("key").alias(c), F.col("cls").alias(f"cls_{c}")).hint("merge") for c in "ab"]
    met = pairs.join(sides[0], "a").join(sides[1], "b")
    table += _summed(met.select((F.col("cls_a") * width + F.col("cls_b")).cast("long").alias("cell"), F.lit(1).cast("long").alias("n")), width)
    drop_staged(around, pairs, best[2])

    members = np.bincount(model.cls, minlength=width).astype(float)
    for r in rare.groupBy("cls").count().collect():
        members[r["cls"]] += r["count"]
    has_words = members[: classes + 2] > 0  # a class without words gets no share
    has_words[[model.tail, model.end]] = True
    of_class = table.sum(axis=0)[: classes + 2] + has_words
    unigram = of_class / of_class.sum()
    model.log_transition[:, : classes + 2] = np.log10(np.maximum((table[:, : classes + 2] + prior * unigram) / (table[:, : classes + 2].sum(axis=1, keepdims=True) + prior), 1e-300))
    tokens = np.bincount(model.cls, weights=model.counts, minlength=width)
    for r in rare.groupBy("cls").agg(F.sum("n").alias("n")).collect():
        tokens[r["cls"]] += r["n"]
    model.log_size = np.log10(np.maximum(tokens + members, 1.0))
    model.log_size[[model.tail, model.end]] = 0  # one unseen word, one end
    return model, rare


def _score(shared):
    def run(batches):
        from pyspark import TaskContext

        m: Model = shared.value
        row_id = TaskContext.get().partitionId() << 36
        base_size = np.log10(m.total + m.types + 1)
        log_counts, cls_of = np.log10(np.append(m.counts, 0) + 1.0), np.append(m.cls, -1).astype(np.int64)
        end_log = np.log10(m.docs + 1.0)
        for batch, data, off in slices(batches, "text"):
            words = Words(data, off, NOT_SPACE)
            n = batch.num_rows
            slot = m.slots(words.hash)
            cls, here = cls_of[slot], slot < m.size
            full = words.count > 0
            first, last = words.first[:-1][full], words.first[1:][full] - 1
            before, after = np.append(m.start, cls[:-1])[: len(cls)], np.append(cls[1:], m.end)[: len(cls)]
            before[first] = m.start
            after[last] = m.end
            log_n = log_counts[slot]
            # what has a word outside the table on either side is added when its class is known
            per_word = np.where(here, log_n - m.log_size[np.maximum(cls, 0)] + np.where(before >= 0, m.log_transition[before, cls], 0.0), 0.0)
            per_end = np.full(n, m.log_transition[m.start, m.end])
            per_end[full] = np.where(here[last], m.log_transition[cls[last], m.end], 0.0)

            def by_row(x, words=words, n=n):
                return np.bincount(words.row, weights=x, minlength=n)

            tokens = words.count + 1
            base = by_row(log_n) + end_log - tokens * base_size
            score = by_row(per_word) + per_end
            known = by_row(here.astype(float)).astype(np.int64) + (m.docs > 0)
            away = np.flatnonzero(~here)
            bounds = np.searchsorted(words.row[away], np.arange(n + 1))
            tail = pa.StructArray.from_arrays([pa.array(words.hash[away].view(np.int64)), pa.array(away.astype(np.int32)), pa.array(before[away].astype(np.int32)), pa.array(after[away].astype(np.int32))], names=["key", "pos", "before", "after"])
            ids = row_id + np.arange(n)
            row_id += n
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(ids, pa.int64()), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), tail)],
                ["doc_id", "held_out", "row_id", "n_tokens", "n_known", "base_score", "score", "tail"],
            )

    return run


def _score_tail(shared):
    """What a row's words outside the table, in order, add to its sums."""

    def run(batches):
        m: Model = shared.value
        for batch in batches:
            tail = batch.column("tail")
            row = np.repeat(np.arange(len(tail)), longs(tail.value_lengths()))
            pos, before, after, cls, n = (longs(tail.flatten().field(i)).astype(np.int64) for i in range(5))
            order = np.lexsort((pos, row))
            row, before, after, cls, n = row[order], before[order], after[order], cls[order], n[order]
            before = np.where(before < 0, np.append(0, cls[:-1])[: len(cls)], before)  # then the word before is the one just before here
            log_n = np.log10(n + 1.0)
            score = m.log_transition[before, cls] - m.log_size[cls] + log_n + np.where(after >= 0, m.log_transition[cls, after], 0.0)
            sums = [np.bincount(row, weights=x, minlength=len(tail)) for x in (n > 0, log_n, score)]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], ["row_id", "more", "gain", "rest"])

    return run


def score(docs: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    local = docs.select("doc_id", "held_out", "text").mapInArrow(_score(shared), f"doc_id {kind}, held_out boolean, row_id long, n_tokens long, n_known long, base_score double, score double, tail array<struct<key: bigint, pos: int, before: int, after: int>>")
    local = stage(local, "lm-scored")
    away = local.select("row_id", F.explode("tail").alias("t")).select("row_id", "t.*").join(rare.hint("merge"), "key", "left")
    away = away.select("row_id", F.struct("pos", "before", "after", F.coalesce("cls", F.lit(model.tail)).alias("cls"), F.coalesce("n", F.lit(0)).alias("n")).alias("t")).groupBy("row_id").agg(F.collect_list("t").alias("tail"))
    away = stage(away.mapInArrow(_score_tail(shared), "row_id long, more long, gain double, rest double"), "lm-tails")
    more, gain, rest = F.coalesce("more", F.lit(0)), F.coalesce("gain", F.lit(0.0)), F.coalesce("rest", F.lit(0.0))
    return local.drop("tail").join(away, "row_id", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base_score") + gain).alias("base_score"), (F.col("score") + rest).alias("score"))


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    model, rare = fit(rows.where(~F.col("held_out")), **sizes)
    return score(rows, model, rare)
