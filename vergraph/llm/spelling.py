"""Operator 13: spelling variants by dynamic programming over sorted lists.

A word is compared with a sorted list by running down the list's shared
prefixes: a prefix that adjacent words share (by their longest common prefixes)
has one row of the edit matrix for all of them, cut to the band of three cells
that one edit can reach.  A range of the list whose row has no cell of one or
less is skipped.  Rows of many words are computed at once, prefix length by
prefix length.

One edit leaves one half of a word as it is.  So the vocabulary is listed twice,
by first halves and by second halves, and only words that share the half that
their list is keyed by (for the shorter length of a pair) are compared; a pair
belongs to the list that its first difference points to, and is found there
once.  Lists with more than ``most`` words are keyed by more of the word: the
part in which the edit may lie is halved, each half a list of its own, down to
one position.  A list of one position has at most 90 words and 8,100 that are
longer by one, so every list ends up bounded, and no pair is lost.

A list's words send one row each to the final counts, whatever the number of
their partners.  A form has ten times the count of its word, so chains of forms
are at most log10 of the largest count long; roots come from that many steps of
pointer doubling, two to the power of the rounds.

Defined cases: a null text has no runs; a null doc_id counts as the empty text;
repeated rows count again; ties go to the smaller word in code-point order; an
empty table gives an empty result; other columns are ignored, whatever their
names.  Very long texts are read whole and runs may have any length: lists hold
words of like length, within a number of bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import ragged
from .workspace import drop_staged, ship, stage

LEAST_LENGTH, LEAST_COUNT, EVERY, TIMES = 7, 2, 31, 10
#: Most words of a list, bytes of the lists that a task compares at once, and steps of it held at once.
MOST, BLOCK_BYTES, HELD = 8192, 1 << 20, 400_000
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEAD = 12  # bytes of base, start and end before a word's own


def vocabulary(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """word (one byte per code point), n: the words that are long and frequent enough."""
    run = F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(rf"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0)))
    low = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run")).select("id", F.translate("run", UPPER, SMALL).alias("run"))
    hashed = low.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    counts = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)
    return counts.select(F.encode("word", "ISO-8859-1").alias("word"), "n")


def _part(base: Column, start: Column, end: Column) -> Column:
    """A list of the words of length ``base`` and ``base`` + 1 that share their
    first ``start`` and last ``end`` letters."""
    return F.struct(base.cast("int").alias("base"), start.cast("int").alias("start"), end.cast("int").alias("end"))


def _halves(base: Column, start: Column, end: Column) -> list[Column]:
    """The two lists that a list is divided into: by where the edit is."""
    middle = start + F.floor((base - start - end) / 2)
    return [_part(base, middle, end), _part(base, start, base - middle)]


def _lists(words: DataFrame) -> DataFrame:
    """word, n, part, list: every word in the lists of its own length and of the one below."""
    size, zero = F.octet_length("word"), F.lit(0)
    below = F.when(size > LEAST_LENGTH, F.array(*_halves(size - 1, zero, zero))).otherwise(F.array().cast("array<struct<base:int,start:int,end:int>>"))
    return _keyed(words.select("word", "n", F.explode(F.concat(F.array(*_halves(size, zero, zero)), below)).alias("part")))


def _keyed(rows: DataFrame) -> DataFrame:
    first, last = F.substr("word", F.lit(1), F.col("part.start")), F.substr("word", F.octet_length("word") - F.col("part.end") + 1, F.col("part.end"))
    return rows.select("word", "n", "part", F.xxhash64("part.base", "part.start", "part.end", first, last).alias("list"))


def bounded_lists(words: DataFrame, most: int = MOST) -> DataFrame:
    """The lists, those of more than ``most`` words divided as far as they can be."""
    now, done = stage(_lists(words), "spelling-lists"), []
    while True:
        sizes = now.groupBy("list").agg(F.count("*").alias("size"), F.min(F.col("part.base") - F.col("part.start") - F.col("part.end")).alias("middle"))
        large = stage(sizes.where((F.col("size") > most) & (F.col("middle") > 1)).select("list"), "spelling-large")
        n = large.count()
        if not n:
            done.append(now)
            break
        large = F.broadcast(large) if n <= 100_000 else large
        done.append(now.join(large, "list", "left_anti").select(*now.columns))
        split = now.join(large, "list", "left_semi").select("word", "n", F.explode(F.array(*_halves(F.col("part.base"), F.col("part.start"), F.col("part.end")))).alias("part"))
        now = stage(_keyed(split), "spelling-lists")
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


class SortedLists:
    """Lists of one task, sorted: first by list, then by the words' free middles."""

    def __init__(self, words: pa.Array, base: np.ndarray, start: np.ndarray, end: np.ndarray):
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        off = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8)
        size = np.diff(off)
        width = int(size.max())
        # each word with its shared letters first, after the numbers of its list
        j = np.arange(width)[None, :]
        a, b, n = start[:, None], end[:, None], size[:, None]
        turned = np.where(j < a, j, np.where(j < a + b, n - b + j - a, j - b))
        rows = np.zeros((len(size), HEAD + width + 3), np.uint8)
        rows[:, :HEAD] = np.stack([base, start, end], axis=1).astype(">u4").view(np.uint8).reshape(-1, HEAD)
        rows[:, HEAD : HEAD + width] = np.where(j < n, data[np.minimum(off[:-1, None] + turned, len(data) - 1)], 0)
        plain = np.where(j < n, data[np.minimum(off[:-1, None] + j, len(data) - 1)], 0).astype(np.uint8)
        self.rank = np.empty(len(size), np.int64)
        self.rank[np.argsort(np.ascontiguousarray(plain).view(f"S{width}").ravel(), kind="stable")] = np.arange(len(size))
        order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
        self.order, self.rows, self.rank = order, rows[order], self.rank[order]
        self.base, self.start, self.end, size = base[order], start[order], end[order], size[order]
        self.fixed = HEAD + self.start + self.end
        self.free = size - self.start - self.end  # letters in the middle
        self.query = size == self.base
        differ = self.rows[1:] != self.rows[:-1]
        shared = np.append(0, differ.argmax(axis=1))
        #: What a word's middle shares with the one before it; -1 where a list starts.
        self.shared = np.where(shared < self.fixed, -1, shared - self.fixed)
        self.shared[:1] = -1

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs that differ by one edit, each in both directions: places of
        the word, places of its partner."""
        firsts = np.flatnonzero(self.shared < 0)
        lasts = np.append(firsts[1:], len(self.shared))
        of = np.searchsorted(firsts, np.arange(len(self.shared)), side="right") - 1
        queries = np.flatnonzero(self.query & (lasts - firsts > 1)[of])
        load = np.cumsum(np.minimum((lasts - firsts)[of[queries]], 2000))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for own in np.split(queries, np.searchsorted(load, np.arange(HELD, int(load[-1]) if len(load) else 0, HELD))):
            if len(own):
                found.append(self._run(own, firsts[of[own]], lasts[of[own]]))
        x, y = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        longer = ~self.query[y]
        return np.concatenate([x, y[longer]]), np.concatenate([y, x[longer]])

    def _run(self, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries ``q`` against the ranges lo to hi of the sorted list."""
        band = np.tile(np.array([2, 0, 1], np.int8), (len(q), 1))
        xs, ys, depth = [], [], 0
        while len(q):
            # words that end here: their last row holds the distance
            at = self.free[q] - depth
            hit = (self.free[lo] == depth) & (np.abs(at) <= 1)
            hit[hit] = band[hit, at[hit] + 1] == 1
            xs.append(q[hit])
            ys.append(lo[hit])
            # each range is divided by its next letter
            edges = np.flatnonzero(self.shared <= depth)
            a, b = np.searchsorted(edges, lo), np.searchsorted(edges, hi)
            child, parent = ragged(a, b - a), np.repeat(np.arange(len(q)), b - a)
            nlo = edges[child]
            nhi = np.append(edges, len(self.shared))[child + 1]
            keep = (self.free[nlo] > depth) & ~((nhi - nlo == 1) & (nlo == q[parent]))
            nlo, nhi, parent = nlo[keep], nhi[keep], parent[keep]
            q, old = q[parent], band[parent]
            letter = self.rows[nlo, self.fixed[nlo] + depth]
            own, size = self.fixed[q] + depth, self.free[q]
            left = np.minimum(old[:, 0] + (self.rows[q, own - 1] != letter), old[:, 1] + 1)
            same = np.minimum(np.minimum(old[:, 1] + (self.rows[q, own] != letter), old[:, 2] + 1), left + 1)
            right = np.minimum(old[:, 2] + (self.rows[q, own + 1] != letter), same + 1)
            depth += 1
            band = np.minimum(np.stack([np.where(depth - 1 <= size, left, 2), np.where(depth <= size, same, 2), np.where(depth + 1 <= size, right, 2)], axis=1), 2).astype(np.int8)
            alive = band.min(axis=1) <= 1
            q, lo, hi, band = q[alive], nlo[alive], nhi[alive], band[alive]
        x, y = np.concatenate(xs), np.concatenate(ys)
        # a pair belongs to the list in whose free part it differs first
        first = np.zeros(len(x), np.int64)
        for i in range(0, len(x), 1 << 16):
            first[i : i + (1 << 16)] = (self.rows[x[i : i + (1 << 16)]] != self.rows[y[i : i + (1 << 16)]]).argmax(axis=1)
        place = first - HEAD - self.end[x]
        own = (place < self.base[x] - self.end[x]) | (self.end[x] == 0)
        return x[own], y[own]


def compare(table: pa.Table) -> pa.Table:
    """word, n_near, form_n, form: the words of lists that have partners there."""
    lists = SortedLists(table["word"], *(table[c].to_numpy().astype(np.int64) for c in ("base", "start", "end")))
    n = table["n"].to_numpy()[lists.order]
    x, y = lists.near()
    best = np.lexsort((lists.rank[y], -n[y], x))
    x, y = x[best], y[best]
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(x)))
    words = table["word"].combine_chunks()
    return pa.table({"word": words.take(pa.array(lists.order[x[first]])), "n_near": pa.array(counts, pa.int64()), "form_n": pa.array(n[y[first]], pa.int64()), "form": words.take(pa.array(lists.order[y[first]]))})


def _in_blocks(lists: DataFrame, block_bytes: int) -> DataFrame:
    """Lists of words of like length go together, up to about ``block_bytes``.  The
    list's own length counts: its words, which may be one longer, stay together."""
    rows = lists.withColumn("width", F.ceil(F.log2(F.greatest(F.col("part.base"), F.lit(16)).cast("double"))).cast("int"))
    sizes = rows.groupBy("width").agg(F.count("*").alias("n")).collect()  # one row for each power of two
    blocks = F.create_map(*[F.lit(v) for r in sizes for v in (r["width"], max(1, -(-(r["n"] << r["width"]) // block_bytes)))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    dealt = rows.select("word", "n", "part.base", "part.start", "part.end", "width", F.pmod("list", blocks[F.col("width")].cast("long")).alias("block"))
    return dealt.groupBy("width", "block").applyInArrow(compare, "word binary, n_near long, form_n long, form binary")


def roots(links: DataFrame, longest: int) -> DataFrame:
    """word, root from word, form: chains of at most ``longest`` links followed to their ends."""
    now = links.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, longest))))):
        now = stage(now, "spelling-roots")
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    ship(docs.sparkSession)
    words = stage(vocabulary(docs, id_col, text_col), "spelling-words")
    found = _in_blocks(bounded_lists(words, most), block_bytes).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("word"))).alias("best"))
    enough = -F.col("best.n") >= TIMES * F.col("n")
    rows = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n"))
    rows = stage(rows, "spelling-forms")
    drop_staged(words)
    largest = rows.agg(F.max("form_n")).first()[0] or 0
    ends = roots(rows.where("form is not null").select("word", "form"), int(math.log(max(1, largest / LEAST_COUNT), TIMES) + 1e-9) if largest else 0)
    text = lambda c: F.decode(c, "ISO-8859-1")
    out = rows.join(ends, "word", "left")
    return out.select(text(F.col("word")).alias("word"), text(F.col("form")).alias("form"), text(F.coalesce("root", "word")).alias("root"), "n", "n_near", "form_n")
