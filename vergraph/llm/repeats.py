"""Operator 3: removal of repeated substrings by suffix arrays over shards.

A byte goes if it lies in a ``length``-byte string that also starts anywhere
else in the corpus.  To find those strings shard by shard, equal strings must
meet in one shard: each window of ``length`` bytes is keyed by the smallest
hash of its 32-byte grams, which depends on the window alone.  Runs of
neighbouring windows with one key make a piece (about 280 bytes); pieces whose
key occurs at a single place hold no repeat and are left out.  Keys with more
than ``hot`` places are split by the windows' offset from the gram and by the
hash of the bytes that windows of such an offset share.  Equal pieces are sent
at most twice by a task, enter a suffix array once, and keep their count.

A shard is the text of its pieces, joined by a byte that UTF-8 never holds.
Its suffix array comes from induced sorting; a window is repeated if its common
prefix with a neighbour in the array reaches ``length``, or its piece has
several copies (which would be its neighbours).

Nulls and empties: a null text is empty and loses nothing.  A null doc_id is an
id like any other, and repeated rows are copies of each other, which lose all
that they share.  Very long texts are read stretch by stretch, with the overlap
of one window.  Empty tables give an empty result.  Other columns are ignored,
or carried along whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import BYTE_BASE, LETTER, SLICE_BYTES, U64, WORD_BASE, Prefix, mix, powers, ragged, slices
from .suffix import permuted_lcp, suffix_array
from .workspace import drop_staged, ship, stage

LENGTH, GRAM, HOT, STEP = 200, 32, 2000, 16
SHARD_BYTES = 1 << 20
SEEN = 400_000
STOP = 255


def sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every w neighbours, from running values within
    stretches of w read from both sides."""
    f, m = (np.minimum if least else np.maximum), len(x) - w + 1
    fill = ~U64(0) if least else U64(0)
    block = np.concatenate([x, np.full(-len(x) % w, fill)]).reshape(-1, w)
    ahead = f.accumulate(block, axis=1).ravel()
    back = f.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[:m], ahead[w - 1 : w - 1 + m])


class Anchors:
    """Window keys of a slice: ``least`` for every window start, ``gram`` for
    every position; ``valid`` starts are those of windows inside one row."""

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int):
        n, self.length = len(data), length
        self.wide = length - GRAM + 1
        symbols = LETTER[data]
        up, down = powers(BYTE_BASE, n)
        sums = np.zeros(n + 1, U64)
        np.cumsum(symbols * up[:n], dtype=U64, out=sums[1:])
        self.first = Prefix.__new__(Prefix)
        self.first.sums, self.first.down = sums, down
        h = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
        h ^= h >> U64(29)
        h *= U64(0xBF58476D1CE4E5B9)
        h ^= h >> U64(32)
        self.gram = h
        self.least = sliding(h, self.wide, True)
        ends = np.repeat(off[1:], np.diff(off))[: len(self.least)]
        self.valid = np.arange(length, length + len(self.least)) <= ends

    def anchors(self) -> np.ndarray:
        """Positions whose gram is the smallest of some valid window."""
        pad = np.zeros(self.wide - 1, U64)
        top = sliding(np.concatenate([pad, np.where(self.valid, self.least, U64(0)), pad]), self.wide, False)
        return np.flatnonzero(top == self.gram)

    def pieces(self, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last window start of every run of valid windows with one key."""
        new = np.ones(len(self.least), bool)
        new[1:] = (self.least[1:] != self.least[:-1]) | (self.valid[1:] != self.valid[:-1])
        edge = off[(off > 0) & (off < len(new))]
        new[edge] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(new)) - 1
        good = self.valid[first]
        return first[good], last[good]


def stretches(data: np.ndarray, off: np.ndarray, length: int, most: int):
    """(start, bytes, row offsets) of a slice: all of it, or the stretches of its
    one long row, in which every window lies whole exactly once."""
    if len(data) <= most:
        yield 0, data, off
        return
    for start in range(0, len(data) - length + 1, most):
        part = data[start : start + most + length - 1]
        yield start, part, np.array([0, len(part)])


#: Bytes of a long row that are worked on at once.
STRETCH = 4 << 20


def _keys(length: int, most: int = STRETCH):
    def run(batches):
        for batch, data, off in slices(batches, "text", min(SLICE_BYTES, most)):
            if len(data) >= length:
                row, keys = [], []
                for _, part, bounds in stretches(data, off, length, most):
                    anchors = Anchors(part, bounds, length)
                    at = anchors.anchors()
                    row.append(np.searchsorted(bounds, at, side="right") - 1)
                    keys.append(anchors.gram[at].view(np.int64))
                row, keys = np.concatenate(row), np.concatenate(keys)
                order = np.lexsort((keys, row))
                row, keys = row[order], keys[order]
                first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (keys[1:] != keys[:-1]))) if len(row) else row
                times = np.diff(np.append(first, len(row)))
                row, keys = row[first], keys[first]
            else:
                row = keys = times = np.zeros(0, np.int64)
            bounds = pa.array(np.searchsorted(row, np.arange(len(off))), pa.int32())
            pairs = pa.StructArray.from_arrays([pa.array(keys), pa.array(times, pa.int32())], names=["key", "n"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.ListArray.from_arrays(bounds, pairs)], ["doc_id", "rid", "keys"])

    return run


def _split_hot(anchors: Anchors, first: np.ndarray, last: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of hot keys, cut where the windows' offset from their first
    smallest gram enters another stretch of STEP; the new keys hold the bytes
    that all windows of such a stretch share."""
    unique, number = np.unique(key, return_inverse=True)
    size = len(anchors.gram) + 1
    at = np.flatnonzero(np.isin(anchors.gram, unique))
    places = np.sort(np.searchsorted(unique, anchors.gram[at]) * size + at)
    count = last - first + 1
    start, piece = ragged(first, count), np.repeat(np.arange(len(first)), count)
    gram = places[np.searchsorted(places, number[piece] * size + start)] % size
    stretch = (gram - start) // STEP
    new = np.ones(len(start), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (gram[1:] != gram[:-1]) | (stretch[1:] != stretch[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(start)) - 1
    core = gram[begin] - STEP * stretch[begin]
    shared = anchors.first.ranges(core, core + anchors.length - STEP + 1)
    return start[begin], start[end], mix(key[piece[begin]] ^ shared ^ (stretch[begin].astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))


def _pieces(data: np.ndarray, off: np.ndarray, length: int, wanted: np.ndarray, heat: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last window, key and two digests of every piece with a wanted key."""
    anchors = Anchors(data, off, length)
    first, last = anchors.pieces(off)
    key = anchors.least[first]
    found = np.isin(key, wanted)
    first, last, key = first[found], last[found], key[found]
    warm = np.isin(key, heat)
    if warm.any():
        more = _split_hot(anchors, first[warm], last[warm], key[warm])
        first, last, key = (np.concatenate([x[~warm], y]) for x, y in zip((first, last, key), more, strict=True))
        order = np.argsort(first, kind="stable")
        first, last, key = first[order], last[order], key[order]
    d1 = anchors.first.ranges(first, last + length).view(np.int64)
    d2 = Prefix(LETTER[data], WORD_BASE).ranges(first, last + length).view(np.int64)
    return first, last, key, d1, d2


def _cut_pieces(length: int, most: int = STRETCH):
    piece_type = pa.struct([("key", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bytes", pa.binary())])
    ref_type = pa.struct([("d1", pa.int64()), ("d2", pa.int64()), ("start", pa.int32())])

    def run(batches):
        seen: dict[tuple[int, int], int] = {}
        for batch, data, off in slices(batches, "text", min(SLICE_BYTES, most)):
            rows = batch.num_rows
            if len(data) < length:
                continue
            lists = batch.column("keys")
            wanted = np.unique(lists.flatten().to_numpy(zero_copy_only=False).view(U64))
            heat = np.unique(batch.column("hot_keys").flatten().to_numpy(zero_copy_only=False).view(U64))
            cut = []
            for start, part, bounds in stretches(data, off, length, most):
                first, last, *rest = _pieces(part, bounds, length, wanted, heat)
                cut.append((first + start, last + start, *rest))
            first, last, key, d1, d2 = (np.concatenate(x) for x in zip(*cut, strict=True))
            row = np.searchsorted(off, first, side="right") - 1
            bounds = np.searchsorted(row, np.arange(rows + 1))
            refs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(d1), pa.array(d2), pa.array(first - off[row], pa.int32())], fields=list(ref_type)))
            fresh = []
            for i, name in enumerate(zip(d1.tolist(), d2.tolist(), strict=True)):
                times = seen.get(name, 0)
                if times < 2:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen[name] = times + 1
                    fresh.append(i)
            fresh = np.array(fresh, np.int64)
            fresh_bounds = np.searchsorted(row[fresh], np.arange(rows + 1))
            texts = pa.array([data[a:b].tobytes() for a, b in zip(first[fresh].tolist(), (last[fresh] + length).tolist(), strict=True)], pa.binary())
            new = pa.ListArray.from_arrays(pa.array(fresh_bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(key[fresh].view(np.int64)), pa.array(d1[fresh]), pa.array(d2[fresh]), texts], fields=list(piece_type)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), refs, new], ["doc_id", "rid", "refs", "new"])

    return run


def repeated_starts(pieces: list[bytes], copies: list[bool], length: int) -> list[np.ndarray]:
    """For each piece of a shard, which of its windows occur again."""
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)
    sa = suffix_array(text, 256)
    before, lcp = permuted_lcp(text, sa, STOP)
    again = np.flatnonzero(lcp >= length)
    mark = np.zeros(len(text), bool)
    mark[again] = True
    mark[before[again]] = True
    out, at = [], 0
    for piece, several in zip(pieces, copies, strict=True):
        own = mark[at : at + len(piece) - length + 1]
        out.append(np.ones_like(own) if several else own)
        at += len(piece) + 1
    return out


def _search_shards(length: int):
    """Rows (key, d1, d2, bytes) sorted by all three: flagged windows of each
    different piece, as runs of starts."""

    def search(names, pieces, copies):
        d1, d2, runs = [], [], []
        for (a, b), flags in zip(names, repeated_starts(pieces, copies, length), strict=True):
            if flags.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                d1.append(a)
                d2.append(b)
                runs.append(edges.tolist())
        return pa.RecordBatch.from_arrays([pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(runs, pa.list_(pa.int32()))], ["d1", "d2", "runs"])

    def run(batches):
        names, pieces, copies, held, key = [], [], [], 0, None
        for batch in batches:
            for k, a, b, text in zip(*(batch.column(c).to_pylist() for c in ("key", "d1", "d2", "bytes")), strict=True):
                if k != key and held >= SHARD_BYTES:
                    yield search(names, pieces, copies)
                    names, pieces, copies, held = [], [], [], 0
                if names and k == key and names[-1] == (a, b):
                    copies[-1] = True
                    continue
                key = k
                names.append((a, b))
                pieces.append(text)
                copies.append(False)
                held += len(text)
        if names:
            yield search(names, pieces, copies)

    return run


def find_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), stretch: int = STRETCH) -> DataFrame:
    """doc_id, text, found (array of start, runs of repeated window starts from
    there), and the columns to carry, if any, as the struct ``carried``: one row
    per document, ``found`` null where nothing is repeated."""
    ship(docs.sparkSession)
    same = (F.col("rid") == F.col("_rid")) & F.col("doc_id").eqNullSafe(F.col("_id"))  # null ids meet, too
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("rid"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    anchors = stage(rows.mapInArrow(_keys(length, stretch), f"doc_id {kind}, rid long, keys array<struct<key: bigint, n: int>>"), "repeat-anchors")
    places = anchors.select("doc_id", "rid", F.explode("keys").alias("k")).select("doc_id", "rid", "k.key", "k.n")
    # written, so that both sides of the join come from shuffles, and a hot key's part can be split
    again = stage(places.groupBy("key").agg(F.sum("n").alias("places")).where("places > 1").select("key", (F.col("places") > hot).alias("hot")), "repeat-keys")
    places = places.drop("n")
    own = places.join(again, "key").groupBy("doc_id", "rid").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hot_keys"))
    cut = rows.join(own.withColumnsRenamed({"doc_id": "_id", "rid": "_rid"}), same).select("doc_id", "rid", "text", "keys", "hot_keys")
    cut = stage(cut.mapInArrow(_cut_pieces(length, stretch), f"doc_id {kind}, rid long, refs array<struct<d1: bigint, d2: bigint, start: int>>, new array<struct<key: bigint, d1: bigint, d2: bigint, bytes: binary>>"), "repeat-pieces")
    drop_staged(anchors, again)
    pieces = cut.select(F.explode("new").alias("p")).select("p.*").repartition("key").sortWithinPartitions("key", "d1", "d2")
    flags = stage(pieces.mapInArrow(_search_shards(length), "d1 long, d2 long, runs array<int>"), "repeat-flags")
    refs = cut.select("doc_id", "rid", F.explode("refs").alias("r")).select("doc_id", "rid", "r.*")
    found = stage(refs.join(flags, ["d1", "d2"]).groupBy("doc_id", "rid").agg(F.collect_set(F.struct("start", "runs")).alias("found")), "repeat-found")
    drop_staged(cut, flags)
    carried = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("rid"), F.struct(*carry).alias("carried")) if carry else rows
    return carried.join(found.withColumnsRenamed({"doc_id": "_id", "rid": "_rid"}), same, "left").select("doc_id", "text", "found", *["carried"] * bool(carry))


def spans_of(found: list | None, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by repeated windows."""
    if not found:
        return []
    ranges = sorted((f["start"] + f["runs"][i], f["start"] + f["runs"][i + 1] - 1 + length) for f in found for i in range(0, len(f["runs"]), 2))
    out = [list(ranges[0])]
    for a, b in ranges[1:]:
        if a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _report(length: int):
    def run(batches):
        for batch, data, off in slices(batches, "text"):
            n_removed, n_spans, sha = [], [], []
            for i, found in enumerate(batch.column("found").to_pylist()):
                raw, spans, at = data[off[i] : off[i + 1]], spans_of(found, length), 0
                h = hashlib.sha256()
                for a, b in spans:
                    h.update(raw[at:a])
                    at = b
                h.update(raw[at:])
                n_removed.append(sum(b - a for a, b in spans))
                n_spans.append(len(spans))
                sha.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def report(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return found.mapInArrow(_report(length), f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _cut_texts(length: int):
    def run(batches):
        for batch, data, off in slices(batches, "text"):
            out = []
            for i, found in enumerate(batch.column("found").to_pylist()):
                raw, parts, at = data[off[i] : off[i + 1]], [], 0
                for a, b in spans_of(found, length):
                    # a span's ends move inwards to whole characters
                    while a < b and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                        b -= 1
                    parts.append(raw[at:a].tobytes())
                    at = b
                out.append((b"".join(parts) + raw[at:].tobytes()).decode())
            names = [c for c in batch.schema.names if c != "found"]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names], names)

    return run


def without_repeats(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, the text that is left, in whole characters, and what was carried."""
    return found.mapInArrow(_cut_texts(length), found.drop("found").schema)
