"""Operator 7: benchmark decontamination by a broadcast set of word windows.

The windows of the benchmark (``width`` consecutive words; an item with fewer
is one window of its own length) are made in Spark and packed into sorted hash
arrays with their words beside them.  Tasks hash all windows of the documents'
words, look them up, and verify each hit word by word.  The set is broadcast in
parts of about ``part_bytes``, by hash; a larger benchmark takes further scans,
one after another, and each part's broadcast is gone before the next is made:
memory is bounded whatever the benchmark's size.

Nulls and empties: a null or word-less document has n_words = 0 and no hit; a
null or word-less item has no window; a null item_id is listed as "".  Repeated
documents are rows of their own, repeated items are listed once per document.
Very long texts are read whole, their hashes made stretch by stretch.  Windows
that several items share list them all.  Empty tables give an empty result, or
no hits.  Other columns are ignored, or, where documents come back, kept,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ALNUM, U64, Words, slices
from .workspace import ship, stage, unused, with_row_ids

WIDTH = 10
PART_BYTES = 32 << 20


def _item_windows(width: int):
    """(k, hash, words, item) of every window of every item."""

    def run(batches):
        for batch, data, off in slices(batches, "text"):
            words, items = Words(data, off, ALNUM), batch.column("item").to_pylist()
            k, h, w, own = [], [], [], []
            for row, item in enumerate(items):
                first, n = int(words.first[row]), int(words.count[row])
                size = min(n, width)
                if not size:
                    continue
                at = np.arange(first, first + n - size + 1)
                k += [size] * len(at)
                h += words.prefix.ranges(at, at + size).view(np.int64).tolist()
                w += [b" ".join(words.text(j) for j in range(i, i + size)) for i in at.tolist()]
                own += [item] * len(at)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(h, pa.int64()), pa.array(w, pa.binary()), pa.array(own, pa.string())], ["k", "hash", "words", "item"])

    return run


class WindowSet:
    """Windows sorted by hash, for each length: one entry per window and item."""

    def __init__(self, table: pa.Table):
        k, h = table["k"].to_numpy(), table["hash"].to_numpy().view(U64)
        words, items = table["words"].combine_chunks(), table["item"].combine_chunks()
        self.by_length = {}
        for size in np.unique(k).tolist():
            own = np.flatnonzero(k == size)
            own = own[np.argsort(h[own], kind="stable")]
            self.by_length[size] = h[own], words.take(pa.array(own)), items.take(pa.array(own))

    def hits(self, words: Words, n: int) -> tuple[list[list[tuple[int, int]]], list[set]]:
        """Per row of a slice: verified windows, as first and last word, and their items."""
        runs: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        found: list[set] = [set() for _ in range(n)]
        for k, (known, texts, items) in self.by_length.items():
            at, h = words.windows(k)
            first = np.searchsorted(known, h)
            hit = np.flatnonzero(known[np.minimum(first, len(known) - 1)] == h)
            last = np.searchsorted(known, h[hit], side="right")
            for i, a, b in zip(at[hit].tolist(), first[hit].tolist(), last.tolist(), strict=True):
                own = b" ".join(words.text(j) for j in range(i, i + k))
                same = [items[j].as_py() for j in range(a, b) if texts[j].as_py() == own]
                if same:
                    row = int(words.row[i])
                    found[row].update(same)
                    begin = i - int(words.first[row])
                    runs[row].append((begin, begin + k))
        return runs, found


def window_parts(benchmark: DataFrame, width: int = WIDTH, part_bytes: int = PART_BYTES, item_col: str = "item_id", item_text_col: str = "text"):
    """The broadcasts of all parts of the set, one at a time; each is destroyed
    when the next is asked for, so use it in a job that has ended by then.  A
    set of one part is left to its user, and may be used lazily."""
    spark = benchmark.sparkSession
    ship(spark)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text"))
    windows = stage(items.mapInArrow(_item_windows(width), "k int, hash long, words binary, item string").distinct(), "leak-windows")
    size = windows.agg(F.sum(F.octet_length("words") + F.octet_length("item") + 24)).first()[0] or 0
    parts = -(-size // part_bytes) or 1
    for i in range(parts):
        own = windows.where(F.pmod(F.xxhash64("hash"), F.lit(parts)) == i)
        shared = spark.sparkContext.broadcast(WindowSet(own.toArrow()))  # about part_bytes
        yield parts, shared
        if parts > 1:
            shared.destroy()


def merged(own: list[tuple[int, int]]) -> list[int]:
    """Overlapping or touching runs as one: start, end, start, end, ..."""
    flat: list[int] = []
    for a, b in sorted(own):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


def scan(shared: Broadcast):
    """Per document: word count, covered word indexes as runs, items found."""

    def run(batches):
        for batch, data, off in slices(batches, "text"):
            words = Words(data, off, ALNUM)
            runs, items = shared.value.hits(words, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.count, pa.int64()), pa.array([merged(r) for r in runs], pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], ["doc_id", "n_words", "runs", "items"])

    return run


def keep_clean(shared: Broadcast, text_col: str):
    """The rows without any hit, as they are."""

    def run(batches):
        for batch, data, off in slices(batches, text_col):
            found = shared.value.hits(Words(data, off, ALNUM), batch.num_rows)[1]
            yield batch.filter(pa.array([not x for x in found], pa.bool_()))

    return run


SCAN = "n_words long, runs array<bigint>, items array<string>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, part_bytes: int = PART_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs (covered word indexes as
    start, end, start, end, ...) and items (sorted ids as strings)."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    rows = every = None
    for parts, shared in window_parts(benchmark, width, part_bytes, item_col, item_text_col):
        if parts == 1:
            return source.mapInArrow(scan(shared), f"doc_id {kind}, {SCAN}")
        if rows is None:
            rows = with_row_ids(source, "row", "leak-rows")
        found = rows.select("row", "text").mapInArrow(scan(shared), f"doc_id long, {SCAN}")
        found = stage(found, "leak-part")  # rows, not doc_ids: those may repeat
        every = found if every is None else every.unionByName(found)
    whole = every.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    whole = whole.mapInArrow(_join_runs, f"doc_id long, {SCAN}").withColumnRenamed("doc_id", "row")
    return rows.select("row", "doc_id").join(whole, "row").select("doc_id", "n_words", "runs", "items")


def _join_runs(batches):
    for batch in batches:
        out = [merged(list(zip(x[::2], x[1::2], strict=True))) for x in batch.column("runs").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(out, pa.list_(pa.int64())), batch.column("items")], ["doc_id", "n_words", "runs", "items"])


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    i = F.sequence(F.lit(0), F.greatest(F.size("runs") - 1, F.lit(0)))
    signed = F.transform(i, lambda k: F.coalesce(F.get("runs", k), F.lit(0)) * F.when(k % 2 == 1, 1).otherwise(-1))
    n_hit = F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, part_bytes: int = PART_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    for parts, shared in window_parts(benchmark, width, part_bytes, item_col, item_text_col):
        docs = docs.mapInArrow(keep_clean(shared, text_col), docs.schema)
        if parts > 1:
            docs = stage(docs, "leak-kept")
    return docs


def _cut_spans(text_col: str, runs_col: str):
    """The texts without the words of their runs, word by word of the same cut."""

    def run(batches):
        for batch, data, off in slices(batches, text_col):
            words, out = Words(data, off, ALNUM), []
            texts, runs = batch.column(text_col), batch.column(runs_col).to_pylist()
            for row, own in enumerate(runs):
                if not own:
                    out.append(texts[row].as_py())
                    continue
                first, at, parts = int(words.first[row]), int(off[row]), []
                for a, b in zip(own[::2], own[1::2], strict=True):
                    parts.append(data[at : int(words.start[first + a])].tobytes())
                    at = int(words.end[first + b - 1])
                out.append((b"".join(parts) + data[at : off[row + 1]].tobytes()).decode())
            names = [c for c in batch.schema.names if c != runs_col]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text_col else batch.column(c) for c in names], names)

    return run


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """All documents, with all their columns, hit words cut out of the text."""
    row, runs = unused(docs, "row"), unused(docs, "runs")
    rows = with_row_ids(docs, row, "leak-documents")
    found = find_contamination(rows, benchmark, id_col=row, text_col=text_col, **how).where(F.size("items") > 0).select(F.col("doc_id").alias(row), F.col("runs").alias(runs))
    return rows.join(found, row, "left").drop(row).mapInArrow(_cut_spans(text_col, runs), docs.schema)
