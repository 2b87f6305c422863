"""Operator 10: mixture-controlled packing by deficit round-robin.

Every source is a queue: the token stream of its documents.  Queues are served
in quanta of ``quantum`` tokens; a window of ``window`` tokens takes the next
window / quantum quanta.  Each queue's credit grows with its target share of
every window, and the next quantum goes to the queue that is owed most; what is
still owed is carried to the next window.  So quantum k of a queue of weight w
falls due at (2k + 1) / 2w, and the quanta in the order of their dues are what
the round-robin serves, over all windows and partitions.  Weights are target
proportions given by the user, or the queues' own sizes, with which all queues
run dry together; when one runs dry, the others go on in their proportions.
Queues without a given weight come after those that have one.

A task cuts each queue's documents into quanta as it encodes them; the quanta
are numbered over all tasks by range parts.  The last, shorter quanta of every
task follow in one run at the end, in the order of their dues, cut where windows
end.  So there may be any number of queues, and only the last window is padded.

Nulls and empties: a null or empty text is the end id alone; a null source is
the queue "".  Repeated rows are packed like any others, each by itself.  An
empty table gives no pieces.  A very long text is many pieces.  Equal dues are
served in the order of the queues' names.  Extra columns are ignored; a source
column is optional.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import encoder, vocabulary_path, with_end
from .kernels import ragged, slices
from .workspace import running_start, ship, stage

WINDOW, QUANTUM = 2048, 256
PIECES = "queue string, part int, k long, place long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def _cut(path: str, end_id: int, quantum: int, kind: pa.DataType):
    """A row for each part of a document in a quantum of its queue: the quantum
    (part, k), the place in it, and the ids where the quantum stays short."""
    numbers = ("k", "place", "start", "length", "ids_crc32", "doc_tokens")

    def run(batches):
        from pyspark import TaskContext

        coder, part = encoder(path), TaskContext.get().partitionId()
        given: dict[str, int] = {}
        open_: dict[str, list[tuple]] = {}  # pieces of each queue's unfinished quantum

        def rows(docs, queues, columns, ids):
            n = len(queues)
            return pa.RecordBatch.from_arrays(
                [pa.array(docs, kind), pa.array(queues, pa.string()), pa.array(np.full(n, part), pa.int32()), *[pa.array(c, pa.int64()) for c in columns], pa.array(ids, pa.binary()) if ids else pa.nulls(n, pa.binary())],
                ["doc_id", "queue", "part", *numbers, "ids"],
            )

        for batch, data, off in slices(batches, "text"):
            ids, counts = with_end(*coder.encode(data, off), end_id)
            doc, queue = batch.column("doc_id").to_pylist(), batch.column("queue").to_pylist()
            begin = np.empty(len(counts), np.int64)
            for i, (q, n) in enumerate(zip(queue, counts.tolist(), strict=True)):
                begin[i] = given.get(q, 0)
                given[q] = int(begin[i]) + n
            many = (begin + counts - 1) // quantum - begin // quantum + 1
            row, k = np.repeat(np.arange(len(counts)), many), ragged(begin // quantum, many)
            start = np.maximum(k * quantum - begin[row], 0)
            length = np.minimum((k + 1) * quantum - begin[row], counts[row]) - start
            place = begin[row] + start - k * quantum
            raw, at = memoryview(ids.astype("<u4").tobytes()), (np.cumsum(counts) - counts)[row] + start
            crc = np.array([zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)], np.int64)
            columns = (k, place, start, length, crc, counts[row])
            last = np.array([given[q] // quantum for q in queue])
            late = k >= last[row]  # in the quantum that is still open
            done = np.flatnonzero(~late)
            yield rows([doc[i] for i in row[done].tolist()], [queue[i] for i in row[done].tolist()], [c[done] for c in columns], None)
            free = [p for q in set(queue) for p in open_.get(q, []) if p[2] < given[q] // quantum]
            if free:
                docs, queues, *rest = zip(*free, strict=True)
                yield rows(docs, queues, rest[:-1], None)
            for q in set(queue):
                open_[q] = [p for p in open_.get(q, []) if p[2] >= given[q] // quantum]
            for j in np.flatnonzero(late).tolist():
                i = int(row[j])
                open_[queue[i]].append((doc[i], queue[i], *[int(c[j]) for c in columns], bytes(raw[4 * int(at[j]) : 4 * int(at[j] + length[j])])))
        left = [p for own in open_.values() for p in own]
        if left:
            docs, queues, *rest = zip(*left, strict=True)
            yield rows(docs, queues, rest[:-1], list(rest[-1]))

    return run


def _split(window: int):
    """Pieces with their ``position`` in the run of all windows, cut where a window ends."""

    def run(batches):
        for batch in batches:
            position, length = batch.column("position").to_numpy(), batch.column("length").to_numpy()
            many = (position + length - 1) // window - position // window + 1
            row, w = np.repeat(np.arange(len(many)), many), ragged(position // window, many)
            begin = np.maximum(w * window, position[row])
            size = np.minimum((w + 1) * window, (position + length)[row]) - begin
            inside = begin - position[row]
            ids = batch.column("ids").to_pylist()
            crc = [zlib.crc32(ids[i][4 * a : 4 * (a + n)]) for i, a, n in zip(row.tolist(), inside.tolist(), size.tolist(), strict=True)]
            own = batch.select(["doc_id", "doc_tokens", "queue"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [own.column(0), pa.array(batch.column("start").to_numpy()[row] + inside), pa.array(size), pa.array(crc, pa.int64()), own.column(1), pa.array(w), pa.array(begin - w * window), own.column(2)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"],
            )

    return run


def quantum_positions(quanta: DataFrame, quantum: int, weights: dict[str, float] | None = None) -> DataFrame:
    """queue, part, k, position (tokens before it) of every quantum, from
    ``quanta``: queue, part, k, n (tokens in it)."""
    by_part = quanta.groupBy("queue", "part").agg(F.count("*").alias("own"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.sum("own").over(Window.partitionBy("queue")).cast("double")
    by_part = by_part.select("queue", "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("first"), weight.alias("weight"), F.lit(0.0).alias("wait"))
    if weights:
        asked = quanta.sparkSession.createDataFrame([(q, float(w)) for q, w in weights.items() if w > 0], "queue string, asked double")
        by_part = by_part.join(F.broadcast(asked), "queue", "left").withColumn("wait", F.when(F.col("asked").isNull(), 1e18).otherwise(0.0)).withColumn("weight", F.coalesce("asked", "weight")).drop("asked")
    due = F.col("wait") + (2 * (F.col("first") + F.col("k")) + 1) / (2 * F.col("weight"))
    dued = quanta.join(by_part, ["queue", "part"]).select("queue", "part", "k", "n", due.alias("due"))
    order = ["due", "queue", "part", "k"]
    full = running_start(dued.where(F.col("n") == quantum), [], order, F.lit(1), "position", "pack-full")
    short = running_start(dued.where(F.col("n") < quantum), [], order, F.col("n"), "position", "pack-short")
    base = quanta.where(F.col("n") == quantum).count() * quantum
    return full.select("queue", "part", "k", (F.col("position") * quantum).alias("position")).union(short.select("queue", "part", "k", F.col("position") + base))


def pack(docs: DataFrame, window: int = WINDOW, quantum: int = QUANTUM, end_id: int = 1, tokenizer: str | None = None, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue: one row per piece."""
    if window % quantum:
        raise ValueError("a window must hold whole quanta")
    spark = docs.sparkSession
    ship(spark)
    queue = F.coalesce(F.col(source_col).cast("string"), F.lit("")) if source_col and source_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), queue.alias("queue"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    arrow = pa.string() if kind == "string" else {"int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind, pa.int64())
    pieces = stage(rows.mapInArrow(_cut(tokenizer or vocabulary_path(), end_id, quantum, arrow), f"doc_id {kind}, {PIECES}"), "pack-pieces")
    quanta = stage(pieces.groupBy("queue", "part", "k").agg(F.sum("length").alias("n")), "pack-quanta")
    placed = pieces.join(quantum_positions(quanta, quantum, weights), ["queue", "part", "k"]).withColumn("position", F.col("position") + F.col("place"))
    w = F.lit(window)
    whole = placed.where("ids is null").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.floor(F.col("position") / w).alias("sequence_id"), F.pmod("position", w).alias("offset"), "queue")
    short = placed.where("ids is not null").select("doc_id", "start", "length", "doc_tokens", "queue", "position", "ids")
    return whole.union(short.mapInArrow(_split(window), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"))


def window_shares(pieces: DataFrame) -> DataFrame:
    """sequence_id, queue, share: which part of a window's tokens each queue has."""
    own = pieces.groupBy("sequence_id", "queue").agg(F.sum("length").alias("tokens"))
    return own.select("sequence_id", "queue", (F.col("tokens") / F.sum("tokens").over(Window.partitionBy("sequence_id"))).alias("share"))
