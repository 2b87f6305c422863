"""Operator 2: ordinal cumulative-link regression on graded ratings.

A text is a set of hashed features: its lower-case words, and bins of a few
shape measures (share of symbols, capitals and repeated words, word length,
length).  One weight vector, shared by all thresholds, gives a latent score f;
ordered thresholds t turn it into P(grade <= k) = logistic(t_k - f).  Fitting
is follow-the-regularised-leader with an L1 penalty, on at most
``max_labelled`` labelled rows (the rows with the smallest hashes of their
id) and, in the same order, at most ``max_bytes`` of their features, which are
the bounds of what the driver holds.  Scoring runs over all rows.

Grades here: 0 toxic, 1 low quality, 2 good.  A text is selected when the
tail probability P(grade >= 2) is at least ``least``.

Nulls and empties: a null text is the empty text, with the shape features
only.  Labels that are null, or whose document is missing, are left out; a
doc_id labelled twice counts twice, a document that is there several times once.
Without any usable label every text gets the prior (all grades equal) and is
kept; a chance of exactly ``least`` is enough.  Very long texts are read whole,
their hashes made stretch by stretch.  Extra columns are ignored, or, where
documents come back, kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ALNUM, NOT_SPACE, U64, Words, binary_rows, slices
from .workspace import ship, stage

BITS, MAX_LABELLED, MAX_BYTES, LEAST = 18, 20_000, 64 << 20, 0.5
#: Bytes of features that come to the driver at a time, or one row's.
PIECE_BYTES = 4 << 20
EDGES = np.array([0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.45, 0.6, 0.8])


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature indexes of all rows, ascending and distinct in each; row bounds."""
    size, n = 1 << BITS, len(off) - 1
    words = Words(data, off, ALNUM)
    shape = 16 * 16
    index = (words.hash >> U64(64 - BITS)).astype(np.int64)
    index = np.where(index < shape, index + shape, index)
    keys = np.unique(words.row * size + index) if len(index) else np.zeros(0, np.int64)
    distinct = np.bincount(keys // size, minlength=n)

    def per_row(mask):
        sums = np.append(0, np.cumsum(mask))
        return (sums[off[1:]] - sums[off[:-1]]).astype(float)

    letters = per_row(NOT_SPACE[data]) if len(data) else np.zeros(n)
    plain = per_row(ALNUM[data] | ((data >= 65) & (data <= 90))) if len(data) else np.zeros(n)
    upper = per_row((data >= 65) & (data <= 90)) if len(data) else np.zeros(n)
    bars = per_row(data == 0x7C) if len(data) else np.zeros(n)
    some = np.maximum(letters, 1)
    measures = [
        (letters - plain) / some,
        upper / some,
        bars / some * 5,
        1 - distinct / np.maximum(words.count, 1),
        np.minimum(plain / np.maximum(words.count, 1) / 20, 1),
        np.minimum(np.log2(words.count + 1) / 16, 1),
    ]
    bins = np.stack([i * 16 + np.searchsorted(EDGES, m, side="right") for i, m in enumerate(measures)], axis=1)
    rows = np.repeat(np.arange(n), len(measures))
    keys = np.sort(np.concatenate([keys, rows * size + bins.ravel()]))
    return keys % size, np.searchsorted(keys // size, np.arange(n + 1))


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class CumulativeLink:
    def __init__(self, grades: int):
        self.w = np.zeros(1 << BITS)
        share = np.arange(1, grades) / grades
        self.t = np.log(share / (1 - share))

    def latent(self, index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.append(0.0, np.cumsum(self.w[index]))
        return sums[bounds[1:]] - sums[bounds[:-1]]

    def tails(self, f: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... by row."""
        return 1 - logistic(self.t[None, :] - f[:, None])

    def fit(self, rows: list[np.ndarray], grade: np.ndarray, steps: int = 2500, batch: int = 64, alpha: float = 0.15, l1: float = 1.0, l2: float = 0.1, seed: int = 7) -> None:
        z, s = np.zeros_like(self.w), np.zeros_like(self.w)
        rng, n, k = np.random.default_rng(seed), len(rows), len(self.t)
        base = np.bincount(grade, minlength=k + 1).astype(float) + 1
        below = np.cumsum(base)[:-1] / base.sum()
        self.t = np.log(below / (1 - below))
        # a few labels are gone over more often, many at least twelve times, until the loss stays
        least, stale = np.inf, 0
        for epoch in range(min(400, max(12, -(-steps * batch // max(1, n))))):
            loss = 0.0
            rate = 0.05 / (1 + epoch)
            order = rng.permutation(n)
            for i in range(0, n, batch):
                own = order[i : i + batch]
                index = np.concatenate([rows[j] for j in own])
                bounds = np.append(0, np.cumsum([len(rows[j]) for j in own]))
                f, y = self.latent(index, bounds), grade[own]
                high = np.append(self.t, np.inf)[y] - f
                low = np.append(-np.inf, self.t)[y] - f
                a, b = np.where(np.isinf(high), 1.0, logistic(high)), np.where(np.isinf(low), 0.0, logistic(low))
                p = np.maximum(a - b, 1e-9)
                loss -= np.log(p).sum()
                at, back = np.unique(index, return_inverse=True)
                g = np.bincount(back, weights=np.repeat(1 - a - b, np.diff(bounds)))  # of the loss
                new = s[at] + g * g
                z[at] += g - (np.sqrt(new) - np.sqrt(s[at])) / alpha * self.w[at]
                s[at] = new
                self.w[at] = np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((1 + np.sqrt(new)) / alpha + l2))
                dt = np.zeros(k + 2)
                np.add.at(dt, y + 1, a * (1 - a) / p)
                np.add.at(dt, y, -b * (1 - b) / p)
                self.t = self.t + rate * dt[1 : k + 1] / len(own) * 4
                self.t = np.maximum.accumulate(self.t + 1e-3 * np.arange(k)) - 1e-3 * np.arange(k)
            stale = 0 if loss < least * 0.998 else stale + 1
            least = min(least, loss)
            if epoch >= 11 and stale >= 4:
                break


def _features(batches):
    for batch, data, off in slices(batches, "text"):
        index, bounds = features(data, off)
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("grade"), binary_rows(index.astype("<i4"), np.diff(bounds))], ["label", "grade", "index"])


def fit(docs: DataFrame, graded: DataFrame, grades: int = 3, max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_BYTES) -> CumulativeLink | None:
    """``docs``: doc_id, text; ``graded``: doc_id, grade (0 to grades - 1)."""
    spark = docs.sparkSession
    ship(spark)
    usable = graded.select("doc_id", F.col("grade").cast("int").alias("grade")).where(F.col("doc_id").isNotNull() & F.col("grade").between(0, grades - 1))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(max_labelled).collect()
    if not sample:
        return None
    numbered = spark.createDataFrame([(i, r["doc_id"], r["grade"]) for i, r in enumerate(sample)], usable.select(F.lit(0).alias("label"), "doc_id", "grade").schema)
    found = docs.select("doc_id", "text").join(F.broadcast(numbered), "doc_id").select("label", "grade", "text").mapInArrow(_features, "label int, grade int, index binary")
    found = stage(found.groupBy("label", "grade").agg(F.min("index").alias("index")), "quality-features")
    sizes = found.select("label", F.octet_length("index").alias("n")).orderBy("label").toArrow()  # at most max_labelled rows
    labels, ends = (sizes["label"].to_numpy(), np.cumsum(sizes["n"].to_numpy(), dtype=np.int64))
    fitting = int(np.searchsorted(ends, max(max_bytes, ends[0] if len(ends) else 0), side="right"))
    if not fitting:
        return None
    pieces, at = [], 0
    while at < fitting:
        end = int(np.searchsorted(ends[:fitting], (ends[at - 1] if at else 0) + PIECE_BYTES, side="right"))
        end = max(end, at + 1)
        pieces.append(found.where(F.col("label").between(int(labels[at]), int(labels[end - 1]))).select("grade", "index").toArrow())
        at = end
    held = pa.concat_tables(pieces)
    held = held.append_column("n", pc.binary_length(held["index"]))
    order = pc.sort_indices(held, [("grade", "ascending"), ("n", "ascending"), ("index", "ascending")]).to_numpy()  # whatever order the rows come in
    rows = [np.frombuffer(x.as_buffer(), "<i4") for x in held["index"]]  # views, not copies
    model = CumulativeLink(grades)
    model.fit([rows[i] for i in order], held["grade"].to_numpy()[order])
    return model


def _score(shared):
    def run(batches):
        model = shared.value
        for batch, data, off in slices(batches, "text"):
            index, bounds = features(data, off)
            p = model.tails(model.latent(index, bounds))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p.sum(axis=1)), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "expected_grade", "tail"])

    return run


def grades_of(labels: DataFrame) -> DataFrame:
    """0: toxic, 1: low quality, 2: good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


def grade_texts(docs: DataFrame, graded: DataFrame, grades: int = 3, least: float = LEAST, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, p_1 ... (P(grade >= k)), keep: one row per document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    model = fit(rows, graded, grades, max_labelled)
    if model is None:
        prior = [F.lit(1 - k / grades).alias(f"p_{k}") for k in range(1, grades)]
        return rows.select("doc_id", F.lit((grades - 1) / 2).alias("expected_grade"), *prior, F.lit(True).alias("keep"))
    scored = rows.mapInArrow(_score(spark.sparkContext.broadcast(model)), f"doc_id {kind}, expected_grade double, tail array<double>")
    return scored.select("doc_id", "expected_grade", *[F.col("tail")[k - 1].alias(f"p_{k}") for k in range(1, grades)], (F.col("tail")[grades - 2] >= least).alias("keep"))


def _select(shared, least: float, text_col: str):
    def run(batches):
        model = shared.value
        for batch, data, off in slices(batches, text_col):
            yield batch.filter(pa.array(model.tails(model.latent(*features(data, off)))[:, -1] >= least))

    return run


def select_texts(docs: DataFrame, graded: DataFrame, grades: int = 3, least: float = LEAST, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that ``grade_texts`` keeps, with all their columns."""
    spark = docs.sparkSession
    model = fit(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), graded, grades, max_labelled)
    if model is None:
        return docs
    return docs.mapInArrow(_select(spark.sparkContext.broadcast(model), least, text_col), docs.schema)
