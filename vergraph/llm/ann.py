"""Operator 1: inner-product search over score-aware four-bit codes.

Vectors are split into pairs of dimensions; each pair is coded by one of 16
codewords (four bits).  The codebooks minimise an anisotropic loss: of the
residual x - code, the part parallel to x, which changes large inner products,
weighs ``eta`` times as much as the rest.  Codebooks are fitted on at most
``sample`` vectors (those with the smallest hashes); every vector is coded.

Rows live in blocks of ``block`` vectors at most, each with its codes and
originals; queries in tiles of ``tile``.  Every tile meets every block in one
task: per-query tables of 16 entries a pair, scaled to one byte, are summed over
the codes.  Rows whose coded score comes within the codes' measured error of the
query's floor get their exact inner product in double precision, and the best of
a block that are not under the floor go on.  The first floor is the
2(k + 1)-th best exact score in ``floor_sample`` vectors; blocks are scanned in
waves, each ``WAVE`` times as large as all before, and after each the floor
rises to the (k + 1)-th best score found, so the number of exact scores grows
with the logarithm of the rows.

Equal vectors are coded and scored once, as one key; a key stands for its
k + 1 smallest ids, which are all that can be among k nearest.

Nulls and empties: vectors that are null, zero, of another than the most
common length, or hold null or non-finite components take no part; null ids
neither.  Repeated ids are rows of their own, but a row never finds its own
id.  Without usable vectors the result is empty.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import ship, stage

SAMPLE, FLOOR_SAMPLE, BLOCK, TILE, WAVE, ETA_AT = 16_384, 4096, 65_536, 16_384, 16, 0.2


def _usable(batches):
    """vec_id, query, key (digest), v (float32 bytes), dim: usable rows only."""
    for batch in batches:
        out = {"vec_id": [], "query": [], "key": [], "v": [], "dim": []}
        for i, q, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if i is None or not x.is_valid or x.values is None or x.values.null_count or not len(x.values):
                continue
            v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(v).all() or not v.any():
                continue
            raw = (v + 0.0).astype("<f8").tobytes()
            for k, y in zip(out, (i, bool(q), hashlib.blake2b(raw, digest_size=16).digest(), raw, len(v)), strict=True):
                out[k].append(y)
        yield pa.RecordBatch.from_arrays([pa.array(out["vec_id"], pa.int64()), pa.array(out["query"], pa.bool_()), pa.array(out["key"], pa.binary()), pa.array(out["v"], pa.binary()), pa.array(out["dim"], pa.int32())], list(out))


class Codebooks:
    """16 codewords for each pair of dimensions."""

    def __init__(self, x: np.ndarray, rounds: int = 6, threshold: float = ETA_AT):
        n, d = x.shape
        self.dim, self.pairs = d, -(-d // 2)
        self.eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
        parts = self._split(x)
        rng = np.random.default_rng(3)
        self.words = np.stack([p[rng.permutation(n)[np.arange(16) % n]] for p in parts])
        for _ in range(rounds):  # plain k-means first
            codes = self._nearest(parts)
            for s, p in enumerate(parts):
                for k in range(16):
                    if (own := codes[s] == k).any():
                        self.words[s, k] = p[own].mean(axis=0)
        weight = (self.eta - 1) / np.maximum((x * x).sum(axis=1), 1e-300)
        for _ in range(rounds):  # then under the anisotropic loss
            codes, along = self._encode(parts, weight)
            for s, p in enumerate(parts):
                other = along - self._along(p, s, codes[s])
                for k in range(16):
                    own = codes[s] == k
                    if not own.any():
                        continue
                    y, w = p[own], weight[own]
                    a = len(y) * np.eye(2) + (y * w[:, None]).T @ y
                    b = y.sum(axis=0) + (w * (other[own] + (y * y).sum(axis=1))) @ y
                    self.words[s, k] = np.linalg.solve(a, b)
                along = other + self._along(p, s, codes[s])

    def _split(self, x):
        if x.shape[1] % 2:
            x = np.concatenate([x, np.zeros((len(x), 1))], axis=1)
        return [np.ascontiguousarray(x[:, 2 * s : 2 * s + 2]) for s in range(self.pairs)]

    def _nearest(self, parts):
        return [np.argmin(((w * w).sum(axis=1) / 2)[None, :] - p @ w.T, axis=1) for p, w in zip(parts, self.words, strict=True)]

    def _along(self, p, s, code):
        """The residual's share along x that pair s gives."""
        return ((p - self.words[s][code]) * p).sum(axis=1)

    def _encode(self, parts, weight, sweeps: int = 2):
        codes = self._nearest(parts)
        along = sum(self._along(p, s, codes[s]) for s, p in enumerate(parts))
        for _ in range(sweeps):
            for s, p in enumerate(parts):
                other = along - self._along(p, s, codes[s])
                rest = p[:, None, :] - self.words[s][None]
                own = (rest * p[:, None, :]).sum(axis=2)
                codes[s] = np.argmin((rest * rest).sum(axis=2) + weight[:, None] * (other[:, None] + own) ** 2, axis=1)
                along = other + own[np.arange(len(p)), codes[s]]
        return codes, along

    def encode(self, x: np.ndarray) -> np.ndarray:
        """One byte for every two pairs: array [pairs / 2, row]."""
        parts = self._split(x)
        codes = self._encode(parts, (self.eta - 1) / np.maximum((x * x).sum(axis=1), 1e-300))[0]
        if len(codes) % 2:
            codes.append(np.zeros(len(x), np.int64))
        return np.stack([codes[i] * 16 + codes[i + 1] for i in range(0, len(codes), 2)]).astype(np.uint8)

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query and byte of a code the scaled sum of both entries, each
        rounded to one of 128 levels (array [query, byte, 256]); the scale, and
        the score at level 0."""
        parts = self._split(q)
        t = np.stack([p @ w.T for p, w in zip(parts, self.words, strict=True)], axis=1)
        if t.shape[1] % 2:
            t = np.concatenate([t, np.zeros_like(t[:, :1])], axis=1)
        least = t.min(axis=2, keepdims=True)
        t = t - least
        scale = 127 / np.maximum(t.max(axis=(1, 2)), 1e-300)
        t = np.rint(t * scale[:, None, None]).astype(np.uint8)
        return (t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, 256), scale, least.sum(axis=(1, 2))

    def measure(self, x: np.ndarray, most: int = 256) -> None:
        """By how much the codes may understate a large score: the 99.7 % point
        of exact minus coded score over the best hundredth of the sample's pairs."""
        q, coded = x[:most], np.zeros((min(most, len(x)), len(x)))
        codes = self.encode(x)
        for s, p in enumerate(self._split(q)):
            own = codes[s // 2] >> 4 if s % 2 == 0 else codes[s // 2] & 15
            coded += (p @ self.words[s].T)[:, own]
        exact = q @ x.T
        best = exact >= np.quantile(exact, 0.99, axis=1, keepdims=True)
        self.margin = max(0.0, float(np.quantile((exact - coded)[best], 0.997)))


def _encode_rows(shared):
    def run(batches):
        books, _ = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("v").to_pylist()), "<f8").reshape(batch.num_rows, books.dim)
            codes = np.ascontiguousarray(books.encode(x).T)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "least", "block", "v")), pa.array([c.tobytes() for c in codes], pa.binary())], ["key", "least", "block", "v", "code"])

    return run


def _floors(shared, k: int):
    """Adds each query's ``k``-th best exact score within the sample."""

    def run(batches):
        books, sample = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                q = np.frombuffer(b"".join(part.column("v").to_pylist()), "<f8").reshape(part.num_rows, books.dim)
                scores = q @ sample.T
                floor = np.partition(scores, -k, axis=1)[:, -k] if sample.shape[0] >= k else np.full(len(q), -np.inf)
                # rounding differs between ways of summing
                floor = np.maximum(floor - 1e-9 * (1 + np.abs(floor)), -1e308)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("v"), pa.array(floor)], ["key", "v", "floor"])

    return run


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of vectors along the last axis, summed the same way wherever they stand."""
    return (q * x).sum(axis=-1)


def _scan(shared, k: int):
    """Rows sorted by block, tile and kind: the rows of a block, then the queries of a tile."""

    def run(batches):
        books, _ = shared.value
        place, keys, least, rows, codes, ready = None, [], [], [], [], None
        for batch in batches:
            b, t, isq = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "tile", "is_query"))
            edges = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (t[1:] != t[:-1]) | (isq[1:] != isq[:-1]))) if len(b) else []
            for start, end in zip(edges, [*edges[1:], len(b)], strict=True):
                part = batch.slice(start, end - start)
                if (b[start], t[start]) != place:
                    place, keys, least, rows, codes, ready = (b[start], t[start]), [], [], [], [], None
                if not isq[start]:
                    keys += part.column("key").to_pylist()
                    least += part.column("least").to_pylist()
                    rows += part.column("v").to_pylist()
                    codes += part.column("code").to_pylist()
                    continue
                if not keys:
                    continue
                if ready is None:
                    ready = np.array(least), np.frombuffer(b"".join(rows), "<f8").reshape(len(keys), -1), np.ascontiguousarray(np.frombuffer(b"".join(codes), np.uint8).reshape(len(keys), -1).T)
                for at in range(0, part.num_rows, 128):
                    yield _best(books, keys, *ready, part.slice(at, 128), k)

    return run


def _best(books, keys, least, x, code, queries, k):
    """Rows whose coded score comes within the margin of the query's floor are
    scored exactly; the k best at or over the floor go on."""
    q = np.frombuffer(b"".join(queries.column("v").to_pylist()), "<f8").reshape(queries.num_rows, books.dim)
    floor, names = queries.column("floor").to_numpy(), queries.column("key").to_pylist()
    table, scale, zero = books.tables(q)
    total = np.zeros((len(q), len(keys)), np.uint16)
    for byte in range(len(code)):
        total += np.take(table[:, byte], code[byte], axis=1)
    enough = (floor - books.margin - zero) * scale - books.pairs / 4
    qi, xi = np.nonzero(total >= np.clip(enough, 0, 65535)[:, None])
    exact = np.concatenate([inner_products(q[qi[i : i + 65536]], x[xi[i : i + 65536]]) for i in range(0, max(1, len(qi)), 65536)])
    over = exact >= floor[qi]
    qi, xi, exact = qi[over], xi[over], exact[over]
    order = np.lexsort((least[xi], -exact, qi))
    qi, xi, exact = qi[order], xi[order], exact[order]
    keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    qi, xi, exact = qi[keep], xi[keep], exact[keep]
    return pa.RecordBatch.from_arrays([pa.array([names[i] for i in qi.tolist()], pa.binary()), pa.array([keys[i] for i in xi.tolist()], pa.binary()), pa.array(least[xi], pa.int64()), pa.array(exact, pa.float64())], ["query_key", "key", "least", "score"])


def _top(near: DataFrame, k: int) -> DataFrame:
    """The k best keys of each query, ties to the smaller id."""
    return near.withColumn("n", F.row_number().over(Window.partitionBy("query_key").orderBy(F.desc("score"), "least"))).where(F.col("n") <= k).drop("n")


def search(vectors: DataFrame, is_query: Column, k: int = 20, sample: int = SAMPLE, floor_sample: int = FLOOR_SAMPLE, block: int = BLOCK, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row that is a query."""
    spark = vectors.sparkSession
    ship(spark)
    found = vectors.select(F.col(id_col).cast("long").alias("vec_id"), is_query.alias("query"), F.col(vector_col).alias("embedding")).mapInArrow(_usable, "vec_id long, query boolean, key binary, v binary, dim int")
    found = stage(found, "ann-rows")
    common = found.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], empty)
    found = found.where(F.col("dim") == common["dim"])
    first = found.groupBy("key").agg(F.min("vec_id").alias("least"), F.max("query").alias("asked"))
    distinct = found.join(first, "key").where(F.col("vec_id") == F.col("least")).select("key", "least", "v", "asked").dropDuplicates(["key"])
    distinct = stage(distinct, "ann-distinct")
    size = distinct.agg(F.count("*").alias("n"), F.count_if("asked").alias("asked")).first()
    held = [r["v"] for r in distinct.orderBy("key").limit(sample).select("v").collect()]  # at most ``sample`` vectors
    x = np.frombuffer(b"".join(bytes(v) for v in held), "<f8").reshape(len(held), common["dim"])
    books = Codebooks(x)
    books.measure(x)
    shared = spark.sparkContext.broadcast((books, x[:floor_sample]))
    own = min(block, max(4096, -(-size["n"] // (2 * spark.sparkContext.defaultParallelism))))  # smaller blocks where few would leave cores idle
    own = min(own, block)
    blocks, tiles = max(1, -(-size["n"] // own)), max(1, -(-size["asked"] // tile))
    coded = distinct.select("key", "least", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), "v")
    coded = stage(coded.mapInArrow(_encode_rows(shared), "key binary, least long, block int, v binary, code binary"), "ann-coded")
    queries = distinct.where("asked").select("key", "v").mapInArrow(_floors(shared, 2 * (k + 1)), "key binary, v binary, floor double")
    queries = stage(queries.withColumn("tile", F.pmod(F.xxhash64("key"), F.lit(tiles)).cast("int")), "ann-queries")
    best, start = None, 0
    while start < blocks:
        end = min(blocks, max(-(-WAVE * floor_sample // own), start * (WAVE + 1), 1))
        rows = coded.where((F.col("block") >= start) & (F.col("block") < end)).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumn("is_query", F.lit(False))
        asked = queries.withColumn("block", F.explode(F.sequence(F.lit(start), F.lit(end - 1)))).withColumn("is_query", F.lit(True))
        near = rows.unionByName(asked, allowMissingColumns=True).repartition("block", "tile").sortWithinPartitions("block", "tile", "is_query")
        near = near.mapInArrow(_scan(shared, k + 1), "query_key binary, key binary, least long, score double")
        best = stage(_top(near if best is None else near.union(best), k + 1), "ann-near")
        if end < blocks:
            raised = best.groupBy(F.col("query_key").alias("key")).agg(F.count("*").alias("n"), F.min("score").alias("least_score")).where(F.col("n") == k + 1).select("key", "least_score")
            queries = stage(queries.join(raised, "key", "left").withColumn("floor", F.greatest("floor", F.coalesce("least_score", "floor"))).drop("least_score"), "ann-queries")
        start = end
    names = found.select("key", "vec_id").withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    near = best.join(names.select("key", "vec_id"), "key").select("query_key", F.col("vec_id").alias("least"), "score")
    near = _top(near, k + 1).groupBy("query_key").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("least").alias("vec_id")))).alias("list"))  # k + 1 at most
    asked = found.where("query").select(F.col("vec_id").alias("query_id"), F.col("key").alias("query_key")).join(near, "query_key")
    others = F.slice(F.filter("list", lambda e: e["vec_id"] != F.col("query_id")), 1, k)
    return asked.select("query_id", F.posexplode(others).alias("pos", "e")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.s")).alias("score"))
