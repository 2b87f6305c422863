"""Operator 5: a content-addressed store of token ids.

A rolling hash over the last eight ids cuts every document's id stream into
chunks (at least 64, at most 4096 ids, about 320 on average).  A chunk's name
is its digest; equal chunks are written once.  The store is three Parquet
tables under one folder:

* ``chunks``  - digest, n, ids (little-endian, two or four bytes an id)
* ``recipes`` - doc_id, n_tokens, digests (16 bytes each), root, part; files in
  ascending doc_id order
* ``manifest`` - part, docs, root: the Merkle root over the part's documents

A document's ``root`` is the Merkle root over its chunk digests.  Reading
hashes each stored chunk again, rebuilds every document's root and every
part's root, and fails on any difference.  The crc of a document comes from
its chunks' crcs and lengths, so equal chunks are read and checked once.

Nulls and empties: a null or empty text holds just the end id.  Repeated
doc_ids are rows of their own (their order among each other is unspecified).
An empty table makes an empty store and result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import encoder, id_width, vocabulary_path, with_end
from .kernels import U64, Prefix, mix, slices
from .workspace import drop_staged, freeing_shuffles, shared_dir, ship, stage

ROLL, LEAST, MOST, MASK = 8, 64, 4096, U64(255)
BASE = U64(0xB5026F5AA96619E9)
#: Digests that a task remembers in order not to send a chunk twice.
SEEN = 200_000


def cuts(ids: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each row, as offsets into ``ids``."""
    ends = np.cumsum(counts)
    if len(ids) >= ROLL:
        at = np.arange(len(ids) - ROLL + 1)
        h = Prefix(mix(ids.astype(U64) + U64(1)), BASE).ranges(at, at + ROLL)
        marks = (at + ROLL)[(h & MASK) == 0]
    else:
        marks = np.zeros(0, np.int64)
    out, start = [], 0
    lo = np.searchsorted(marks, ends - counts + ROLL, side="left")
    hi = np.searchsorted(marks, ends, side="left")
    for end, a, b in zip(ends.tolist(), lo.tolist(), hi.tolist(), strict=True):
        own, last = [], start
        for m in [*marks[a:b].tolist(), end]:
            while m - last > MOST:
                last += MOST
                own.append(last)
            if m - last >= LEAST or m == end and m > last:
                own.append(m)
                last = m
        out.append(own)
        start = end
    return out


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node goes up as it is."""
    level = list(leaves) or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\x01" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _cut_documents(path: str, end_id: int, width: int):
    kind = np.dtype("<u2" if width == 2 else "<u4")

    def run(batches):
        coder, seen = encoder(path), set()
        for batch, data, off in slices(batches, "text"):
            ids, counts = with_end(*coder.encode(data, off), end_id)
            stored = ids.astype(kind)
            names, roots, new = [], [], []
            start = 0
            for own in cuts(ids, counts):
                mine, fresh = [], []
                for end in own:
                    payload = stored[start:end].tobytes()
                    name = digest(payload)
                    mine.append(name)
                    if name not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(name)
                        fresh.append({"digest": name, "n": end - start, "ids": payload})
                    start = end
                names.append(b"".join(mine))
                roots.append(merkle(mine))
                new.append(fresh)
            chunk = pa.struct([("digest", pa.binary()), ("n", pa.int32()), ("ids", pa.binary())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(names, pa.binary()), pa.array(roots, pa.binary()), pa.array(new, pa.list_(chunk))], ["doc_id", "n_tokens", "digests", "root", "new"])

    return run


def _unique(batches):
    """Of each digest in a partition that holds all its copies, sorted: the first."""
    last = None
    for batch in batches:
        names = batch.column(0).to_pylist()
        keep = [n != p for n, p in zip(names, [last, *names[:-1]], strict=True)]
        last = names[-1] if names else last
        yield batch.filter(pa.array(keep, pa.bool_()))


def _part_roots(batches):
    part, leaves = None, []
    for batch in batches:
        for p, root in zip(batch.column("part").to_pylist(), batch.column("root").to_pylist(), strict=True):
            if p != part and leaves:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(leaves)], pa.int64()), pa.array([merkle(leaves)], pa.binary())], ["part", "docs", "root"])
                leaves = []
            part = p
            leaves.append(root)
    if leaves:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(leaves)], pa.int64()), pa.array([merkle(leaves)], pa.binary())], ["part", "docs", "root"])


def write_store(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 2, width: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the three tables; returns the folder.  ``width``: bytes an id, by
    default two where all ids of the tokenizer fit, else four."""
    spark = docs.sparkSession
    ship(spark)
    tokenizer = tokenizer or vocabulary_path()
    width = id_width(tokenizer, width)
    folder = folder or f"{shared_dir(spark)}/vergraph/token-store-{uuid.uuid4().hex}"
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = stage(source.mapInArrow(_cut_documents(tokenizer, end_id, width), "doc_id long, n_tokens long, digests binary, root binary, new array<struct<digest: binary, n: int, ids: binary>>"), "token-chunks")
    chunks = cut.select(F.explode("new").alias("c")).select("c.digest", "c.n", "c.ids")
    chunks = chunks.repartition("digest").sortWithinPartitions("digest").mapInArrow(_unique, chunks.schema)
    recipes = cut.select("doc_id", "n_tokens", "digests", "root").repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id())
    with freeing_shuffles(spark):
        chunks.write.option("compression", "zstd").mode("overwrite").parquet(f"{folder}/chunks")
        recipes.write.mode("overwrite").parquet(f"{folder}/recipes")
        drop_staged(cut)
        manifest(spark, folder).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """part, docs, root as they follow from the recipe files."""
    return spark.read.parquet(f"{folder}/recipes").select("part", "doc_id", "root").repartition("part").sortWithinPartitions("part", "doc_id").mapInArrow(_part_roots, "part int, docs long, root binary")


POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two reflected polynomials modulo the crc polynomial."""
    out, bit = 0, 1 << 31
    while True:
        if a & bit:
            out ^= b
            if not a & (bit - 1):
                return out
        bit >>= 1
        if not bit:
            return out
        b = b >> 1 ^ (POLY if b & 1 else 0)


_shift: dict[int, int] = {}


def _power(n_bytes: int) -> int:
    """x to the power of 8 * n_bytes, reflected."""
    if n_bytes not in _shift:
        out, square, k = 1 << 31, 1 << 23, n_bytes
        while k:
            if k & 1:
                out = _times(square, out)
            square = _times(square, square)
            k >>= 1
        _shift[n_bytes] = out
    return _shift[n_bytes]


def crc_join(first: int, second: int, second_bytes: int) -> int:
    """crc32 of two byte strings from their crcs and the second's length."""
    return _times(_power(second_bytes), first) ^ second if first else second


def stored_ids(payload: bytes, n: int) -> np.ndarray:
    """The ids of a chunk, of two or four bytes each."""
    return np.frombuffer(payload, "<u2" if len(payload) == 2 * n else "<u4")


def _check_chunks(batches):
    for batch in batches:
        crcs = []
        for name, n, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if digest(payload) != name or len(payload) not in (2 * n, 4 * n):
                raise ValueError(f"stored chunk {name.hex()} is damaged")
            crcs.append(zlib.crc32(stored_ids(payload, n).astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], ["digest", "n", "crc"])


def _join_crcs(batches):
    for batch in batches:
        out, total = [], []
        for parts, root in zip(batch.column("parts").to_pylist(), batch.column("root").to_pylist(), strict=True):
            crc = n = 0
            parts.sort(key=lambda p: p["pos"])
            for p in parts:
                if p["n"] is None:
                    raise ValueError(f"stored chunk {p['digest'].hex()} is missing")
                crc = crc_join(crc, p["crc"], 4 * p["n"])
                n += p["n"]
            if merkle([p["digest"] for p in parts]) != root:
                raise ValueError("a document's chunks do not lead to its root")
            out.append(crc)
            total.append(n)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(total, pa.int64()), pa.array(out, pa.int64())], ["doc_id", "part", "n_tokens", "ids_crc32"])


def _recipe_rows(recipes: DataFrame) -> DataFrame:
    """One row per chunk of a document; ``row`` tells repeated doc_ids apart."""
    names = F.transform(F.sequence(F.lit(0), (F.length("digests") / 16 - 1).cast("int")), lambda k: F.substring(F.col("digests"), k * 16 + 1, F.lit(16)))
    rows = recipes.withColumn("row", F.monotonically_increasing_id())
    return rows.select("row", "doc_id", "part", "root", F.posexplode(names).alias("pos", "digest"))


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the stored files, all verified."""
    ship(spark)
    want, have = (x.select("part", "docs", F.hex("root").alias("root")) for x in (spark.read.parquet(f"{folder}/manifest"), manifest(spark, folder)))
    if want.exceptAll(have).union(have.exceptAll(want)).limit(1).count():
        raise ValueError("the manifest does not match the recipes")
    checked = spark.read.parquet(f"{folder}/chunks").select("digest", "n", "ids").mapInArrow(_check_chunks, "digest binary, n int, crc long")
    recipes = spark.read.parquet(f"{folder}/recipes")
    found = _recipe_rows(recipes).join(checked, "digest", "left").select("row", "doc_id", "part", "root", F.struct("pos", "digest", "n", "crc").alias("p"))
    whole = found.groupBy("row", "doc_id", "part", "root").agg(F.collect_list("p").alias("parts")).mapInArrow(_join_crcs, "doc_id long, part int, n_tokens long, ids_crc32 long")
    whole = stage(whole, "token-documents")
    parts = whole.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return whole.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part").select("doc_id", (F.col("_before") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and its ids as an array, rebuilt from recipe and chunks."""
    ship(spark)

    def rebuild(batches):
        for batch in batches:
            for x in batch.column("parts").to_pylist():
                if any(p["ids"] is None for p in x):
                    raise ValueError("a stored chunk is missing")
            ids = [np.concatenate([stored_ids(p["ids"], p["n"]) for p in sorted(x, key=lambda p: p["pos"])]).tolist() for x in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    chunks = spark.read.parquet(f"{folder}/chunks").select("digest", "n", "ids")
    rows = _recipe_rows(spark.read.parquet(f"{folder}/recipes")).join(chunks, "digest", "left")
    return rows.groupBy("row", "doc_id").agg(F.collect_list(F.struct("pos", "n", "ids")).alias("parts")).mapInArrow(rebuild, "doc_id long, ids array<int>")
