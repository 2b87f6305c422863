"""Operator 12: conversation prefix trie by truncation peeling.

Levels are peeled from the deepest one up.  At depth d the nodes that survived
from depth d + 1, with their last turn stripped, meet the conversations that end
at d; those with the same prefix are one node, whose sums are then complete.
Every node is found and aggregated once, when its level is peeled.

A prefix is known by a 128-bit key.  Each turn has a SHA-256 digest; four sums
of 32-bit parts, over digests bound to their depth, run along a conversation,
so that keys of all its prefixes come from one window.  Conversations with equal
turns are one class first: they end in the same node, and only the one with the
smallest id is peeled.

Deep levels are peeled inside tasks: below the smallest depth at which no prefix
has more than ``most`` rows under it, all that shares the prefix goes into one
task (counted before).  Levels above are one Spark aggregation each, with partial
sums before the shuffle, so a first turn that a third of all conversations share
is no group anywhere.  Ids that end in a node are joined in pieces of at most 512
before the one hash over them, which is read as a stream.

Defined cases: null turns come first, ties are in order of role and digest; null
role or text is empty; rows without a conv_id belong to no conversation; equal
rows are turns of their own; an empty table has no nodes, not even a root.  Very
long texts are digested whole; a conversation of any length is ordered by one
sort, which spills.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import drop_staged, ship, stage

#: Most rows under a prefix that is peeled in one task.
MOST = 20_000
#: The key of the root, and the hash of no ids.
ROOT, NO_ENDS = hashlib.md5(b"root").digest(), hashlib.sha256(b"").hexdigest()
NODE = "key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def digested(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1, in order of turn), digest of role and text, chars of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = turns.select("conv_id", "turn", "role", digest.alias("digest"), F.length("text").cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "digest", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """The conversations with heads shared within each hundred ids: the first h
    turns of conversation c - c % 100, then the own turns after the first h, where h
    is crc32(c) % 6.  conv_id, depth, digest, chars; a row of depth 0 for each."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    base = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    heads = turns.where("pos <= 5").select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "digest", "chars")
    ids = lengths.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), h.alias("h"))
    first = ids.join(heads, "base").where("depth <= h").select("conv_id", "depth", "digest", "chars")  # at most 100 ids to a base
    own = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", h).where("pos > h").join(base, "base", "left")
    own = own.select("conv_id", (F.least("h", F.coalesce("n_base", F.lit(0))) + F.col("pos") - F.col("h")).alias("depth"), "digest", "chars")
    return _roots(lengths).union(first).union(own)


def _roots(ids: DataFrame) -> DataFrame:
    return ids.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("chars"))


def _with_keys(rows: DataFrame) -> DataFrame:
    """conv_id, depth, key, parent_key, chars."""
    bound = rows.withColumn("bound", F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), "digest").cast("binary")))
    along = Window.partitionBy("conv_id").orderBy("depth")
    sums = [F.sum(F.conv(F.substring("bound", 8 * i + 1, 8), 16, 10).cast("long")).over(along.rowsBetween(Window.unboundedPreceding, 0)).cast("string") for i in range(4)]
    key = F.unhex(F.md5(F.concat_ws(",", F.col("depth").cast("string"), *sums).cast("binary")))
    keyed = bound.select("conv_id", "depth", F.when(F.col("depth") == 0, F.lit(ROOT)).otherwise(key).alias("key"), "chars")
    return keyed.select("conv_id", "depth", "key", F.lag("key").over(along).alias("parent_key"), "chars")


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key from its pieces, which come in order."""
    key, now = None, None
    done: list[tuple] = []

    def taken() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [[]] * 5
        done.clear()
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["key", "length", "n_ended", "conv_id", "ends_sha256"])

    for batch in batches:
        for k, length, n, least, piece in zip(*(batch.column(c).to_pylist() for c in ("key", "length", "n", "least", "piece")), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, now[1], now[2], now[3], now[0].hexdigest()))
                key, now = k, [hashlib.sha256(piece.encode()), length, n, least]
            else:
                now[0].update(b"," + piece.encode())
                now[2] += n
        yield taken()
    if key is not None:
        done.append((key, now[1], now[2], now[3], now[0].hexdigest()))
        yield taken()


def _classes(paths: DataFrame) -> DataFrame:
    """One row for each distinct conversation: its key, length, number of copies,
    smallest id, and the hash of their ids."""
    ends = paths.groupBy("conv_id").agg(F.max(F.struct("depth", "key")).alias("end")).select("conv_id", F.col("end.depth").alias("length"), F.col("end.key").alias("key"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("key", "length", F.shiftright("conv_id", 9).alias("part")).agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), ids.alias("piece"))  # 512 ids at most
    dealt = pieces.repartition("key").sortWithinPartitions("key", "part").select("key", "length", "n", "least", "piece")
    return dealt.mapInArrow(_hash_ends, "key binary, length long, n_ended long, conv_id long, ends_sha256 string")


def peel(rows: pd.DataFrame, top: int) -> pd.DataFrame:
    """All nodes deeper than ``top``, from the paths of distinct conversations:
    conv_id, depth (top + 1, top + 2, ...), key, parent_key, chars; n_ended and
    ends_sha256 where the conversation ends."""
    rows = rows.sort_values(["conv_id", "depth"], ignore_index=True)
    code = pd.factorize(rows["key"])[0]
    depth, conv, chars = (rows[c].to_numpy() for c in ("depth", "conv_id", "chars"))
    ended, count = rows["n_ended"].notna().to_numpy(), rows["n_ended"].fillna(0).to_numpy(np.int64)
    by_depth = np.flatnonzero(ended)[np.argsort(depth[ended], kind="stable")]
    none = np.zeros(0, np.int64)
    found: list[dict] = []
    at, n, least, leaves, saved = none, none, none, none, none  # of the survivors: a row, and sums
    for d in range(int(depth.max()), top, -1):
        fresh = by_depth[np.searchsorted(depth[by_depth], d) : np.searchsorted(depth[by_depth], d, side="right")]
        stripped = at - 1  # the same conversations, a turn shorter
        both = np.concatenate([stripped, fresh])
        _, first, group = np.unique(code[both], return_index=True, return_inverse=True)
        size, kids = len(first), len(stripped)

        def total(mine, theirs, group=group, size=size):
            return np.bincount(group, weights=np.concatenate([mine, theirs]), minlength=size).astype(np.int64)

        convs = np.full(size, np.iinfo(np.int64).max)
        np.minimum.at(convs, group, np.concatenate([least, conv[fresh]]))
        if kids:
            found[-1]["parent_conv_id"] = convs[group[:kids]]
        children = np.bincount(group[:kids], minlength=size)
        end_row = np.full(size, -1)
        end_row[group[kids:]] = fresh
        n, saved = total(n, count[fresh]), total(saved, np.zeros(len(fresh)))
        leaves = np.where(children == 0, 1, total(leaves, np.zeros(len(fresh))))
        at, least = both[first], convs
        saved = saved + (n - 1) * chars[at]
        found.append({"row": at, "depth": np.full(size, d), "conv_id": convs, "n_convs": n, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "end_row": end_row})
    found[-1]["parent_conv_id"] = np.full(len(at), -1)
    out = pd.DataFrame({c: np.concatenate([f[c] for f in found]) for c in found[-1]})
    out["key"], out["parent_key"] = rows["key"].to_numpy()[out["row"]], rows["parent_key"].to_numpy()[out["row"]]
    out["ends_sha256"] = np.where(out["end_row"] >= 0, rows["ends_sha256"].to_numpy()[out["end_row"]], NO_ENDS)
    out["parent_conv_id"] = out["parent_conv_id"].where(out["depth"] > top + 1).astype("Int64")
    return out


def _together(tables: list[DataFrame]) -> DataFrame:
    """Staged tables of one schema, read as one."""
    folders = {os.path.dirname(f) for t in tables for f in t.inputFiles()}
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*sorted(folders))


def prefix_trie(rows: DataFrame, most: int = MOST) -> DataFrame:
    """``rows``: conv_id, depth, digest, chars, with a row of depth 0 for every
    conversation.  Returns one row per node."""
    spark = rows.sparkSession
    ship(spark)
    paths = stage(_with_keys(rows), "trie-keys")
    classes = stage(_classes(paths), "trie-classes")
    own = classes.select("conv_id", "length", "n_ended", "ends_sha256")
    ends = F.col("depth") == F.col("length")
    paths_of = paths.join(own, "conv_id").select("conv_id", "depth", "key", "parent_key", "chars", "length", F.when(ends, F.col("n_ended")).alias("n_ended"), F.when(ends, F.col("ends_sha256")).alias("ends_sha256"))
    peeled = stage(paths_of, "trie-paths")
    drop_staged(paths, classes)
    under = peeled.groupBy("depth", "key").agg(F.sum(F.col("length") - F.col("depth")).alias("under"))
    top = under.groupBy("depth").agg(F.max("under").alias("under")).where(F.col("under") <= most).agg(F.min("depth")).first()[0]
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if top is None:
        return spark.createDataFrame([], NODE).select(*columns)
    deep = peeled.where(F.col("depth") > top)
    buckets = max(1, deep.count() // max(1, most))
    head = peeled.where(F.col("depth") == top).select("conv_id", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    names = [f.split(" ")[0] for f in NODE.split(", ")]
    nodes = [stage(deep.drop("length").join(head, "conv_id").groupBy("bucket").applyInPandas(lambda pdf: peel(pdf, top)[names], NODE), "trie-deep")]
    alive = nodes[0].where(F.col("depth") == top + 1)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    for d in range(top, -1, -1):
        level = peeled.where(F.col("depth") == d)
        stripped = alive.select(F.col("parent_key").alias("key"), "conv_id", "n_convs", one.alias("child"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends"))
        fresh = level.where("n_ended is not null").select("key", "conv_id", F.col("n_ended").alias("n_convs"), zero.alias("child"), zero.alias("n_leaves"), zero.alias("saved_tokens"), F.col("ends_sha256").alias("ends"))
        met = stripped.union(fresh).groupBy("key").agg(*[f(c).alias(c) for f, c in ((F.min, "conv_id"), (F.sum, "n_convs"), (F.sum, "child"), (F.sum, "n_leaves"), (F.sum, "saved_tokens"), (F.max, "ends"))])
        met = met.join(level.select("conv_id", "parent_key", "chars"), "conv_id")  # the turn on top, from the one conversation that names the node
        node = met.select(
            "key", "parent_key", F.lit(d).cast("long").alias("depth"), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.col("child").alias("n_children"), F.greatest("n_leaves", one).alias("n_leaves"),
            (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
        nodes.append(stage(node, "trie-level"))
        alive = nodes[-1]
    every = _together(nodes)
    high = every.where(F.col("depth") <= top + 1).drop("parent_conv_id")
    parents = every.where(F.col("depth") <= top).select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return every.where(F.col("depth") > top + 1).select(*columns).union(high.join(parents, "parent_key", "left").select(*columns))


def trie_of(conversations: DataFrame, most: int = MOST) -> DataFrame:
    """The trie of the conversations as they are."""
    turns = digested(conversations)
    rows = turns.select("conv_id", F.col("pos").alias("depth"), "digest", "chars")
    return prefix_trie(_roots(turns.select("conv_id").distinct()).union(rows), most)


def trie_of_rebuilt(conversations: DataFrame, most: int = MOST) -> DataFrame:
    """The trie after heads are shared within each hundred ids."""
    return prefix_trie(rebuilt(stage(digested(conversations), "trie-turns")), most)
