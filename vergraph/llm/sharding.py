"""Operator 8: longest-processing-time sharding.

Documents with equal texts form a group that must stay together.  Groups go,
largest first, to the shard with the least bytes so far, taken from a heap.
The schedule needs only how many groups there are of each load: a run of equal
loads is dealt to the heap's shards in one step, and then group number i of the
run, in the order of their digests, gets the shard that the i-th place of the
run went to.  Runs come to the driver in order of their loads, one part
of a sorted table after another, and what they were dealt goes back as files, so
that it holds ``CHUNK`` runs and the loads of the shards, whatever the number of
different loads; no group is dealt by anything but its size.

Groups with at least 1/``grain`` of a shard's fair share, of which there are at
most shards * grain, are joined by broadcast, so that no task gets all rows of
one; all others meet their rows by a shuffle.

Nulls and empties: a null text counts as the empty text (size 1, crc32 0, one
group).  Repeated rows (same doc_id twice) are kept; each takes a slot, in an
order among them that is not specified.  Very long texts count by their bytes.
An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import drop_staged, new_folder, running_start, stage

GRAIN = 512
#: Different loads that the driver holds at once.
CHUNK = 100_000


def deal_run(loads: list[int], load: int, n: int) -> list[int]:
    """How many of ``n`` groups of one load each shard gets when they go, one
    after another, to the shard with the least so far (the first of equals);
    ``loads`` is brought up to date."""
    shards = len(loads)
    got = [0] * shards
    if n > 4 * shards:  # most of them at once, to one group under the level that all can reach
        low = list(range(shards))
        while True:
            level = (sum(loads[s] for s in low) + load * n) // len(low)
            if all(loads[s] < level for s in low):
                break
            low = [s for s in low if loads[s] < level]
        for s in low:
            got[s] = max(0, (level - loads[s]) // load - 1)
    heap = [(loads[s] + got[s] * load, s) for s in range(shards)]
    heapq.heapify(heap)
    for _ in range(n - sum(got)):
        least, s = heapq.heappop(heap)
        got[s] += 1
        heapq.heappush(heap, (least + load, s))
    for s in range(shards):
        loads[s] += got[s] * load
    return got


def schedule(runs: Iterable[tuple[int, int]], loads: list[int]) -> Iterator[tuple[int, list[int]]]:
    """For each (load, number of groups), which come largest load first: how many
    go to each shard.  ``loads`` is brought up to date."""
    for load, n in runs:
        yield load, deal_run(loads, load, n)


def _dealt(groups: DataFrame, shards: int) -> DataFrame:
    """load, ends: of the groups of a load, those from 0 to ends[0] go to shard 0,
    from there to ends[1] to shard 1, and so on."""
    spark = groups.sparkSession
    runs = stage(groups.groupBy("load").agg(F.count("*").alias("n")), "shard-runs")
    folder, kind = new_folder(spark, "shard-ends"), "load long, ends array<long>"
    plan = schedule(((r["load"], r["n"]) for r in runs.orderBy(F.desc("load")).toLocalIterator()), [0] * shards)
    while chunk := list(islice(plan, CHUNK)):
        ends = np.cumsum([got for _, got in chunk], axis=1)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(chunk) + 1) * shards, pa.int32()), pa.array(ends.ravel()))
        spark.createDataFrame(pa.table({"load": pa.array([load for load, _ in chunk], pa.int64()), "ends": flat}), kind).write.mode("append").parquet(folder)
    drop_staged(runs)
    return spark.read.schema(kind).parquet(folder)


def shard_by_load(docs: DataFrame, shards: int = 8, grain: int = GRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    group = F.substring(F.unhex(F.sha2(text, 256)), 1, 16)
    rows = stage(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), group.alias("group")), "shard-rows")
    groups = stage(rows.groupBy("group").agg(F.sum("size").alias("load")), "shard-groups")
    total = groups.agg(F.sum("load")).first()[0]
    empty = "doc_id {}, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"
    if total is None:
        return spark.createDataFrame([], empty.format(rows.schema["doc_id"].dataType.simpleString()))
    bounds = _dealt(groups, shards)
    ranked = running_start(groups, ["load"], ["group"], F.lit(1), "place", "shard-ranks")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("place"))).cast("int")
    placed = stage(ranked.join(bounds, "load").select("group", "load", shard.alias("shard")), "shard-placed")
    floor = max(1, total // (shards * grain))
    large, small = placed.where(F.col("load") >= floor).select("group", "shard"), placed.where(F.col("load") < floor).select("group", "shard")
    marked = rows.join(F.broadcast(large.withColumnRenamed("shard", "large")), "group", "left")  # at most shards * grain rows
    out = marked.where("large is not null").select("doc_id", "size", "text_crc32", F.col("large").alias("shard"))
    out = out.union(marked.where("large is null").join(small.hint("merge"), "group").select("doc_id", "size", "text_crc32", "shard"))
    out = running_start(stage(out, "shard-dealt"), ["shard"], ["doc_id"], F.lit(1), "slot", "shard-slots")
    drop_staged(ranked, rows, groups, placed, bounds)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
