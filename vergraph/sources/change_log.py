"""The change feed as a log cut by sequence numbers.

Appended rows lie in folders of ``BLOCK`` sequence numbers each.  A version that
is replaced stays where it is; its number goes to a list of the same block.  A
page reads the blocks from its cursor on, each once, some at a time, until it is
full: folders of other blocks are not listed, neither all versions nor what was replaced elsewhere is looked at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sequence numbers of a folder; blocks that are read at once by name.
BLOCK, MOST_LISTED = 10_000, 4_096


class ChangeLog:
    """Numbered version rows under a folder (SYN10, SYN11, FLT16).  ``columns``:
    names and types of the rows, with id, version and server_seq."""

    def __init__(self, spark: SparkSession, folder: str, columns: str, block: int = BLOCK):
        self.spark, self.folder, self.columns, self.block = spark, folder, columns, block

    def append(self, rows: DataFrame, replaced: DataFrame | None = None) -> None:
        """Numbered rows, the newest version of an id among them; ``replaced`` has
        the server_seq of the rows of earlier batches that were current before."""
        number = uuid.uuid4().hex[:8]
        block = F.floor(F.col("server_seq") / self.block).alias("block")
        last = rows.groupBy("id").agg(F.max("server_seq").alias("_last"))
        older = rows.join(last, "id").where("server_seq < _last").select("server_seq")
        older = older if replaced is None else older.union(replaced.select("server_seq"))
        # what is replaced is listed before the rows that replace it can be seen
        older.select("server_seq", block).repartition("block").write.mode("append").partitionBy("block").parquet(f"{self.folder}/replaced-{number}")
        rows.withColumn("block", block).repartition("block").write.mode("append").partitionBy("block").parquet(f"{self.folder}/rows-{number}")

    def _read(self, kind: str, schema: str, low: int, high: int) -> DataFrame:
        """The folders of a kind for blocks low to high - 1; if these are few, no others are listed."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        at = path(f"{self.folder}/{kind}-*")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = [f.getPath().toString() for f in fs.globStatus(at) or [] if fs.exists(path(f.getPath().toString() + "/_SUCCESS"))]
        every = []
        for p in sorted(done):
            reader = self.spark.read.schema(f"{schema}, block long")
            if high - low > MOST_LISTED:
                every.append(reader.parquet(p).where((F.col("block") >= low) & (F.col("block") < high)))
                continue
            own = [f"{p}/block={b}" for b in range(low, high)]
            own = [b for b in own if fs.exists(path(b))]
            if own:
                every.append(reader.option("basePath", p).parquet(*own))
        out = self.spark.createDataFrame([], f"{schema}, block long") if not every else every[0]
        for e in every[1:]:
            out = out.union(e)
        return out.drop("block")

    def blocks(self, low: int, high: int) -> DataFrame:
        """Current rows of blocks low to high - 1."""
        gone = self._read("replaced", "server_seq long", low, high)
        return self._read("rows", self.columns, low, high).join(gone, "server_seq", "left_anti")

    def top(self) -> int:
        """The last block that there is (from the folders' names only)."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/rows-*/block=*")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
        return max((int(f.getPath().getName().partition("=")[2]) for f in found), default=-1)

    def page(self, cursor: int, size: int = 500) -> DataFrame:
        """The next ``size`` current rows after the cursor, in order of server_seq."""
        low, top, wide, found = (cursor + 1) // self.block, self.top(), 1, []
        schema = self.blocks(0, 0).schema
        while True:
            page = self.blocks(low, low + wide).where(F.col("server_seq") > cursor).orderBy("server_seq").limit(size - len(found))
            found += page.collect()  # at most ``size`` rows in all
            low += wide
            if low > top or len(found) >= size:
                return self.spark.createDataFrame(found, schema).orderBy("server_seq")
            wide = min(wide * 2, MOST_LISTED)
