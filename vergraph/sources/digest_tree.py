"""A tree of digests over ranges of hashed ids, and stores that are compared by it.

An id lies where the hexadecimal digits of its MD5 say: a node of the tree is a
prefix of them.  A node's digest is the number of its rows and four sums of
32-bit parts of their own digests (id and version), so that a node is the sum of
its children, and a batch of changes is taken in by adding what is new and
subtracting what it replaces, without reading anything else.

Two trees are descended together: a level is compared only below the prefixes
that differ on the level above.  Rows are kept in folders by the first digits, so
that finding the ids that differ reads only the ranges in which there are any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vergraph.plans.graph import cut, small

#: Digits of a leaf, and of the folders that rows are kept in.
DEPTH, PART = 4, 2
SUMS = ("s0", "s1", "s2", "s3")


def _digits(n: int) -> Column:
    return F.substring(F.md5(F.coalesce("id", F.lit("")).cast("binary")), 1, n)


def _signed(rows: DataFrame, sign: int) -> DataFrame:
    own = F.md5(F.concat_ws("\x1f", F.coalesce("id", F.lit("")), F.coalesce("version", F.lit(""))).cast("binary"))
    lanes = [(F.conv(F.substring(own, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)") * sign).alias(s) for i, s in enumerate(SUMS)]
    return rows.select(_digits(DEPTH).alias("prefix"), F.lit(sign).cast("long").alias("n"), *lanes)


def _summed(leaves: DataFrame) -> DataFrame:
    """prefix, n, s0 to s3 of all levels: the root's prefix is empty."""
    every = leaves.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(0), F.lit(DEPTH)), lambda k: F.col("prefix").substr(F.lit(1), k))))
    sums = [F.sum(c).cast("decimal(38,0)").alias(c) for c in SUMS]
    return every.groupBy("prefix").agg(F.sum("n").alias("n"), *sums).where(" or ".join(f"{c} <> 0" for c in ("n", *SUMS)))


def tree(rows: DataFrame) -> DataFrame:
    """The tree of current rows (id, version)."""
    return _summed(_signed(rows, 1))


def kept_up(old: DataFrame, changes: DataFrame) -> DataFrame:
    """The tree after a batch: ``changes`` has id, old_version and new_version,
    null where there was or is no row."""
    gone = changes.where("old_version is not null").select("id", F.col("old_version").alias("version"))
    new = changes.where("new_version is not null").select("id", F.col("new_version").alias("version"))
    return _summed(old.where(F.length("prefix") == DEPTH).unionByName(_signed(gone, -1)).unionByName(_signed(new, 1)))


def descended(a: DataFrame, b: DataFrame, depth: int = DEPTH) -> DataFrame:
    """prefix of the nodes of a level that differ: level by level, under those
    that differ above."""
    wrong: DataFrame | None = None
    for level in range(depth + 1):
        x, y = (t.where(F.length("prefix") == level).select("prefix", F.struct("n", *SUMS).alias(name)) for t, name in ((a, "x"), (b, "y")))
        if wrong is not None:
            x, y = (t.join(wrong.withColumnRenamed("prefix", "above"), F.substring("prefix", 1, level - 1) == F.col("above"), "left_semi") for t in (x, y))
        wrong = cut(x.join(y, "prefix", "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("prefix"))
        if wrong.isEmpty():
            break
    return wrong


class KeptRows:
    """Current rows under a folder, by range, with their tree."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def write(self, rows: DataFrame) -> KeptRows:
        rows.withColumn("part", _digits(PART)).repartition("part").write.partitionBy("part").mode("overwrite").parquet(f"{self.folder}/rows")
        tree(rows).write.mode("overwrite").parquet(f"{self.folder}/tree")
        return self

    def tree(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/tree")

    def rows(self, parts: list[str] | None = None) -> DataFrame:
        """All rows, or those of some ranges, of which only the folders are read."""
        kept = self.spark.read.option("basePath", f"{self.folder}/rows").schema("id string, version string, part string").parquet(f"{self.folder}/rows")
        return kept if parts is None else kept.where(F.col("part").isin(parts))


def differing(a: KeptRows, b: KeptRows) -> DataFrame:
    """id, version_a, version_b of the ids that are not the same in both stores
    (SYN16: drift, and what to repair)."""
    wrong = descended(a.tree(), b.tree())
    parts = sorted(r["part"] for r in wrong.select(F.substring("prefix", 1, PART).alias("part")).distinct().collect())  # 256 at most
    n = wrong.count()
    x, y = (s.rows(parts).join(small(wrong, n), _digits(DEPTH) == F.col("prefix"), "left_semi").select("id", F.col("version").alias(f"version_{name}")) for s, name in ((a, "a"), (b, "b")))
    return x.join(y, "id", "full").where(~F.col("version_a").eqNullSafe(F.col("version_b"))).select("id", "version_a", "version_b")
