"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_shipped: set[str] = set()
#: Frees the shuffle files of a job when the job ends; what it made is in its staged table.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scope:
    """The tables staged while it is entered: ``release`` deletes these and no others."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> Scope:
        self._before = _scope.set(self)
        return self

    def __exit__(self, *_) -> None:
        _scope.reset(self._before)

    def release(self, spark: SparkSession, using: DataFrame | None = None) -> None:
        """Call when what was made of them is written; those that ``using`` still reads stay."""
        files = using.inputFiles() if using is not None else []
        for path in list(self.paths):
            if not any(path.rsplit("/", 1)[-1] in f for f in files):
                self.paths.remove(path)
                delete(spark, path)


_scope: ContextVar[Scope] = ContextVar("scope", default=Scope())


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset on one machine, as in tests, a new local folder."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="vergraph-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver runs."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    package = os.path.basename(root)
    path = os.path.join(tempfile.mkdtemp(prefix="vergraph-zip-"), f"{package}_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for base, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    z.write(full, os.path.join(package, os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


@contextmanager
def freeing_shuffles(spark: SparkSession):
    """Jobs in here free their shuffle files when they end."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a staged table that is still to be written."""
    path = f"{shared_dir(spark)}/vergraph/{name}-{uuid.uuid4().hex}"
    _scope.get().paths.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and go on from the files: lineage ends here,
    and a lost executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with freeing_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_ids(df: DataFrame, out: str, name: str) -> DataFrame:
    """Adds ``out``, a number of each row's own, written once so that every scan sees the same."""
    return stage(df.withColumn(out, F.monotonically_increasing_id()), name)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that is no column of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    paths = _scope.get().paths
    for df in tables:
        for f in df.inputFiles()[:1]:
            for path in [p for p in paths if p.rsplit("/", 1)[-1] in f]:
                paths.remove(path)
                delete(df.sparkSession, path)


def running_start(df: DataFrame, group: list[str], order: list[str], value: Column, out: str, name: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same group with a
    smaller ``order``.  Rows are dealt by range, summed by part, and a part's
    start comes from the sums of the parts before it: no task sees a whole group."""
    keyed = df.withColumn("_value", value.cast("long"))
    dealt = keyed.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
    dealt = stage(dealt, name)
    parts = dealt.groupBy(*group, "_part").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*group, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return rows.join(parts, [*group, "_part"]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_before", "_inside", "_part", "_value")
