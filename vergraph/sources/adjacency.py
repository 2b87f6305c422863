"""Edges kept as two bucketed, sorted tables: by source and by target.

They are written once for a graph, in the folder that driver and executors
share, and stay for all later calls; a table found there is only registered
again.  A step from a few ids names them in its filter: Spark reads their buckets
only, and of these the pages that may hold them, as rows are sorted.  A step
from many ids is a join on the bucketed side, which is not shuffled.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vergraph.plans.graph import Adjacency, Graph, shared_place

#: Edges to a bucket, about; small graphs have at least so many buckets.
BUCKET_EDGES, LEAST_BUCKETS = 2_000_000, 8
COLUMNS = "src string, dst string, relationship_type string, rel string, known boolean"


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the names, lengths and times of all files under the paths."""
    jvm, conf, seen = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in sorted(paths):
        at = jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(conf).listFiles(at, True)
        while files.hasNext():
            f = files.next()
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.md5(repr(sorted(seen)).encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _register(spark: SparkSession, name: str, folder: str, side: str, buckets: int) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}) USING parquet CLUSTERED BY ({side}) SORTED BY ({side}) INTO {buckets} BUCKETS LOCATION '{folder}'")


def stored(graph: Graph, key: str) -> Adjacency:
    """The adjacency of a graph that ``key`` stands for, made if it is not there.
    ``known`` tells whether both ends of an edge are nodes."""
    spark = graph.entities.sparkSession
    names = {side: f"vergraph_by_{side}_{key}" for side in ("src", "dst")}
    if all(spark.catalog.tableExists(n) for n in names.values()):
        return Adjacency(spark, names["src"], names["dst"])
    root = f"{shared_place(spark)}/vergraph/adjacency-{key}"
    if not all(_exists(spark, f"{root}/{side}/_SUCCESS") for side in names):
        edges, nodes = graph.edges(), graph.nodes()
        for side in ("src", "dst"):
            edges = edges.join(nodes.select(F.col("id").alias(side), F.lit(True).alias(f"has_{side}")), side, "left")
        known = F.coalesce(F.col("has_src") & F.col("has_dst"), F.lit(False))
        edges = edges.select("src", "dst", "relationship_type", "rel", known.alias("known")).persist()
        buckets = max(LEAST_BUCKETS, -(-edges.count() // BUCKET_EDGES))
        for side in names:
            temporary = f"vergraph_new_{side}_{key}"
            edges.repartition(buckets, side).write.mode("overwrite").bucketBy(buckets, side).sortBy(side).option("path", f"{root}/{side}").saveAsTable(temporary)
            spark.sql(f"DROP TABLE {temporary}")  # the files stay
        edges.unpersist()
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{root}/buckets")
    buckets = spark.read.parquet(f"{root}/buckets").first()["buckets"]
    for side, name in names.items():
        _register(spark, name, f"{root}/{side}", side, buckets)
    return Adjacency(spark, names["src"], names["dst"])
