"""Snapshots, backups and JSON files of a store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vergraph.plans.graph import shared_place


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the place that driver and executors share."""
    return f"{shared_place(spark)}/vergraph/{name}-{uuid.uuid4().hex}"


def write_snapshot(rows: DataFrame, folder: str) -> str:
    """Rows as Parquet by entity type; the committer makes the write atomic (SNK1, SNK2)."""
    rows.write.mode("overwrite").partitionBy("entity_type").parquet(folder)
    return folder


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def write_json(rows: DataFrame, folder: str) -> str:
    """Rows as JSON lines (SNK10: an append-only log when mode is append)."""
    rows.write.mode("append").json(folder)
    return folder


def read_replica(spark: SparkSession, path: str) -> DataFrame:
    """A replica's entity file, one JSON object of id -> [versions], as version
    rows in stored order (SRC3)."""
    whole = spark.read.text(path, wholetext=True)
    kind = "map<string,array<struct<id: string, version: string, entity_type: string, name: string, content: variant, created_at: string>>>"
    rows = whole.select(F.explode(F.from_json("value", kind)).alias("id", "versions")).select(F.posexplode("versions").alias("arrival", "v"))
    return rows.select("v.id", "v.version", "v.entity_type", "v.name", F.to_json("v.content").alias("content"), "v.created_at", "arrival")


def content_checksum(rows: DataFrame) -> DataFrame:
    """n_rows, checksum: an order-free checksum of all rows, for backups of any size."""
    whole = F.xxhash64(*[F.col(c) for c in sorted(rows.columns)])
    return rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(whole.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"))


def backup(rows: DataFrame, folder: str, description: str = "") -> str:
    """A copy of the rows with a metadata file beside it (SNK8)."""
    rows.write.mode("overwrite").parquet(f"{folder}/data")
    copied = rows.sparkSession.read.parquet(f"{folder}/data")
    content_checksum(copied).withColumn("description", F.lit(description)).withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(f"{folder}/metadata")
    return folder


def inspect_backup(spark: SparkSession, folder: str) -> DataFrame:
    """The metadata, and whether the data still has that checksum (SRC6)."""
    said = spark.read.schema("n_rows long, checksum string, description string, created_at timestamp").json(f"{folder}/metadata")
    now = content_checksum(spark.read.parquet(f"{folder}/data")).select(F.col("checksum").alias("now"))
    return said.crossJoin(now).withColumn("intact", F.col("checksum") == F.col("now")).drop("now")  # single rows


def restore(spark: SparkSession, folder: str) -> DataFrame:
    """The backed-up rows; raises if they are damaged (SRC6)."""
    if not inspect_backup(spark, folder).first()["intact"]:
        raise ValueError(f"backup {folder} is damaged")
    return spark.read.parquet(f"{folder}/data")


def changed_since_backup(rows: DataFrame, folder: str) -> bool:
    """Whether a new backup would differ (SNK9)."""
    said = rows.sparkSession.read.schema("n_rows long, checksum string").json(f"{folder}/metadata").first()
    now = content_checksum(rows).first()
    return (said["n_rows"], said["checksum"]) != (now["n_rows"], now["checksum"])


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def backup_names(spark: SparkSession, root: str) -> list[str]:
    """Names of the backups under a root, oldest (smallest) first: a folder listing."""
    fs, at = _folder(spark, root)
    return sorted(f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()) if fs.exists(at) else []


def list_backups(spark: SparkSession, root: str) -> DataFrame:
    """name, n_rows, checksum, description of every backup under a root, from the metadata files (SRC6)."""
    names = backup_names(spark, root)
    kind = "n_rows long, checksum string, description string"
    if not names:
        return spark.createDataFrame([], f"name string, {kind}")
    said = spark.read.schema(kind).json([f"{root}/{n}/metadata" for n in names])
    return said.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3).alias("name"), "n_rows", "checksum", "description")


def delete_backup(spark: SparkSession, root: str, name: str) -> bool:
    """Whether there was one to delete (SRC6)."""
    fs, at = _folder(spark, f"{root}/{name}")
    return fs.delete(at, True)


def mirrored_backup(rows: DataFrame, root: str, mirror: str, name: str, keep: int) -> bool:
    """A new backup, if the rows changed since the newest one, with a copy at the
    mirror; of both places only the ``keep`` newest stay (SNK9).  Says whether
    there was anything new."""
    spark = rows.sparkSession
    before = backup_names(spark, root)
    if before and not changed_since_backup(rows, f"{root}/{before[-1]}"):
        return False
    backup(rows, f"{root}/{name}", name)
    backup(restore(spark, f"{root}/{name}"), f"{mirror}/{name}", name)
    for place in (root, mirror):
        for old in backup_names(spark, place)[:-keep]:
            delete_backup(spark, place, old)
    return True


def write_replica(rows: DataFrame, folder: str, files: int) -> str:
    """Version rows (with ``arrival``) as replica files: each one JSON object of
    id -> [versions] in stored order, a part of the ids (SRC3)."""
    version = F.struct("arrival", "id", "version", "entity_type", "name", F.parse_json("content").alias("content"), F.col("created_at").cast("string").alias("created_at"))
    own = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("arrival", F.to_json(version).alias("json")))).alias("v"))
    entry = F.concat(F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2), F.lit(":["), F.array_join(F.transform("v", lambda x: x["json"]), ","), F.lit("]"))
    parts = own.select(F.pmod(F.xxhash64("id"), F.lit(files)).alias("file"), entry.alias("entry")).groupBy("file").agg(F.collect_list("entry").alias("e"))
    parts.select("file", F.concat(F.lit("{"), F.array_join("e", ","), F.lit("}")).alias("value")).repartition(files, "file").write.partitionBy("file").mode("overwrite").text(folder)
    return folder
