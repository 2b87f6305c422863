"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet and reads it back as the next one's ``docs``.  All but the last
return the columns of ``documents`` (and any others that came with them, whatever
their names); where a stage shortens texts, n_chars follows.  A classifier
trained on the labels, a similarity graph and suffix arrays are beyond SQL, so
there is no ORACLE_SQL; tests check ``run`` against brute force.

In all stages a null text is the empty text, empty tables give empty results,
and texts of any length are read whole.

``run`` deletes what a stage staged, and the folder of the stage before it, once
the stage's result is written; runs share nothing.  A stage that is called alone
deletes nothing, as its result still reads what it staged: call it within a
``workspace.Scope`` and release that when the result is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vergraph.llm import decontaminate, minhash, packing, quality, repeats, workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the top grade is at least one half.  Every row is
    judged by its own text, repeated rows and null ids included; without usable
    labels all stay."""
    return quality.select_texts(docs, quality.grades_of(table(spark, sf_dir, "labels")))


#: The stage's own threshold; that of op4_minhash is its query's contract.
NEAR_PERCENT = 80


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of every group of near-duplicates; of
    repeated rows one stays.  Rows without an id, or without words, are groups of
    their own."""
    row = workspace.unused(docs, "row")
    rows = workspace.with_row_ids(docs, row, "pipeline-rows")
    kept = minhash.near_duplicates(rows, percent=NEAR_PERCENT, row_col=row).where("kept").select(row)
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that occur again; rows stay,
    with the empty text if nothing is left.  A null text comes back empty."""
    found = repeats.find_repeats(docs, carry=tuple(c for c in docs.columns if c not in ("doc_id", "text")))
    left = repeats.without_repeats(found).select("doc_id", "text", "carried.*")
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark; every row by its own text."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, mixed by source; null sources are one."""
    return packing.pack(docs)


STAGES = [
    ("quality", select_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the packed pieces."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{workspace.shared_dir(spark)}/vergraph/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with workspace.Scope() as own:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            own.release(spark)
        if before:
            workspace.delete(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return docs
