"""Reads, writes and projections of version tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vergraph.functions.values import is_tombstoned, merged_content, version_text


def by_id(rows: DataFrame, id_: str, version: str | None = None) -> DataFrame:
    """Latest row of an id, or one exact version of it (FLT1, FLT2)."""
    own = rows.where(F.col("id") == id_)
    return own.where("is_latest") if version is None else own.where(F.col("version") == version)


def latest_by(rows: DataFrame, *order: Column, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """The row of each id that comes last in the given order.  By created_at:
    FLT3; by arrival: FLT4; by version string: FLT5."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_latest_flag(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds is_latest as derived from the order (a wide window; no join)."""
    w = Window.partitionBy("id").orderBy(*[o.desc() for o in order])
    return rows.withColumn("is_latest", F.row_number().over(w) == 1)


def of_type(rows: DataFrame, entity_type: str, ranked_inside: bool = False) -> DataFrame:
    """Latest rows of a type (FLT6); ``ranked_inside``: latest among the rows
    that have the type, whatever came later (FLT7)."""
    if ranked_inside:
        return latest_by(rows.where(F.col("entity_type") == entity_type), F.col("created_at"), F.col("version"))
    return rows.where("is_latest").where(F.col("entity_type") == entity_type)


def history(rows: DataFrame, id_: str) -> DataFrame:
    """All versions of an id, oldest first (FLT9)."""
    return rows.where(F.col("id") == id_).orderBy("created_at", "version")


def name_contains(rows: DataFrame, pattern: str, wildcards: bool = True) -> DataFrame:
    """Case-blind containment; with wildcards % and _ keep their meaning (FLT12, FLT14)."""
    if wildcards:
        return rows.where(F.col("name").ilike(f"%{pattern}%"))
    return rows.where(F.contains(F.lower("name"), F.lit(pattern.lower())))


def name_is(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.lower("name") == name.lower())


def changed_since(rows: DataFrame, cursor: int | None = None, since: Column | None = None) -> DataFrame:
    """Rows after a sequence number, or else after a moment (FLT16, FLT17)."""
    if cursor is not None:
        return rows.where(F.col("server_seq") > cursor)
    return rows if since is None else rows.where(F.col("updated_at") > since)


def filtered(rows: DataFrame, entity_types: list[str] | None = None, modified_by: list[str] | None = None) -> DataFrame:
    """Sync filters (FLT13, FLT18)."""
    if entity_types:
        rows = rows.where(F.col("entity_type").isin(*entity_types))
    return rows.where(F.col("user_id").isin(*modified_by)) if modified_by else rows


def page(rows: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page in a total order (LIM1, LIM2)."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def as_change(rows: DataFrame) -> DataFrame:
    """Wire form of current rows; a tombstone is a delete (PRJ4, SYN11)."""
    return rows.select("id", "version", "entity_type", "name", "content", "user_id", F.when(is_tombstoned(F.col("content")), "delete").otherwise("update").alias("change_type"))


def new_version(rows: DataFrame, user: str, now: Column, counter: Column, changes: Column) -> DataFrame:
    """Next versions of rows: content merged at the top level, the old version as parent (PRJ9, TOL12)."""
    parents = F.array_append(F.coalesce("parent_versions", F.array().cast("array<string>")), F.col("version"))
    return rows.withColumn("parent_versions", parents).withColumn("content", merged_content(F.col("content"), changes)).withColumn("version", version_text(now, counter, F.lit(user))).withColumn("user_id", F.lit(user))


def append_versions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows and those new (id, version) pairs that are not there yet; the
    newcomers of an id, in arrival order (``pos``), take over as latest and get the
    next sequence numbers, by range parts (SNK2, SYN5, AGG5)."""
    from vergraph.plans.graph import cut

    keys = ["id", "version"]
    first = Window.partitionBy(*keys).orderBy("pos")
    fresh = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").join(stored.select(*keys), keys, "left_anti")
    last = Window.partitionBy("id").orderBy(F.desc("pos"))
    top = stored.agg(F.coalesce(F.max("server_seq"), F.lit(0)).alias("_top"))
    fresh = cut(fresh.withColumn("is_latest", F.row_number().over(last) == 1))
    fresh = numbered(fresh, ["pos", "id", "version"], "server_seq", fresh.count())
    fresh = fresh.crossJoin(top).withColumn("server_seq", F.col("server_seq") + F.col("_top")).drop("_top")  # one row
    touched = fresh.select("id").distinct().withColumn("_new", F.lit(True))
    kept = stored.join(touched, "id", "left").withColumn("is_latest", F.col("is_latest") & F.col("_new").isNull()).drop("_new")
    return kept.unionByName(fresh.drop("pos"), allowMissingColumns=True)


def insert_plain(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The divergent write path of the tools (SNK4): new rows come in as latest,
    without a sequence number, and demote nothing - so an id may then have several
    rows recorded as latest, and FLT1 and FLT3 may answer differently."""
    return stored.unionByName(new.withColumn("is_latest", F.lit(True)).withColumn("server_seq", F.lit(None).cast("long")), allowMissingColumns=True)


def backfilled(rows: DataFrame) -> DataFrame:
    """is_latest by the greatest version string, and a dense sequence in
    (created_at, version) order, numbered by range parts (MIG5, AGG8)."""
    out = rows.withColumn("is_latest", F.col("version") == F.max("version").over(Window.partitionBy("id")))
    return numbered(out, ["created_at", "version"], "server_seq")


#: Rows up to which a counted table is put in order by one task.
ONE_TASK_ROWS = 100_000


def numbered(rows: DataFrame, order: list[str], out: str, counted: int | None = None) -> DataFrame:
    """Adds 1, 2, ... in a total order without bringing all rows to one task:
    rows are dealt by range, counted by part, and numbered inside each part.  Few
    rows, if their number is given, are put in order by one task."""
    from vergraph.plans.graph import cut

    if counted is not None and counted <= ONE_TASK_ROWS:
        return rows.withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("long"))
    dealt = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_rows"))
    parts = parts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))  # one row per part
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(parts, "_part").withColumn(out, (F.col("_before") + inside).cast("long")).drop("_part", "_before")
