"""Change batches from a stream, folded into keyed state.

The state of an id is its current version and the versions that it has had.  A
micro-batch deals its own changes to the state, one id at a time, and appends
what comes out: the log of outcomes, and the version rows that it adds, with the
next sequence numbers.  Nothing that was written before is read or written again,
so a batch costs what it brings.  Readers take the newest snapshot and the
batches after it; ``Store.compact`` makes a snapshot, apart from the stream.

A batch that runs again after a failure starts from the state that its
predecessor left in the checkpoint and overwrites its own folders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from vergraph.functions.values import is_tombstoned, version_micros
from vergraph.operators.sync import acknowledgements, fold_change, stored_content
from vergraph.operators.versions import numbered
from vergraph.plans.graph import send_package

STORE = "id string, version string, is_latest boolean, updated_us long, content string, server_seq long"
LOG = "id string, pos int, outcome string, becomes_latest boolean, inserted boolean, version string, parents array<string>, resolved_version string, reason string, change_type string, content string, apply_us long"
ADDED = "id string, version string, becomes_latest boolean, updated_us long, content string, parent_versions array<string>, server_seq long"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started in here keep their state in RocksDB, as the state API needs."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


class Fold(StatefulProcessor):
    """The ordered fold of one id; a micro-batch bounds what an id brings at once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "version string, us long, deleted boolean")
        self.seen = handle.getMapState("seen", "version string", "at int")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        for version, is_latest, us, deleted in initialState[["version", "is_latest", "updated_us", "deleted"]].itertuples(index=False):
            self.seen.updateValue((version,), (0,))
            if is_latest:
                self.current.update((version, None if pd.isna(us) else int(us), bool(deleted)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changes = pd.concat(list(rows)).sort_values("pos")
        now = tuple(self.current.get()) if self.current.exists() else (None, None, False)
        fresh, log = set(), []

        def seen(version: str) -> bool:
            return version in fresh or self.seen.containsKey((version,))

        for c in changes.itertuples(index=False):
            us, at = (None if pd.isna(v) else int(v) for v in (c.remote_us, c.apply_us))
            (outcome, latest, inserted, parents, resolved, reason), now = fold_change(now, seen, c.change_type, c.version, c.parent_versions, us, at, bool(c.deleted))
            if inserted:
                fresh.add(c.version)
                self.seen.updateValue((c.version,), (int(c.pos),))
            log.append((key[0], int(c.pos), outcome, latest, inserted, c.version, parents, resolved, reason, c.change_type, c.content, at))
        if now[0] is not None:
            self.current.update(now)
        yield pd.DataFrame(log, columns=[f.split(" ")[0] for f in LOG.split(", ")])

    def close(self) -> None:
        pass


class Store:
    """Version rows under a folder: snapshots, and what each batch added."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _numbers(self, kind: str) -> list[int]:
        """The finished folders of a kind, ascending."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        done = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}/*/_SUCCESS"))
        return sorted(int(f.getPath().getParent().getName()) for f in done)

    def begin(self, stored: DataFrame) -> None:
        """Start from stored rows: they are the snapshot before the first batch."""
        stored.select(*[f.split(" ")[0] for f in STORE.split(", ")]).write.mode("overwrite").parquet(f"{self.folder}/snapshots/-1")

    def _snapshot(self, last: int | None = None) -> tuple[int, DataFrame]:
        have = [n for n in self._numbers("snapshots") if last is None or n <= last]
        if not have:
            return -1, self.spark.createDataFrame([], STORE)
        return have[-1], self.spark.read.schema(STORE).parquet(f"{self.folder}/snapshots/{have[-1]}")

    def rows(self, last: int | None = None) -> DataFrame:
        """All version rows after batch ``last``, or after all of them."""
        base, snapshot = self._snapshot(last)
        later = [f"{self.folder}/added/{n}" for n in self._numbers("added") if n > base and (last is None or n <= last)]
        if not later:
            return snapshot
        added = self.spark.read.schema(ADDED).parquet(*later)
        now = added.where("becomes_latest").groupBy("id").agg(F.max("server_seq").alias("_latest"))
        held = snapshot.join(now, "id", "left").withColumn("is_latest", F.col("is_latest") & F.col("_latest").isNull())
        new = added.join(now, "id", "left").withColumn("is_latest", F.coalesce(F.col("server_seq") == F.col("_latest"), F.lit(False)))
        names = [f.split(" ")[0] for f in STORE.split(", ")]
        return held.select(*names).union(new.select(*names))

    def compact(self, last: int) -> None:
        """Write a snapshot of what is there after batch ``last``."""
        self.rows(last).write.mode("overwrite").parquet(f"{self.folder}/snapshots/{last}")

    def _top(self, batch: int) -> int:
        """The greatest sequence number before a batch: each batch leaves its own."""
        marks = [n for n in self._numbers("marks") if n < batch]
        if marks:
            return self.spark.read.schema("top long").parquet(f"{self.folder}/marks/{marks[-1]}").first()["top"]
        return self._snapshot(-1)[1].agg(F.coalesce(F.max("server_seq"), F.lit(0))).first()[0]

    def append(self, log: DataFrame, batch: int) -> None:
        log.write.mode("overwrite").parquet(f"{self.folder}/log/{batch}")
        log = self.spark.read.schema(LOG).parquet(f"{self.folder}/log/{batch}")
        top, new = self._top(batch), log.where("inserted")
        n = new.count()
        ranked = numbered(new, ["pos", "id", "version"], "server_seq", n)
        ranked.select("id", "version", "becomes_latest", F.col("apply_us").alias("updated_us"), stored_content().alias("content"), F.col("parents").alias("parent_versions"), (F.col("server_seq") + top).alias("server_seq")).write.mode("overwrite").parquet(f"{self.folder}/added/{batch}")
        acknowledgements(log).write.mode("overwrite").parquet(f"{self.folder}/acks/{batch}")
        self.spark.range(1).select(F.lit(top + n).cast("long").alias("top")).write.mode("overwrite").parquet(f"{self.folder}/marks/{batch}")


def folded(changes: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The log of a stream of changes (those of ``sync.apply_changes``), by keyed
    state that starts from ``stored`` rows (SYN2 to SYN7)."""
    send_package(changes.sparkSession)
    gone = is_tombstoned(F.col("content")).alias("deleted")
    rows = changes.select(F.coalesce("id", F.lit("")).alias("id"), "pos", "apply_us", "change_type", "version", "parent_versions", version_micros(F.col("version")).alias("remote_us"), gone, "content")
    first = stored.select("id", "version", "is_latest", "updated_us", gone).groupBy("id") if stored is not None else None
    return rows.groupBy("id").transformWithStateInPandas(Fold(), LOG, "Append", "None", first)


def sync_stream(changes: DataFrame, store: Store, checkpoint: str, observe: Callable[[int], None] | None = None) -> StreamingQuery:
    """Run a change stream into the store until what is there is applied (SYN1).
    ``observe`` is called with each batch number after its commit (UDF2)."""

    def each(df: DataFrame, batch: int) -> None:
        store.append(df, batch)
        if observe:
            observe(batch)

    base, stored = store._snapshot(-1)
    log = folded(changes, stored if -1 in store._numbers("snapshots") else None)
    with keyed_state(store.spark):
        return log.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
