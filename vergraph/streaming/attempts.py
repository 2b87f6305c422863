"""Rate limits and suspicious patterns on streams of attempts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vergraph.operators.windows import LIMITED, WINDOW_US, Limiter
from vergraph.plans.graph import send_package


def _due_ms(at_us: int) -> int:
    return at_us // 1000 + 1


class Limits(StatefulProcessor):
    """Attempts wait until the watermark is past them and are then judged in order
    of their time, however they arrived.  One timer of an identifier is set: for the
    first attempt that waits, or else for when its state can go."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at_us long, success boolean")
        self.limits = handle.getValueState("limits", "recent array<bigint>, locked_until long, step int")

    def _wake_at(self, ms: int) -> None:
        timers = list(self.handle.listTimers())
        if not timers or min(timers) > ms:
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            self.waiting.appendList([(int(at), bool(ok)) for at, ok in frame[["at_us", "success"]].itertuples(index=False)])
            self._wake_at(_due_ms(int(frame["at_us"].min())))
        yield pd.DataFrame([], columns=_NAMES)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((int(at), bool(ok)) for at, ok in self.waiting.get())
        ready = [r for r in waiting if _due_ms(r[0]) <= now_ms]
        recent, locked, step = self.limits.get() if self.limits.exists() else ([], 0, 0)
        limiter = Limiter([int(t) for t in recent], int(locked), int(step))
        out = [(key[0], at, *limiter.attempt(at, ok)) for at, ok in ready]
        left = waiting[len(ready) :]
        self.waiting.clear()
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(_due_ms(left[0][0]))
        elif limiter.locked_until or limiter.recent:
            end = max([limiter.sweep_us() if limiter.locked_until else 0, *(t + WINDOW_US for t in limiter.recent)])
            if _due_ms(end) > now_ms:
                self.handle.registerTimer(_due_ms(end))
        if limiter.idle(now_ms * 1000) and not left:
            self.limits.clear()
        else:
            self.limits.update((limiter.recent, limiter.locked_until, limiter.step))
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


_NAMES = [f.split(" ")[0] for f in LIMITED.split(", ")]


def limited_stream(attempts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The limiter on a stream (U1, U2): an attempt's answer comes out once the
    watermark, ``late`` behind the newest attempt, is past it; attempts that are
    later than that are left out.  Start the query within ``changes.keyed_state``.
    ``attempts``: identifier, at_us, success; identifier, at_us, allowed, retry_after_s come out."""
    send_package(attempts.sparkSession)
    rows = attempts.where("at_us is not null").select(F.coalesce("identifier", F.lit("")).alias("identifier"), "at_us", F.coalesce("success", F.lit(False)).alias("success"), F.timestamp_micros("at_us").alias("at")).withWatermark("at", late)
    return rows.groupBy("identifier").transformWithStateInPandas(Limits(), LIMITED, "Append", "EventTime")


def suspicious_stream(attempts: DataFrame, late: str = "10 minutes", span: str = "5 minutes", every: str = "1 minute") -> DataFrame:
    """Windows with at least ten failures of an identifier, or about five
    different password prefixes, behind a watermark (U4)."""
    prefix = F.left(F.coalesce("password_hash", F.lit("")), F.lit(8))
    counts = attempts.withWatermark("ts", late).groupBy(F.window("ts", span, every).alias("w"), "identifier").agg(F.count("*").alias("failures"), F.approx_count_distinct(prefix).alias("prefixes"))
    return counts.where("failures >= 10 or prefixes >= 5").select(F.col("w.start").alias("window_start"), "identifier", "failures", "prefixes")


def audit_log(events: DataFrame, folder: str, checkpoint: str):
    """Append a stream of audit events as JSON lines by day (SNK10)."""
    return events.withColumn("day", F.to_date("ts")).writeStream.format("json").partitionBy("day").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
