"""Time windows over attempts, audit events and backups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vergraph.plans.graph import send_package

WINDOW_US, MOST_ATTEMPTS, LOCKOUT_S, MOST_DELAY = 300_000_000, 5, 900, 5


def attempts_before(attempts: DataFrame) -> DataFrame:
    """Adds n_recent: attempts of the identifier in the last 300 s, this one left
    out, the cut-off exclusive (U1).  ``attempts``: identifier, at_us."""
    w = Window.partitionBy("identifier").orderBy("at_us").rangeBetween(-WINDOW_US + 1, -1)
    return attempts.withColumn("n_recent", F.count("*").over(w))


def rate_status(attempts: DataFrame, now_us: int) -> DataFrame:
    """identifier, attempts in the window that ends now (U3)."""
    recent = F.col("at_us") > now_us - WINDOW_US
    return attempts.groupBy("identifier").agg(F.count_if(recent).alias("attempts")).withColumn("max_attempts", F.lit(MOST_ATTEMPTS)).withColumn("at_limit", F.col("attempts") >= MOST_ATTEMPTS)


SWEEP_US = 3_600_000_000


class Limiter:
    """State of one identifier: the lockout grows with every offence, up to six
    times (the stored step is capped at five, one is added when used); success
    clears it.  A lockout that an attempt finds run out leaves the step as it is; one
    that the sweep on the hour finds takes the step with it (U1, U2)."""

    def __init__(self, recent: list[int] | None = None, locked_until: int = 0, step: int = 0):
        self.recent, self.locked_until, self.step = list(recent or []), locked_until, step

    def sweep_us(self) -> int:
        """The first sweep that finds the lockout run out."""
        return (self.locked_until // SWEEP_US + 1) * SWEEP_US

    def check(self, now_us: int) -> tuple[bool, int]:
        if self.locked_until and now_us >= self.sweep_us():
            self.locked_until = self.step = 0
        if now_us < self.locked_until:
            return False, (self.locked_until - now_us) // 1_000_000
        self.locked_until = 0
        self.recent = [t for t in self.recent if t > now_us - WINDOW_US]
        if len(self.recent) >= MOST_ATTEMPTS:
            times = self.step + 1
            self.locked_until = now_us + LOCKOUT_S * times * 1_000_000
            self.step = min(times, MOST_DELAY)
            return False, LOCKOUT_S * times
        return True, 0

    def attempt(self, now_us: int, success: bool) -> tuple[bool, int]:
        allowed, wait = self.check(now_us)
        if allowed and success:
            self.recent, self.locked_until, self.step = [], 0, 0
        elif allowed:
            self.recent.append(now_us)
        return allowed, wait

    def idle(self, now_us: int) -> bool:
        """Whether nothing is left that a later attempt could meet."""
        swept = not self.locked_until or now_us >= self.sweep_us()
        return swept and (not self.step or bool(self.locked_until)) and all(t <= now_us - WINDOW_US for t in self.recent)


LIMITED = "identifier string, at_us long, allowed boolean, retry_after_s long"


def limited(attempts: DataFrame) -> DataFrame:
    """identifier, at_us, allowed, retry_after_s: the limiter over each
    identifier's attempts in order (at the same time failures first).  Spark deals
    and sorts; a task holds one identifier's state, never its attempts.
    ``attempts``: identifier, at_us, success."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), Limiter()
        for batch in batches:
            out = []
            for identifier, at, success in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if identifier != now:
                    now, state = identifier, Limiter()
                out.append(state.attempt(at, bool(success)))
            allowed, wait = (pa.array([o[i] for o in out], t) for i, t in ((0, pa.bool_()), (1, pa.int64())))
            yield pa.record_batch([batch.column(0), batch.column(1), allowed, wait], ["identifier", "at_us", "allowed", "retry_after_s"])

    send_package(attempts.sparkSession)
    rows = attempts.where("at_us is not null").select("identifier", F.col("at_us").cast("long").alias("at_us"), F.coalesce("success", F.lit(False)).alias("success"))
    return rows.repartition("identifier").sortWithinPartitions("identifier", "at_us", "success").mapInArrow(run, LIMITED)


def suspicious(attempts: DataFrame, every: str = "1 minute", span: str = "5 minutes") -> DataFrame:
    """window_start, identifier, pattern, n: per sliding window at least ten
    failures, or at least five different eight-character prefixes of password
    hashes (U4).  ``attempts``: identifier, ts, password_hash; works on streams
    with a watermark when ``n_prefixes`` may be approximate."""
    prefix = F.left(F.coalesce("password_hash", F.lit("")), F.lit(8))
    counts = attempts.groupBy(F.window("ts", span, every).alias("w"), "identifier").agg(F.count("*").alias("failures"), F.count_distinct(prefix).alias("prefixes"))
    rows = counts.select(F.col("w.start").alias("window_start"), "identifier", F.explode(F.array(F.struct(F.lit("excessive_failed_attempts").alias("pattern"), F.col("failures").alias("n"), F.lit(10).alias("least")), F.struct(F.lit("credential_stuffing").alias("pattern"), F.col("prefixes").alias("n"), F.lit(5).alias("least")))).alias("p"))
    return rows.where("p.n >= p.least").select("window_start", "identifier", "p.pattern", "p.n")


def retained(backups: DataFrame, now_us: int, days: int, most: int, keep_newest: bool = False) -> DataFrame:
    """Adds keep: not older than ``days``, and among the ``most`` newest (U5);
    optionally the newest stays in any case.  ``backups``: name, created_us."""
    from vergraph.operators.versions import numbered

    ranked = numbered(backups.withColumn("_age", -F.col("created_us")), ["_age", "name"], "rank").drop("_age")
    keep = (F.col("created_us") >= now_us - days * 86_400_000_000) & (F.col("rank") <= most)
    return ranked.withColumn("keep", (keep | (F.col("rank") == 1)) if keep_newest else keep)


def active_tokens(tokens: DataFrame, now_us: int) -> DataFrame:
    """Tokens that have not expired (U7)."""
    return tokens.where(F.col("expires_us") > now_us)


def query_log(events: DataFrame, event_types: list[str] | None = None, identifier: str | None = None, from_us: int | None = None, to_us: int | None = None, limit: int = 100) -> DataFrame:
    """Newest audit events under filters (U6; X6)."""
    for condition in (F.col("event_type").isin(*event_types) if event_types else None, F.col("identifier") == identifier if identifier else None, F.col("at_us") >= from_us if from_us is not None else None, F.col("at_us") < to_us if to_us is not None else None):
        if condition is not None:
            events = events.where(condition)
    return events.orderBy(F.desc("at_us"), "event_id").limit(limit)


def audit_report(events: DataFrame) -> DataFrame:
    """Events and different identifiers by type (U6; X6)."""
    return events.groupBy("event_type").agg(F.count("*").alias("n_events"), F.count_distinct("identifier").alias("n_identifiers"))
