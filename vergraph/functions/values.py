"""Column expressions on versions, timestamps and JSON content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), ts)


def version_text(ts: Column, counter: Column, user: Column) -> Column:
    """``{utc-iso8601}-{counter:06d}-{user}``, always with six fractional digits."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00-"), F.lpad(counter.cast("string"), 6, "0"), F.lit("-"), user)


def version_time(version: Column) -> Column:
    """The timestamp that a version string starts with (also of the older form
    with a Z after the offset); null if there is none."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(version, r"^(.*?[+-]\d{2}:\d{2})", 1), F.lit("")))


def version_micros(version: Column) -> Column:
    return F.unix_micros(version_time(version))


def repaired_version(version: Column) -> Column:
    """Without a Z that follows an offset."""
    return F.regexp_replace(version, r"([+-]\d{2}:\d{2})Z", "$1")


def is_tombstoned(content: Column) -> Column:
    """Whether content.deleted is truthy (false, 0, "", null, [] and {} are not)."""
    value = F.get_json_object(content, "$.deleted")
    return F.coalesce(~value.isin("false", "0", "0.0", "-0.0", "", "[]", "{}", "null"), F.lit(False))


def text_field(content: Column, key: str) -> Column:
    return F.get_json_object(content, f"$.{key}")


def list_field(content: Column, key: str) -> Column:
    """An array of strings in content, empty by default."""
    return F.coalesce(F.from_json(F.get_json_object(content, f"$.{key}"), "array<string>"), F.array().cast("array<string>"))


def merged_content(old: Column, new: Column) -> Column:
    """Top-level keys of two JSON objects; the second wins."""
    kind = "map<string,variant>"
    a, b = (F.coalesce(F.from_json(c, kind), F.from_json(F.lit("{}"), kind)) for c in (old, new))
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.to_json(F.map_concat(kept, b))


def backoff_seconds(failures: Column) -> Column:
    """Wait before the next try: doubling from 30 s, at most 64 times."""
    return (30 * F.pow(F.lit(2), F.least(failures, F.lit(6)))).cast("long")


def difference_ms(local_us: Column, remote_us: Column) -> Column:
    """Whole milliseconds from local to remote, cut towards zero."""
    d = remote_us - local_us
    return (F.signum(d) * F.floor(F.abs(d) / 1000)).cast("long")


def remote_wins(local_us: Column, local_version: Column, remote_us: Column, remote_version: Column) -> Column:
    """Last writer wins; within a second the greater version string does, and
    equal ones leave the local row."""
    near = F.abs(difference_ms(local_us, remote_us)) < 1000
    return F.when(near, F.coalesce(remote_version, F.lit("")) > F.coalesce(local_version, F.lit(""))).otherwise(remote_us > local_us)


def resolution_reason(local_us: Column, local_version: Column, remote_us: Column, remote_version: Column) -> Column:
    near = F.abs(difference_ms(local_us, remote_us)) < 1000
    wins = remote_wins(local_us, local_version, remote_us, remote_version)
    side = F.when(wins, "remote").otherwise("local")
    return F.when(near, F.concat(F.lit("timestamps within 1s, "), side, F.lit(" has greater version"))).otherwise(F.concat(side, F.lit(" has newer timestamp")))
