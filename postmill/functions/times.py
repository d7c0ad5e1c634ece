"""Buckets of time. Inputs are wall-clock timestamps in UTC; results are timestamps without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hour_of(ts: Column | str) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def day_of(ts: Column | str) -> Column:
    return F.date_trunc("day", ts).cast("timestamp_ntz")


def local_start(unit: str, ts: Column | str, zone: str) -> Column:
    """The UTC time at which the day, week or month of a zone began."""
    return F.to_utc_timestamp(F.date_trunc(unit, F.from_utc_timestamp(ts, zone)), zone).cast("timestamp_ntz")


def seconds(ts: Column | str) -> Column:
    """Whole seconds since the epoch."""
    return F.unix_seconds(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def in_hours(ts: Column, start: str, end: str, zone: str) -> Column:
    """Whether the local wall clock lies in [start, end); a start after the end wraps over midnight."""
    now = F.date_format(F.from_utc_timestamp(ts, zone), "HH:mm")
    return ((now >= start) & (now < end)) if start <= end else ((now >= start) | (now < end))
