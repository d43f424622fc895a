"""Time columns: epoch -> timestamp, ISO text, date partitions, bounds."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglake.schema import ISO_FORMAT

# Python's datetime covers years 1..9999; an event outside fails its envelope.
MIN_EPOCH_MS = -62135596800000
MAX_EPOCH_MS = 253402300799999


def iso_text(ts: Column) -> Column:
    """Millisecond ISO-8601 text in UTC, e.g. 2024-01-02T03:04:05.678Z."""
    return F.date_format(ts, ISO_FORMAT)


def parse_as_of(as_of) -> _dt.datetime:
    if isinstance(as_of, _dt.datetime):
        return as_of.replace(tzinfo=None) if as_of.tzinfo is None else \
            as_of.astimezone(_dt.timezone.utc).replace(tzinfo=None)
    return _dt.datetime.fromisoformat(str(as_of).replace("Z", ""))


def ts_literal(as_of) -> Column:
    """A TIMESTAMP literal for a UTC wall-clock instant (session is UTC)."""
    return F.to_timestamp(F.lit(parse_as_of(as_of).strftime("%Y-%m-%d %H:%M:%S.%f")))


def partition_date(prefix: str = "") -> Column:
    """The date a (year, month, day) partition stands for."""
    return F.make_date(F.col(prefix + "year").cast("int"), F.col(prefix + "month").cast("int"),
                       F.col(prefix + "day").cast("int"))


def date_bound(lower) -> Column:
    """Partition predicate ``partition date >= date(lower)`` on the text keys.

    Built from partition columns only, so Spark evaluates it against the
    partition listing (PartitionFilters) and skips older directories; a
    time filter on ``timestamp`` alone cannot do that because the text keys
    have no declared link to it.
    """
    d = parse_as_of(lower).strftime("%Y-%m-%d")
    key = F.concat_ws("-", F.col("year"), F.col("month"), F.col("day"))
    return key >= F.lit(d)
