"""Ready-made log queries over a ``logs`` DataFrame.

Every query takes the table (a lake read, so partition predicates become
PartitionFilters) and plain parameters; nothing is assembled as SQL text.
Any ``limit`` has a full tie-break so results are deterministic.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.functions.text import keyword_match
from loglake.functions.time import date_bound, iso_text, parse_as_of, ts_literal
from loglake.session import saved

def row_order() -> list[Column]:
    """Tie-break of every ordered limit: time, then the unique trace id."""
    return [F.col("timestamp").asc(), F.col("trace_id").asc()]


def _day_filter(day) -> Column:
    d = day if isinstance(day, _dt.date) else _dt.date.fromisoformat(str(day)[:10])
    return ((F.col("year") == f"{d.year:04d}") & (F.col("month") == f"{d.month:02d}")
            & (F.col("day") == f"{d.day:02d}"))


def display(df: DataFrame) -> DataFrame:
    """Render ``timestamp`` as ISO text (the table's text form)."""
    if "timestamp" in df.columns:
        return df.withColumn("timestamp", iso_text(F.col("timestamp")))
    return df


def count_by_domain(logs: DataFrame) -> DataFrame:
    """Rows per domain, most first (partial + final hash aggregate)."""
    return logs.groupBy("domain").agg(F.count(F.lit(1)).alias("cnt")).orderBy(
        F.col("cnt").desc(), F.col("domain"))


def domain_sample(logs: DataFrame, domain: str, n: int = 5) -> DataFrame:
    """timestamp, level, service, message of the first n rows of a domain."""
    return display(logs.where(F.col("domain") == domain)
                   .orderBy(*row_order()).limit(n)
                   .select("timestamp", "level", "service", "message"))


def count_by_level(logs: DataFrame, domain: str) -> DataFrame:
    return (logs.where(F.col("domain") == domain).groupBy("domain", "level")
            .agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.col("cnt").desc(), "level"))


def month_total(logs: DataFrame, domain: str, year: str, month: str) -> DataFrame:
    return (logs.where((F.col("domain") == domain) & (F.col("year") == year)
                       & (F.col("month") == month))
            .agg(F.count(F.lit(1)).alias("total")))


def day_levels(logs: DataFrame, day) -> DataFrame:
    return (logs.where(_day_filter(day)).groupBy("level")
            .agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.col("cnt").desc(), "level"))


def domain_rows(logs: DataFrame, domain: str, year: str, month: str, n: int = 10) -> DataFrame:
    """Whole rows of a domain-month, first n by time."""
    return display(logs.where((F.col("domain") == domain) & (F.col("year") == year)
                              & (F.col("month") == month))
                   .orderBy(*row_order()).limit(n))


def errors_on_day(logs: DataFrame, domain: str, day, level: str = "ERROR") -> DataFrame:
    return (logs.where((F.col("domain") == domain) & _day_filter(day)
                       & (F.col("level") == level))
            .agg(F.count(F.lit(1)).alias("errors")))


def top_messages(logs: DataFrame, domain: str, as_of, days: int, k: int = 5,
                 level: str = "ERROR") -> DataFrame:
    """Top-k messages of one level in a domain over the trailing ``days``; ties by message.

    The lower time bound also becomes a partition bound, so old days are not listed.
    Hashes of messages are counted first, so that pass shuffles 16 bytes for each distinct message
    and task and no text. Only messages whose hash counts as much as the k-th are then counted
    as texts. Should two messages have shared a hash, the second pass goes down to the count it found.
    """
    lower = parse_as_of(as_of) - _dt.timedelta(days=days)
    rows = (logs.where((F.col("domain") == domain) & (F.col("level") == level)
                       & date_bound(lower) & (F.col("timestamp") >= ts_literal(lower)))
            .select("message", F.xxhash64("message").alias("_hash")))
    counts = saved(rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")), "message-counts")
    best = [r["_n"] for r in counts.orderBy(F.desc("_n")).limit(k).collect()]
    least = min(best, default=0)
    while True:
        likely = counts.where(F.col("_n") >= least).select("_hash")
        top = saved(rows.join(likely, "_hash", "left_semi").groupBy("message").agg(F.count(F.lit(1)).alias("cnt"))
                    .orderBy(F.col("cnt").desc(), F.col("message")).limit(k), "top-messages")
        found = top.agg(F.min("cnt"), F.count(F.lit(1))).first()
        reached = found[0] if found[1] >= k else min(1, least)
        if reached is None or reached >= least:
            return top.orderBy(F.col("cnt").desc(), F.col("message"))
        least = reached


def domain_day(logs: DataFrame, domain: str, day) -> DataFrame:
    return display(logs.where((F.col("domain") == domain) & _day_filter(day)))


def keyword_search(logs: DataFrame, keyword: str, mode: str = "contains",
                   domain: str | None = None) -> DataFrame:
    cond = keyword_match(F.col("message"), F.lit(keyword), mode)
    if domain is not None:
        cond = cond & (F.col("domain") == domain)
    return display(logs.where(cond))


def recent_logs(logs: DataFrame, as_of, minutes: float, domain: str | None = None,
                level: str | None = None) -> DataFrame:
    """Rows with ``timestamp >= as_of - minutes`` (no upper bound)."""
    lower = parse_as_of(as_of) - _dt.timedelta(minutes=minutes)
    cond = date_bound(lower) & (F.col("timestamp") >= ts_literal(lower))
    if domain is not None:
        cond = cond & (F.col("domain") == domain)
    if level is not None:
        cond = cond & (F.col("level") == level)
    return display(logs.where(cond))
