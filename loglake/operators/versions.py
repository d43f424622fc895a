"""Tables whose rows hold from a time on: every change is a further version, nothing is replaced."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglake.functions.time import parse_as_of, ts_literal

#: What a history has besides the columns of its rows.
VALID_FROM, REMOVED = "valid_from", "removed"
ALWAYS, FOREVER = -(1 << 62), 1 << 62


def micros_of(as_of) -> int:
    t = parse_as_of(as_of).replace(tzinfo=_dt.timezone.utc)
    return int(t.timestamp()) * 1_000_000 + t.microsecond


def is_history(df: DataFrame) -> bool:
    return VALID_FROM in df.columns


def as_history(rows: DataFrame, columns: list[str], at=None, removed: bool = False) -> DataFrame:
    """Rows as versions that hold from ``at`` on; always, without it."""
    when = F.lit(None).cast("timestamp") if at is None else ts_literal(parse_as_of(at))
    return rows.select(*columns, when.alias(VALID_FROM), F.lit(removed).alias(REMOVED))


def removals(history: DataFrame, keys: DataFrame, key: str, at) -> DataFrame:
    """Versions that end the rows of the given keys at a time."""
    columns = [f for f in history.schema if f.name not in (VALID_FROM, REMOVED)]
    gone = keys.select(key).distinct().select(*[F.col(key) if f.name == key else F.lit(None).cast(f.dataType).alias(f.name) for f in columns])
    return as_history(gone, [f.name for f in columns], at, removed=True)


def lifetimes(history: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Every version with ``r_from`` and ``r_to`` (microseconds, the end not included).

    A version holds until the next one of its key. Of those of one key and time a removal
    counts first, then the smallest row. Plain rows, without the columns of a history, hold always.
    """
    if not is_history(history):
        history = as_history(history, [key, *columns])
    start = F.coalesce(F.unix_micros(VALID_FROM), F.lit(ALWAYS))
    one = (history.groupBy(key, start.alias("r_from"))
           .agg(F.min(F.struct((~F.col(REMOVED)).alias("kept"), *columns)).alias("_r"))
           .select(key, "r_from", F.col("_r")["kept"].alias("kept"), *[F.col("_r")[c].alias(c) for c in columns]))
    end = F.lead("r_from").over(Window.partitionBy(key).orderBy("r_from"))
    return one.withColumn("r_to", F.coalesce(end, F.lit(FOREVER))).where("kept").drop("kept")


def held_at(history: DataFrame, key: str, columns: list[str], as_of) -> DataFrame:
    """The rows that hold at a time."""
    t = micros_of(as_of)
    return lifetimes(history, key, columns).where((F.col("r_from") <= t) & (F.col("r_to") > t)).select(key, *columns)
