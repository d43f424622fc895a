"""Scan-cost accounting: bytes a query reads, its price, history and report.

Price: USD 5 per TiB scanned. A history row is (sql, scanned_bytes, cost,
timestamp ISO text); totals and the per-query report are aggregates over
that table.
"""

from __future__ import annotations

import datetime as _dt
import time as _time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake import schema as S
from loglake.functions.time import iso_text
from loglake.operators.joins import local_table
from loglake.operators.numbering import global_row_number
from loglake.session import path_exists, saved
from loglake.sources.files import delete_files, list_files

PREVIEW = S.SQL_PREVIEW_CHARS


def cost_of(bytes_col):
    return bytes_col.cast("double") * F.lit(S.USD_PER_BYTE)


def cost_totals(history: DataFrame) -> DataFrame:
    """Queries, bytes, MB (2 decimals) and USD (6 decimals); zeros when the
    history is empty. Cost comes from total bytes, so no float sum order."""
    b = F.coalesce(F.sum("scanned_bytes"), F.lit(0)).cast("long")
    agg = history.agg(F.count(F.lit(1)).alias("queries"), b.alias("total_bytes"))
    return agg.select("queries", "total_bytes",
                      F.round(F.col("total_bytes") / F.lit(S.BYTES_PER_MB), 2).alias("total_mb"),
                      F.round(cost_of(F.col("total_bytes")), 6).alias("total_usd"))


def cost_report(history: DataFrame) -> DataFrame:
    """One line per query in the order they ran: number, time to the second,
    SQL cut at 50 characters (+ "..."), MB and USD. The number comes from the history;
    one without numbers is numbered by time (all of it, to the millisecond) and SQL."""
    numbered = history if "n" in history.columns else global_row_number(
        history, [F.col("timestamp").asc(), F.col("sql").asc()])
    preview = F.when(F.length("sql") > PREVIEW,
                     F.concat(F.substring("sql", 1, PREVIEW), F.lit("..."))).otherwise(F.col("sql"))
    return numbered.select(
        "n", F.substring("timestamp", 1, 19).alias("time"), preview.alias("sql_preview"),
        F.round(F.col("scanned_bytes") / F.lit(S.BYTES_PER_MB), 2).alias("mb"),
        F.round(cost_of(F.col("scanned_bytes")), 6).alias("usd"))


def partition_scan_estimates(logs: DataFrame) -> DataFrame:
    """History-shaped estimate per lake partition: the single-partition query,
    the logical bytes its rows hold (UTF-8 lengths of the text columns plus
    24 for the ISO time) and the time of its newest row."""
    L = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    row_bytes = F.lit(24)
    for c in S.DATA_COLUMNS[1:]:
        row_bytes = row_bytes + L(c)
    agg = logs.groupBy(*S.PARTITION_COLUMNS).agg(
        F.sum(row_bytes).cast("long").alias("scanned_bytes"),
        F.max("timestamp").alias("_last"))
    sql = F.format_string(
        "SELECT * FROM logs WHERE domain = '%s' AND year = '%s' AND month = '%s' AND day = '%s'",
        "domain", "year", "month", "day")
    return agg.select(sql.alias("sql"), "scanned_bytes",
                      cost_of(F.col("scanned_bytes")).alias("cost"),
                      iso_text(F.col("_last")).alias("timestamp"))


# ---- driver-side session objects ------------------------------------------------

#: A stored row: who appended it and when, in nanoseconds, never the same twice for one writer.
_STORED = "writer string, ran long, sql string, scanned_bytes long, cost double, timestamp string"


class QueryHistory:
    """The queries that ran, as a table of appended rows that several users share.

    A row carries its writer's name and the time it was appended, so no writer has to know
    of the others: rows are numbered when they are read, in the order they ran.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.writer, self.last = uuid.uuid4().hex, 0

    def append(self, sql: str, scanned_bytes: int, when: str | None = None) -> None:
        now = _dt.datetime.now(_dt.timezone.utc)
        when = when or now.strftime("%Y-%m-%dT%H:%M:%S.") + f"{now.microsecond // 1000:03d}Z"
        self.last = max(self.last + 1, _time.time_ns())
        row = (self.writer, self.last, sql, int(scanned_bytes), scanned_bytes * S.USD_PER_BYTE, when)
        local_table(self.spark, [row], _STORED).write.mode("append").json(self.path)

    def _rows(self, *paths: str) -> DataFrame:
        """The rows, each once: a fold that died leaves some in two files."""
        return self.spark.read.schema(_STORED).json(list(paths) or self.path).dropDuplicates(["writer", "ran"])

    def frame(self) -> DataFrame:
        if not path_exists(self.spark, self.path):
            return local_table(self.spark, [], S.HISTORY)
        return global_row_number(self._rows(), [F.col("ran").asc(), F.col("writer").asc()]).select(*S.HISTORY.names)

    def fold(self, min_files: int = 100) -> int:
        """Write the rows of many small files as one and delete these; returns how many there were."""
        files = saved(list_files(self.spark, self.path, "json"), "history-files")
        paths = [r["path"] for r in files.select("path").collect()]
        if len(paths) < min_files:
            return 0
        self._rows(*paths).coalesce(1).write.mode("append").json(self.path)
        return delete_files(files)


class ResultCache:
    """SQL results kept for ``ttl`` seconds (lazy expiry on each lookup).

    Key = (SQL text, source snapshot), so a new file in the lake or another
    table never serves a stale result. A hit costs nothing and is not added
    to the history. Entries hold persisted DataFrames; expiry unpersists. A
    result is kept only if it and those kept already stay within ``max_bytes``.
    """

    def __init__(self, ttl: float = S.CACHE_TTL_SECONDS, clock=_time.monotonic, max_bytes: int = S.CACHE_MAX_BYTES):
        self.ttl, self.clock, self.max_bytes, self._entries = ttl, clock, max_bytes, {}

    def purge(self) -> None:
        now = self.clock()
        for k in [k for k, (t, _, _) in self._entries.items() if now - t > self.ttl]:
            self._entries.pop(k)[1].unpersist()

    def get(self, key):
        self.purge()
        hit = self._entries.get(key)
        return None if hit is None else hit[1]

    def put(self, key, df: DataFrame, size: int = 0) -> DataFrame:
        """Keep a persisted result of ``size`` bytes, or unpersist it if it does not fit."""
        self.purge()
        if size + sum(e[2] for e in self._entries.values()) > self.max_bytes:
            return df.unpersist()
        self._entries[key] = (self.clock(), df, size)
        return df

    def __len__(self) -> int:
        return len(self._entries)
