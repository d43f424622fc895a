"""Session-level facade: the operations of the log tool, as DataFrames.

    lake = LogLake(spark, "/data/logs", fmt="parquet")
    df = lake.query("SELECT level, count(*) AS cnt FROM logs WHERE domain = :d GROUP BY level",
                    {"d": "payment"})
    lake.cost_report().show()
    lake.check_alerts(rules).show()
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loglake import schema as S
from loglake.operators import alerts as AL
from loglake.operators import cost as CO
from loglake.operators.sql import run_sql
from loglake.plans.inspect import cached_bytes, run_measured
from loglake.sources.files import snapshot
from loglake.sources.lake import day_folders, read_logs, registered_only
from loglake.sources.tables import get_domains
from loglake.session import ensure_utc


class LogLake:
    def __init__(self, spark: SparkSession, path: str, fmt: str = "parquet",
                 domains: list[str] | None = None, cache_ttl: float = 300.0, history_path: str | None = None,
                 cache_bytes: int = S.CACHE_MAX_BYTES, table: tuple[str, str] | None = None):
        # A session of its own (same SparkContext): its ``logs`` temp view and
        # settings never clash with the caller's or another LogLake's.
        self.spark = ensure_utc(spark.newSession())
        self.path, self.fmt = path, fmt
        # ``table`` (database, name): the registered domains are its property.
        self.domains = get_domains(self.spark, *table) if table and domains is None else domains
        self.history = CO.QueryHistory(self.spark, history_path or path.rstrip("/") + "-history")
        self.cache = CO.ResultCache(cache_ttl, max_bytes=cache_bytes)

    def logs(self, options: dict | None = None, domains: list[str] | None = None,
             dates: tuple[str, str] | None = None) -> DataFrame:
        df = read_logs(self.spark, self.path, self.fmt, options=options, domains=domains, dates=dates)
        return registered_only(df, self.domains) if self.domains is not None else df

    def query(self, sql: str, args: dict | None = None, domains: list[str] | None = None,
              dates: tuple[str, str] | None = None) -> DataFrame:
        """Run SQL over ``logs``; record the bytes its scans selected and the
        cost; serve repeats from the cache for ``cache_ttl`` seconds (a hit is
        free and not recorded). A hit needs the same files in the lake, whoever wrote
        them. Results above the cache's bytes are not kept.

        With ``dates`` (first and last day, ISO), and ``domains`` if given, ``logs`` is these days only:
        nothing else is listed, and a write elsewhere leaves a hit a hit."""
        reached = None if dates is None else [x[-1] for x in day_folders(self.spark, self.path, domains, dates)]
        key = (sql, tuple(sorted((args or {}).items())), dates and (tuple(domains or ()), dates),
               snapshot(self.spark, self.path, self.fmt, reached))
        hit = self.cache.get(key)
        if hit is not None:
            return hit
        # A read of its own: Spark must not answer it from another result it holds.
        df = run_sql(self.spark, self.logs({"loglake.read": uuid.uuid4().hex}, domains, dates), sql, args).persist()
        self.history.append(sql, run_measured(df)["scanned_bytes"])
        return self.cache.put(key, df, cached_bytes(df))

    def cost_totals(self) -> DataFrame:
        return CO.cost_totals(self.history.frame())

    def cost_report(self) -> DataFrame:
        return CO.cost_report(self.history.frame())

    def check_alerts(self, rules: DataFrame, as_of=None, keyword_mode: str = "contains") -> DataFrame:
        import datetime as _dt
        as_of = as_of or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        return AL.alert_status(self.logs(), rules, as_of, keyword_mode)

    def alert_summary(self, status: DataFrame) -> DataFrame:
        return AL.alert_summary(status)

    def alert_payload(self, status: DataFrame) -> DataFrame:
        return AL.alert_payload(status)

