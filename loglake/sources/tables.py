"""The ``logs`` lake as a catalog table (create, drop, recreate, domains).

The table is external: dropping it never deletes data. Identifiers are
checked against a plain-name pattern and quoted; values are parameters.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loglake import schema as S
from loglake.session import observed_metrics, path_exists
from loglake.sources.lake import day_folders, read_logs, write_logs

DOMAINS_PROPERTY = "loglake.domains"
_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")

_COLUMNS = ("`timestamp` TIMESTAMP, level STRING, service STRING, message STRING, "
            "trace_id STRING, log_group STRING, log_stream STRING, "
            "domain STRING, year STRING, month STRING, day STRING, ingest_key STRING")


def _ident(*parts: str) -> str:
    for p in parts:
        if not _NAME.match(p or ""):
            raise ValueError(f"not a plain identifier: {p!r}")
    return ".".join(f"`{p}`" for p in parts)


def create_log_table(spark: SparkSession, db: str, table: str, path: str, fmt: str = "parquet",
                     domains: list[str] | None = None) -> None:
    """Create database and table if absent (idempotent), then register the
    partitions already on disk."""
    if fmt not in ("parquet", "json"):
        raise ValueError(f"unknown format {fmt!r}")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_ident(db)}")
    props = ""
    if domains is not None:
        props = f" TBLPROPERTIES ('{DOMAINS_PROPERTY}' = '{','.join(_check_domains(domains))}')"
    opts = " OPTIONS ('timestampFormat' = \"yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]\")" if fmt == "json" else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_ident(db, table)} ({_COLUMNS}) USING {fmt}{opts} "
              f"PARTITIONED BY (domain, year, month, day, ingest_key) LOCATION '{_path(path)}'{props}")
    if path_exists(spark, path):
        sync_partitions(spark, db, table)


def _path(path: str) -> str:
    if "'" in path:
        raise ValueError("quote in path")
    return path


def _check_domains(domains: list[str]) -> list[str]:
    for d in domains:
        if not re.match(r"^[a-z0-9_-]+$", d):
            raise ValueError(f"bad domain name {d!r}")
    return list(domains)


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def add_partitions(spark: SparkSession, db: str, table: str, folders: list[tuple[str, ...]], keys: list[str]) -> None:
    """Register (domain, year, month, day, folder) under the given ingest keys, many in one statement."""
    parts = [f"PARTITION ({', '.join(f'{c} = {_literal(v)}' for c, v in zip(S.LAYOUT_COLUMNS, (*f[:4], k)))})" for f in folders for k in keys]
    for i in range(0, len(parts), 500):
        spark.sql(f"ALTER TABLE {_ident(db, table)} ADD IF NOT EXISTS {' '.join(parts[i:i + 500])}")


def write_to_table(spark: SparkSession, db: str, table: str, df: DataFrame, path: str, fmt: str = "parquet",
                   ingest_key: str | None = None) -> str:
    """Write rows into the table's lake and register just the partitions that this write touched.

    The first and last day come from the write itself (observed metrics); the folders
    between them are worked out, and those that hold the write's key are added. Returns the key.
    """
    observed = Observation()
    day = F.concat_ws("-", "year", "month", "day")
    key = write_logs(df.observe(observed, F.min(day).alias("first"), F.max(day).alias("last")), path, fmt, ingest_key=ingest_key)
    days = observed_metrics(observed)
    if days.get("first"):
        folders = day_folders(spark, path, None, (days["first"], days["last"]))
        with ThreadPoolExecutor(16) as pool:
            there = list(pool.map(lambda f: path_exists(spark, f"{f[-1]}/{S.INGEST_KEY}={key}"), folders))
        add_partitions(spark, db, table, [f for f, ok in zip(folders, there) if ok], [key])
    return key


def sync_partitions(spark: SparkSession, db: str, table: str) -> None:
    """Make partition directories that others wrote since the last call visible: lists the whole lake."""
    spark.sql(f"MSCK REPAIR TABLE {_ident(db, table)}")


def drop_log_table(spark: SparkSession, db: str, table: str, drop_database: bool = False) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_ident(db, table)}")
    if drop_database:
        spark.sql(f"DROP DATABASE IF EXISTS {_ident(db)}")


def recreate_log_table(spark: SparkSession, db: str, table: str, path: str, fmt: str = "parquet",
                       domains: list[str] | None = None) -> None:
    """Drop the definition (data stays), create it again, re-register partitions."""
    drop_log_table(spark, db, table)
    create_log_table(spark, db, table, path, fmt, domains)


def set_domains(spark: SparkSession, db: str, table: str, domains: list[str]) -> None:
    spark.sql(f"ALTER TABLE {_ident(db, table)} SET TBLPROPERTIES "
              f"('{DOMAINS_PROPERTY}' = '{','.join(_check_domains(domains))}')")


def get_domains(spark: SparkSession, db: str, table: str) -> list[str] | None:
    rows = spark.sql(f"SHOW TBLPROPERTIES {_ident(db, table)}").collect()
    for r in rows:
        if r["key"] == DOMAINS_PROPERTY:
            return [d for d in r["value"].split(",") if d]
    return None


def read_table(spark: SparkSession, db: str, table: str, registered_only: bool = True) -> DataFrame:
    """The table; with ``registered_only`` rows of unregistered domains (e.g.
    ``unknown``) are filtered out by a partition predicate. A JSON table is
    read at its location, where keys match in any letter case."""
    about = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {_ident(db, table)}").collect()}
    if about.get("Provider", "").lower() == "json":
        df = read_logs(spark, about["Location"], "json")
    else:
        df = spark.table(f"{_ident(db, table)}").drop("ingest_key")
    doms = get_domains(spark, db, table) if registered_only else None
    return df.where(F.col("domain").isin(doms)) if doms is not None else df


def list_tables(spark: SparkSession, db: str) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(db) if not t.isTemporary)
