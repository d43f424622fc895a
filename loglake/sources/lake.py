"""The ``logs`` lake on files: writers and readers of one layout.

Every writer, batch, stream, archive or compaction, lays files out Hive style as
``domain=x/year=yyyy/month=MM/day=dd/ingest_key=k/``; readers and the catalog
table declare the same five levels. ``ingest_key`` names the write a file belongs
to: a write that runs again replaces its own directories and no others. Also
read: the bare ``x/yyyy/MM/dd/`` form, keys taken from the file path.
"""

from __future__ import annotations

import datetime as _dt
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake import schema as S
from loglake.session import list_names, local_write_options, path_exists, qualified, scoped_conf

VERSION_FILE = "_LOGLAKE_VERSION"

# Timestamps as INT64 micros: the legacy INT96 default keeps no min/max
# statistics, so time predicates could not skip row groups.
PARQUET_WRITE_CONF = {"spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS"}

# Files are cut at this many rows; with AQE's rebalance this keeps files
# near the advisory size instead of one file per task per partition.
MAX_RECORDS_PER_FILE = 2_000_000

# A task of small files writes about this many.
FILES_PER_TASK = 1024

# Key of writes that replace whole days (mode="overwrite").
MAIN_KEY = "main"


def _table_frame(df: DataFrame, key: str | None = None) -> DataFrame:
    cols = []
    for c in S.TABLE_COLUMNS:
        cols.append(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c))
    return df.select(*cols, *([F.col(key).alias(S.INGEST_KEY)] if key else []))


def write_logs(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append",
               max_records_per_file: int = MAX_RECORDS_PER_FILE, options: dict | None = None,
               target_file_mb: int | None = S.TARGET_FILE_MB,
               ingest_key: Column | str | None = None, whole_keys: bool = False) -> Column | str:
    """Write rows with the table columns, partitioned by domain and date.

    ``REBALANCE(domain, year, month, day)`` is one shuffle that groups rows
    of a partition together; AQE splits a hot domain-day into several
    advisory-size tasks instead of one, so a skewed partition costs more
    files, not one straggler. ``target_file_mb`` sets AQE's advisory
    partition size for this write only (files come out near that size);
    None leaves the session's. Where ``max_records_per_file`` makes files small, a
    task takes about a thousand files, not that size: their number is its work.

    Rows go under ``ingest_key`` (returned), by dynamic partition overwrite:
    the days in ``df`` lose what the same key wrote before and nothing else. By
    default ``mode="append"`` takes a new key, and ``mode="overwrite"`` one fixed
    key, so that it replaces the days that an earlier overwrite wrote. With
    ``whole_keys`` the rows of one day and key go to one task, for keys of a file's size.
    """
    key = ingest_key
    if key is None:
        key = MAIN_KEY if mode == "overwrite" else f"batch-{uuid.uuid4().hex}"
    keyed = df.withColumn("_key", F.lit(key) if isinstance(key, str) else key)
    # Rows inside each file are ordered by time: the writer sorts by the
    # partition keys anyway, and the extra key gives Parquet row groups tight
    # min/max ranges, so "last N minutes" predicates skip most of a day.
    out = _table_frame(keyed, "_key")
    out = (out.repartition(*S.LAYOUT_COLUMNS) if whole_keys else out.hint("rebalance", *S.PARTITION_COLUMNS)
           ).sortWithinPartitions(*S.LAYOUT_COLUMNS, "timestamp")
    w = (out.write.partitionBy(*S.LAYOUT_COLUMNS).mode("overwrite")
         .option("maxRecordsPerFile", max_records_per_file)
         .option("partitionOverwriteMode", "dynamic"))
    local = local_write_options(df.sparkSession, path) if fmt == "parquet" else {}
    for k, v in {**local, **(options or {})}.items():
        w = w.option(k, v)
    conf = dict(PARQUET_WRITE_CONF) if fmt == "parquet" else {}
    if target_file_mb:
        size = min(int(target_file_mb) << 20, max(1 << 20, max_records_per_file * FILES_PER_TASK * 64))  # rows of 64 bytes
        conf["spark.sql.adaptive.advisoryPartitionSizeInBytes"] = f"{size}b"
    with scoped_conf(df.sparkSession, conf):
        if fmt == "parquet":
            w.option("compression", "snappy").parquet(path)
        elif fmt == "json":
            w.option("timestampFormat", S.ISO_FORMAT).option("ignoreNullFields", "false").json(path)
        else:
            raise ValueError(f"unknown format {fmt!r}")
    bump_version(df.sparkSession, path)
    return key


def bump_version(spark: SparkSession, path: str) -> str:
    """Stamp the lake with a new version after a write: one small file at the
    root, so readers can tell "changed?" without listing every file."""
    import time

    v = f"{time.time_ns()}-{uuid.uuid4().hex}"
    from loglake.session import write_text
    write_text(spark, f"{path.rstrip('/')}/{VERSION_FILE}", v)
    return v


def lake_version(spark: SparkSession, path: str) -> str | None:
    from loglake.session import read_text
    return read_text(spark, f"{path.rstrip('/')}/{VERSION_FILE}")


def save_result(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A query result as CSV with a header row."""
    df.write.mode(mode).option("header", True).csv(path)


def months_between(first: str, last: str) -> list[tuple[str, str]]:
    """(yyyy, MM) of every month from one ISO day to another."""
    a, b = (_dt.date.fromisoformat(x) for x in (first, last))
    return [(f"{m // 12:04d}", f"{m % 12 + 1:02d}") for m in range(a.year * 12 + a.month - 1, b.year * 12 + b.month)]


def _escaped(value: str) -> str:
    """A partition value as it stands in a directory name."""
    return re.sub(r"""["#%'*/:=?\\\x00-\x1f\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value)


def day_folders(spark: SparkSession, path: str, domains: list[str] | None, dates: tuple[str, str],
                hive: bool = True) -> list[tuple[str, str, str, str, str]]:
    """(domain, year, month, day, folder) of the days asked for that exist.

    The folders follow from the predicate: domains times months. Only these months are
    listed, however many days the lake has; without ``domains`` its first level too.
    """
    root = path.rstrip("/")
    name = (lambda key, v: f"{key}={_escaped(v)}") if hive else (lambda key, v: v)
    if domains is None:
        found = [n for n in list_names(spark, root) if not n.startswith(("_", "."))]
        domains = [unquote(n.partition("=")[2]) for n in found if n.startswith("domain=")] if hive else [n for n in found if n != S.ERRORS_PREFIX]
    first, last = dates
    months = [(d, y, m, f"{root}/{name('domain', d)}/{name('year', y)}/{name('month', m)}")
              for d in sorted(set(domains)) for y, m in months_between(first, last)]
    with ThreadPoolExecutor(16) as pool:
        listed = list(pool.map(lambda x: list_names(spark, x[3]), months))
    out = []
    for (d, y, m, folder), names in zip(months, listed):
        for n in names:
            day = n.removeprefix("day=") if hive else n
            if re.fullmatch("[0-9]{2}", day) and (not hive or n.startswith("day=")) and first <= f"{y}-{m}-{day}" <= last:
                out.append((d, y, m, day, f"{folder}/{n}"))
    return out


def read_logs(spark: SparkSession, path: str, fmt: str = "parquet", case_insensitive: bool = True,
              keep_corrupt: bool = False, keep_key: bool = False, keep_file: bool = False,
              options: dict | None = None, domains: list[str] | None = None, dates: tuple[str, str] | None = None) -> DataFrame:
    """The lake as a DataFrame with the explicit table schema.

    Partition keys stay text (``03`` is not turned into 3). JSON keys match in
    any letter case, as the catalog table of the reference has it: canonical lines cost
    one parse, lines with other keys one more. ``case_insensitive=False`` takes
    exact keys only. JSON keeps broken lines in ``_corrupt_record`` when
    ``keep_corrupt``; its ``timestamp`` text is cast with ``try_cast`` so a bad
    value is null, never an error. ``keep_key`` keeps ``ingest_key``, ``keep_file``
    adds ``file_name``.

    With ``dates`` (first and last day, ISO), and ``domains`` if given, only these days'
    folders are listed and read (:func:`day_folders`); otherwise Spark lists the lake.
    """
    reader = spark.read.options(**(options or {}))
    paths: list[str] = [path]
    if dates is not None:
        paths = [x[-1] for x in day_folders(spark, path, domains, dates)]
        reader = reader.option("basePath", path)
    columns = [*S.TABLE_COLUMNS, *([S.CORRUPT] if keep_corrupt and fmt == "json" else []), *([S.INGEST_KEY] if keep_key else []),
               *(["file_name"] if keep_file else [])]
    source = [F.col("_metadata.file_name").alias("file_name")] if keep_file else []
    if not paths:
        return spark.createDataFrame([], ", ".join(f"{c} {'timestamp' if c == 'timestamp' else 'string'}" for c in columns))
    if fmt == "parquet":
        return reader.schema(S.LOGS_PARQUET).parquet(*paths).select("*", *source).select(*columns)
    if fmt != "json":
        raise ValueError(f"unknown format {fmt!r}")
    if case_insensitive:
        df = _any_case(reader.schema(", ".join(["value string", *(f"{c} string" for c in S.LAYOUT_COLUMNS)])).text(paths).select("*", *source))
    else:
        df = (reader.schema(S.LOGS_JSON)
              .option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", S.CORRUPT)
              .json(paths).select("*", *source))
    return df.withColumn("timestamp", F.expr("try_cast(timestamp AS TIMESTAMP)")).select(*columns)


def _any_case(raw: DataFrame) -> DataFrame:
    """JSON lines in column ``value`` as table columns, keys in any letter case."""
    exact = F.from_json("value", ", ".join(f"`{c}` string" for c in [*S.DATA_COLUMNS, S.CORRUPT]),
                        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": S.CORRUPT})
    # Only a line with a capital in some key is parsed again, once, as a map.
    other = F.when(F.col("value").rlike(r'"[^"]*[A-Z][^"]*"\s*:'), F.from_json("value", "map<string,string>"))
    entries = F.transform(F.map_entries(other), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))
    raw = raw.where(F.trim("value") != "").select(exact.alias("_x"), entries.alias("_e"), *[c for c in raw.columns if c != "value"])

    def pick(name):
        hit = F.filter("_e", lambda e: (e["k"] == F.lit(name)) & e["v"].isNotNull())
        return F.coalesce(F.col("_x")[name], F.try_element_at(hit, F.lit(1))["v"]).alias(name)

    return raw.select(*[pick(c) for c in S.DATA_COLUMNS], F.col("_x")[S.CORRUPT].alias(S.CORRUPT),
                      *[c for c in raw.columns if c not in ("_x", "_e")])


_BARE = r"/([^/=]+)/([0-9]{4})/([0-9]{2})/([0-9]{2})/[^/]*$"


def read_bare_layout(spark: SparkSession, path: str, fmt: str = "json", domains: list[str] | None = None,
                     dates: tuple[str, str] | None = None) -> DataFrame:
    """Read ``{domain}/{yyyy}/{MM}/{dd}/file`` with the keys from the path.

    Spark does not discover such keys: they are cut from ``_metadata.file_path``. With
    ``dates`` (first and last day, ISO) the folders of these days, and of ``domains`` if given, are
    worked out, and only they are listed (:func:`day_folders`); without, files are listed
    recursively, below ``domains`` only if given. Without ``domains`` all are read, but for the prefix
    that failed records go to.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    rest = "level string, service string, message string, trace_id string, log_group string, log_stream string"
    schema = f"timestamp {'string' if fmt == 'json' else 'timestamp'}, {rest}"
    if dates is not None:
        paths = [x[-1] for x in day_folders(spark, path, domains, dates, hive=False)]
    elif domains is not None:
        paths = [p for p in (f"{path.rstrip('/')}/{d}" for d in domains) if path_exists(spark, p)]
    else:
        paths = [path]
    if not paths:
        return spark.createDataFrame([], ", ".join(f"{c} {'timestamp' if c == 'timestamp' else 'string'}" for c in S.TABLE_COLUMNS))
    df = reader.schema(schema).json(paths) if fmt == "json" else reader.schema(schema).parquet(*paths)
    fp = F.col("_metadata.file_path")
    df = df.select(*[F.col(c) for c in S.DATA_COLUMNS],
                   *[F.regexp_extract(fp, _BARE, i + 1).alias(k)
                     for i, k in enumerate(S.PARTITION_COLUMNS)])
    df = df.where(F.col("domain").isin(list(domains)) if domains is not None else F.col("domain") != S.ERRORS_PREFIX)
    if fmt == "json":
        df = df.withColumn("timestamp", F.expr("try_cast(timestamp AS TIMESTAMP)"))
    return df


def write_bare_layout(df: DataFrame, path: str) -> None:
    """Write JSON Lines under ``{domain}/{yyyy}/{MM}/{dd}/`` (the layout a
    delivery stream produces).

    Spark's partitioned writer names its directories ``key=value``, so tasks write
    these files themselves: each to a name of its attempt, moved to
    its final name once complete, so a task that runs twice, or dies half-way, leaves
    one whole file. The filesystem is resolved by Arrow (local, HDFS, S3)."""
    from loglake.sources.files import tasks_reach

    out = _table_frame(df).withColumn("timestamp", F.date_format("timestamp", S.ISO_FORMAT))
    out = out.hint("rebalance", *S.PARTITION_COLUMNS).select(
        F.concat_ws("/", *S.PARTITION_COLUMNS).alias("folder"),
        F.to_json(F.struct(*S.DATA_COLUMNS), {"ignoreNullFields": "false"}).alias("line"))
    root = qualified(df.sparkSession, path)
    if not tasks_reach(root):
        raise ValueError(f"tasks cannot write single files under {root}; nothing was written")

    def write_part(it):
        import pandas as pd
        import pyarrow.fs as pafs
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(root if "://" in root else "file://" + root.removeprefix("file:"))  # file:/x
        streams: dict = {}
        # Each Arrow batch is written out at once: memory stays one batch,
        # with one open file per partition key this task holds.
        for pdf in it:
            for folder, g in pdf.groupby("folder", sort=False):
                if folder not in streams:
                    fs.create_dir(f"{base}/{folder}", recursive=True)
                    final = f"{base}/{folder}/part-{task.partitionId():05d}.json"
                    temp = f"{base}/{folder}/_part-{task.partitionId():05d}-{task.taskAttemptId()}"
                    streams[folder] = (fs.open_output_stream(temp), temp, final)
                streams[folder][0].write(("\n".join(g["line"]) + "\n").encode())
        for stream, temp, final in streams.values():
            stream.close()
            fs.move(temp, final)
        yield pd.DataFrame({"files": [len(streams)]})

    # The noop sink runs the writers without bringing anything back.
    out.mapInPandas(write_part, "files long").write.format("noop").mode("overwrite").save()


def write_quarantine(records: DataFrame, path: str, mode: str = "append") -> None:
    """Failed delivery records, original payload and reason, as JSON Lines.
    Always a sibling of the table root, never inside it."""
    from loglake.operators.ingest import rows_where

    failed = rows_where(records, F.col("disposition") == S.FAILED, ["record_id", "data", "reason"])
    failed.write.mode(mode).json(path)


def registered_only(logs: DataFrame, domains: list[str]) -> DataFrame:
    """Restrict to registered domains (a partition filter)."""
    return logs.where(F.col("domain").isin(list(domains)))
