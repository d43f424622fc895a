"""Retention: age partitions by their date, plan tiers, apply the plan.

Plans come from the file listing; no log row is read for them. Applying one
works on the files listed at its start, which stand in a journal: these are copied
whole (archive tier) and then deleted, so a row that arrives meanwhile is in no list and
stays, and a run that died is finished from its journal.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglake import schema as S
from loglake.functions.time import parse_as_of, partition_date
from loglake.session import path_exists, qualified, scoped_conf, write_text
from loglake.sources.files import copied, delete_files, deleted, list_files, tasks_reach
from loglake.sources.journal import COPIED, DELETED, PLANNED, Journal, Lease
from loglake.sources.lake import bump_version, read_logs, write_logs

HOT, ARCHIVE, EXPIRED = "hot", "archive", "expired"
#: A listing opens no file, so a task takes thousands of them; by default one for each 32 small files.
LISTING_CONF = {"spark.sql.files.openCostInBytes": "64k"}
#: What the keys of packed files begin with.
FULL_BIN, PART_BIN = "compact-full-", "compact-part-"


def retention_plan(partitions: DataFrame, as_of, retention_days: int | None,
                   archive_days: int | None = None) -> DataFrame:
    """Per partition: age in days and tier. ``age >= retention_days`` is
    expired; ``age >= archive_days`` is archive; else hot. No retention
    setting: an empty plan (nothing is aged). ``schema.DEFAULT_RETENTION_DAYS``
    is the customary value when a caller wants the default. ``partitions`` has
    the partition columns: a file listing, an inventory, or rows."""
    parts = partitions.select(*S.PARTITION_COLUMNS).distinct()
    if retention_days is None:
        return parts.limit(0).select(*S.PARTITION_COLUMNS, F.lit(0).alias("age_days"),
                                     F.lit(HOT).alias("tier"))
    d = parse_as_of(as_of).date()
    age = F.datediff(F.lit(d), partition_date())
    tier = F.when(age >= retention_days, F.lit(EXPIRED))
    if archive_days is not None:
        tier = tier.when(age >= archive_days, F.lit(ARCHIVE))
    tier = tier.otherwise(F.lit(HOT))
    return parts.select(*S.PARTITION_COLUMNS, age.alias("age_days"), tier.alias("tier"))


def _same_day(left: str, right: str):
    return F.expr(" AND ".join(f"{left}.{c} <=> {right}.{c}" for c in S.PARTITION_COLUMNS))


def planned_files(spark: SparkSession, root: str, plan: DataFrame, fmt: str = "parquet") -> DataFrame:
    """path, bytes, keys and tier of the files that a plan moves or removes."""
    todo = plan.where(F.col("tier") != HOT)
    return (list_files(spark, root, fmt).alias("f").join(todo.alias("p"), _same_day("f", "p"))
            .select("f.*", "p.tier"))


def _journals(root: str) -> str:
    return f"{root.rstrip('/')}-state/retention"


def apply_retention(spark: SparkSession, root: str, plan: DataFrame, fmt: str = "parquet",
                    archive_root: str | None = None, dry_run: bool = True) -> DataFrame:
    """Carry out a plan on a lake. Returns the files acted on, with their tier.

    Archive tier: the listed files are copied whole to the same place under ``archive_root``,
    then deleted; without ``archive_root`` a plan with archive rows is refused. Expired:
    deleted. ``dry_run`` only lists. Each file's target and state stand in a journal, from
    which the next run finishes what a run that died has left, before it lists anything.
    """
    if dry_run:
        return planned_files(spark, root, plan, fmt)
    resume_retention(spark, root, fmt)
    journal = begin_retention(spark, root, plan, fmt, archive_root)
    finish_retention(spark, root, journal, fmt)
    return journal.planned().drop("target")


def begin_retention(spark: SparkSession, root: str, plan: DataFrame, fmt: str = "parquet",
                    archive_root: str | None = None) -> Journal:
    """Step 1: write down what becomes of each file, in a journal."""
    inner = F.expr(f"substring(path, {len(qualified(spark, root)) + 1})")
    target = F.concat(F.lit(qualified(spark, archive_root)), inner) if archive_root else F.lit(None).cast("string")
    found = planned_files(spark, root, plan, fmt).withColumn("target", F.when(F.col("tier") == ARCHIVE, target))
    with scoped_conf(spark, LISTING_CONF):
        if not archive_root and not found.where(F.col("tier") == ARCHIVE).isEmpty():
            raise ValueError("the plan has an archive tier but no archive_root is given; nothing was changed")
        return Journal.begin(_journals(root), found, archive_root or "")


def _spread(files: DataFrame) -> DataFrame:
    """The rows over tasks of about a GB of files, or one for each core."""
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return files.repartition(max(1, min(n, files.sparkSession.sparkContext.defaultParallelism), size >> 30))


def copy_planned(spark: SparkSession, root: str, journal: Journal, fmt: str = "parquet") -> None:
    """Step 2: copy the files that have a target and no copy yet."""
    todo = journal.files().where(F.col("target").isNotNull() & (F.col("state") == PLANNED))
    first = todo.select("path", "target").head(1)
    if not first:
        return
    if all(map(tasks_reach, first[0])):
        journal.note(copied(_spread(todo)), COPIED)
    else:
        copy_files(spark, root, todo, journal.about, fmt)
        journal.note(todo, COPIED)


def delete_moved(journal: Journal) -> None:
    """Step 3: delete the files that have been copied or are expired."""
    todo = journal.files().where((F.col("state") == COPIED) | (F.col("tier") == EXPIRED) & (F.col("state") != DELETED))
    first = todo.select("path").head(1)
    if not first:
        return
    if tasks_reach(first[0]["path"]):
        journal.note(deleted(_spread(todo)), DELETED)
    else:
        delete_files(todo)
        journal.note(todo, DELETED)


def finish_retention(spark: SparkSession, root: str, journal: Journal, fmt: str = "parquet") -> None:
    """Steps 2 and 3, as far as they are still to be done."""
    copy_planned(spark, root, journal, fmt)
    delete_moved(journal)
    bump_version(spark, root)
    journal.end()


def resume_retention(spark: SparkSession, root: str, fmt: str = "parquet") -> int:
    """Finish the journals of runs that died; returns how many there were."""
    left = Journal.unfinished(spark, _journals(root))
    for journal in left:
        finish_retention(spark, root, journal, fmt)
    return len(left)


def copy_files(spark: SparkSession, root: str, files: DataFrame, target: str, fmt: str = "parquet",
               key: Column | str | None = None, whole_keys: bool = False) -> None:
    """Add the rows of the listed files of a lake to another one, read and written anew.

    By default the copies are named after the write and the file they come from: a copy made
    again replaces itself and nothing else.
    """
    rows = read_logs(spark, root, fmt, keep_key=True, keep_file=True)
    listed = files.select(*S.LAYOUT_COLUMNS, F.regexp_extract("path", "[^/]+$", 0).alias("file_name"),
                          *([key.alias("_new_key")] if isinstance(key, Column) else []))
    same = F.expr(" AND ".join(f"r.{c} <=> f.{c}" for c in (*S.LAYOUT_COLUMNS, "file_name")))
    if isinstance(key, Column):
        picked = rows.alias("r").join(listed.alias("f"), same).select("r.*", "f._new_key")
        key = F.col("_new_key")
    else:
        picked = rows.alias("r").join(listed.alias("f"), same, "left_semi")
    write_logs(picked, target, fmt, whole_keys=whole_keys, ingest_key=key if key is not None else F.concat_ws(
        "-", F.lit("archive"), S.INGEST_KEY, "file_name"))


def expire_archive(spark: SparkSession, archive_root: str, as_of, retention_days: int, fmt: str = "parquet",
                   dry_run: bool = True) -> DataFrame:
    """Delete archived files whose day is past retention."""
    plan = retention_plan(list_files(spark, archive_root, fmt), as_of, retention_days)
    return apply_retention(spark, archive_root, plan, fmt, dry_run=dry_run)


def compaction_plan(files: DataFrame, before_day: str, target_mb: int = S.TARGET_FILE_MB, min_files: int = 2) -> DataFrame:
    """The files to pack, with ``bin`` and ``new_key``: which of them become one file.

    ``files``: a listing. Only files of closed days (before ``before_day``, ISO) under half the target
    size are packed, smallest first, into bins of about that size; a bin needs ``min_files``. What came
    out of a full bin is not packed again, whatever its size, so a second run finds nothing.
    """
    target = target_mb << 20
    day = F.concat_ws("-", "year", "month", "day")
    small = files.where((day < F.lit(before_day)) & (F.col("bytes") < target / 2) & ~F.coalesce(F.col(S.INGEST_KEY), F.lit("")).startswith(FULL_BIN))
    before = F.sum("bytes").over(Window.partitionBy(*S.PARTITION_COLUMNS).orderBy("bytes", "path")) - F.col("bytes")
    small = small.withColumn("bin", F.floor(before / target).cast("int"))
    one_bin = Window.partitionBy(*S.PARTITION_COLUMNS, "bin")
    packed = (small.withColumn("_n", F.count(F.lit(1)).over(one_bin)).withColumn("_size", F.sum("bytes").over(one_bin))
              .where(F.col("_n") >= min_files))
    key = F.concat(F.when(F.col("_size") >= target / 2, FULL_BIN).otherwise(PART_BIN), F.lit(uuid.uuid4().hex + "-"), F.col("bin"))
    return packed.withColumn("new_key", key).drop("_n", "_size")


def compact(spark: SparkSession, root: str, before_day: str, fmt: str = "parquet", min_files: int = 2,
            target_mb: int = S.TARGET_FILE_MB, lease_seconds: float = 3600.0) -> int:
    """Pack the small files of each closed day (:func:`compaction_plan`).

    Returns how many files were replaced. The plan is written to a journal first, then the
    new files, one a bin, then the old ones are deleted. Between these two steps readers see
    both copies; a run that died is finished, or its unfinished copies removed, by the
    next one. Run it where no reader is, or at a quiet hour. One run at a time holds the lease.
    """
    state = f"{root.rstrip('/')}-state/compaction"
    lease = Lease(spark, f"{state}/LEASE", lease_seconds)
    lease.take()
    for journal in Journal.unfinished(spark, f"{state}/runs"):
        _finish_compaction(spark, root, journal, fmt)
    lease.renew()
    journal = Journal.begin(f"{state}/runs", compaction_plan(list_files(spark, root, fmt), before_day, target_mb, min_files))
    files = journal.planned()
    n = files.count()
    if n:
        copy_files(spark, root, files, root, fmt, key=F.col("new_key"), whole_keys=True)
        lease.renew()  # a run that was taken over must not delete
        write_text(spark, f"{journal.path}/WRITTEN", "-")
    _finish_compaction(spark, root, journal, fmt)
    lease.give_up()
    return n


def _finish_compaction(spark: SparkSession, root: str, journal: Journal, fmt: str) -> None:
    files = journal.planned()
    if path_exists(spark, f"{journal.path}/WRITTEN"):
        delete_files(files)
    else:
        new = files.select(F.col("new_key").alias(S.INGEST_KEY)).distinct()
        delete_files(list_files(spark, root, fmt).join(new, S.INGEST_KEY, "left_semi"))
    bump_version(spark, root)
    journal.end()
