"""The files of a lake as rows: listing, sizes, deletion. No log row is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake import schema as S
from loglake.session import delete_path, path_exists

FILE_SCHEMA = "path string, bytes long, " + ", ".join(f"{c} string" for c in S.LAYOUT_COLUMNS)


def _key(column: str) -> Column:
    """A partition value cut from a file path, with directory escapes undone."""
    raw = F.regexp_extract("path", rf"/{column}=([^/]*)/", 1)
    text = F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    return F.when((raw == "") | (raw == "__HIVE_DEFAULT_PARTITION__"), F.lit(None)).otherwise(text).alias(column)


def list_files(spark: SparkSession, path: str, fmt: str = "parquet", folders: list[str] | None = None) -> DataFrame:
    """path, bytes and partition values of every data file of the lake, or of some of its folders.

    The source lists files (in parallel when there are many); their content
    is not selected, so nothing is opened.
    """
    if folders is None:
        folders = [path] if path_exists(spark, path) else []
    if not folders:
        return spark.createDataFrame([], FILE_SCHEMA)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", f"*.{fmt}").load(folders))
    return files.select("path", F.col("length").alias("bytes"), *[_key(c) for c in S.LAYOUT_COLUMNS])


def partition_inventory(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Files and bytes per (domain, year, month, day)."""
    return list_files(spark, path, fmt).groupBy(*S.PARTITION_COLUMNS).agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def snapshot(spark: SparkSession, path: str, fmt: str = "parquet", folders: list[str] | None = None) -> str:
    """A text that changes with the lake's files, or those of some folders, whoever wrote them."""
    row = list_files(spark, path, fmt, folders).agg(
        F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0)),
        F.coalesce(F.bit_xor(F.xxhash64("path", "bytes")), F.lit(0))).first()
    return "-".join(map(str, row))


def scan_estimate(spark: SparkSession, path: str, fmt: str = "parquet", predicate: Column | None = None) -> DataFrame:
    """(files, scanned_bytes): what a query with this partition predicate reads.

    Data filters skip no file, so they have no place here; bytes are whole file
    sizes, an upper bound for a column-pruned Parquet read.
    """
    files = list_files(spark, path, fmt)
    files = files.where(predicate) if predicate is not None else files
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("scanned_bytes"))


def _task_path(path: str):
    """The filesystem and name that Arrow has for a listed path, in a task or on the driver."""
    import pyarrow.fs as pafs

    # Directory escapes such as %3A are part of the name.
    uri = path.replace("%", "%25").replace(" ", "%20")
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def tasks_reach(path: str) -> bool:
    """Whether tasks can copy and delete files under a listed path by themselves.

    Not so for schemes that only Spark's own readers and writers know (``s3a``, for one).
    """
    import pyarrow as pa

    try:
        _task_path(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def copied(files: DataFrame) -> DataFrame:
    """Copy files whole, from column ``path`` to ``target``; one row (path) for each when it runs.

    A copy has a hidden name until its size is that of the source, so a task that
    dies leaves no part of a file, and one that runs again replaces its own.
    """

    def run(it):
        import uuid

        import pyarrow.fs as pafs

        for pdf in it:
            for path, target, size in zip(pdf["path"], pdf["target"], pdf["bytes"]):
                (source, a), (store, b) = _task_path(path), _task_path(target)
                folder, _, name = b.rpartition("/")
                store.create_dir(folder, recursive=True)
                temp = f"{folder}/_{name}-{uuid.uuid4().hex}"
                pafs.copy_files(a, temp, source_filesystem=source, destination_filesystem=store)
                if store.get_file_info(temp).size != size:
                    raise OSError(f"the copy of {path} is not whole")
                store.move(temp, b)
            yield pdf[["path"]]

    return files.select("path", "target", "bytes").mapInPandas(run, "path string")


def deleted(files: DataFrame) -> DataFrame:
    """Delete the files in column ``path``, in tasks; one row (path) for each when it runs.

    A file already gone is fine, so tasks and jobs can run again.
    """

    def run(it):
        import pyarrow.fs as pafs

        for pdf in it:
            for path in pdf["path"]:
                fs, name = _task_path(path)
                if fs.get_file_info(name).type != pafs.FileType.NotFound:
                    fs.delete_file(name)
            yield pdf[["path"]]

    return files.select("path").mapInPandas(run, "path string")


def delete_files(files: DataFrame) -> int:
    """Delete the files in column ``path``; returns how many were listed.

    Tasks delete them where they can; other stores are asked by the driver, file by
    file, through the filesystem Spark has for them.
    """
    spark, n = files.sparkSession, 0
    first = files.select("path").head(1)
    if not first:
        return 0
    if tasks_reach(first[0]["path"]):
        return deleted(files).count()
    for row in files.select("path").toLocalIterator():
        delete_path(spark, row["path"])
        n += 1
    return n
