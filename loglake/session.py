"""Session helpers: UTC clock, adaptive execution, shared scratch folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession

# Settings every loglake job relies on. Time zone UTC: ISO text and date
# partitions are always rendered in UTC.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app: str = "loglake", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, use the cluster's session and call
    :func:`ensure_utc` instead."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_utc(spark)
    return spark


def ensure_utc(spark: SparkSession) -> SparkSession:
    """Pin the session clock to UTC and turn on AQE (runtime-only settings)."""
    for k, v in DEFAULT_CONF.items():
        if k == "spark.sql.execution.arrow.pyspark.enabled":
            continue
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when nothing is configured (local tests) is a private folder created
    and registered as the checkpoint directory.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        root = tempfile.mkdtemp(prefix="loglake-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint root, e.g. for derived lakes."""
    return "/".join([checkpoint_root(spark), "loglake", *[p.strip("/") for p in parts]])


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a small step under the shared checkpoint root and read it back: it is
    computed once, and what builds on it survives lost executors."""
    path = scratch_path(df.sparkSession, "steps", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed_metrics(observation: Observation) -> dict:
    """What a finished action observed; nothing if its plan turned out to be empty."""
    try:
        return observation.get
    except Py4JJavaError as e:
        if "java.lang.AssertionError" not in str(e.java_exception):
            raise
        return {}


def _hadoop(spark: SparkSession, path: str):
    """The path and its filesystem as Spark resolves them: a path without a
    scheme is on the default filesystem, wherever that is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return bool(fs.exists(p))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as file listings show it."""
    p, fs = _hadoop(spark, path.rstrip("/"))
    return fs.makeQualified(p).toString()


def local_write_options(spark: SparkSession, path: str) -> dict:
    """Write options for Parquet files in a local folder; none for any other store.

    Hadoop's default there keeps a .crc file beside each file and starts four ``chmod``
    processes for the two, most of the time of a write of small files. Its plain
    filesystem starts one; the checksums of Parquet's own pages are written as ever.
    A session that names a local filesystem of its own keeps it.
    """
    _, fs = _hadoop(spark, path)
    if fs.getUri().getScheme() != "file" or fs.getConf().get("fs.file.impl"):  # s3a and others need the default for their buffers
        return {}
    return {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    p, fs = _hadoop(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete one file, or an empty folder; nothing happens if it is not there."""
    p, fs = _hadoop(spark, path)
    fs.delete(p, False)


def path_status(spark: SparkSession, path: str) -> str:
    """Sizes and modification times of a file, or of the files in a folder."""
    p, fs = _hadoop(spark, path)
    if not fs.exists(p):
        return ""
    return ",".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in fs.listStatus(p)))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small marker file."""
    p, fs = _hadoop(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that must not exist yet; False if it does."""
    p, fs = _hadoop(spark, path)
    if fs.exists(p):
        return False
    try:
        out = fs.create(p, False)
    except Exception as e:  # made by another writer since
        if "already exists" not in str(e):
            raise
        return False
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


@contextlib.contextmanager
def scoped_conf(spark: SparkSession, settings: dict):
    """Set runtime SQL settings for the duration of a block, then restore."""
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield spark
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
