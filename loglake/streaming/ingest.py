"""Continuous ingest: delivery records stream -> partitioned lake.

Each micro-batch is decoded once and written twice, to the lake with the batch
writer and to the quarantine. A batch's files carry the key ``<stream>-<batch>``:
``stream`` names the query (by default a hash of its checkpoint folder), so
streams, fresh checkpoints and batch writers on one path never replace each
other, while a batch that runs again replaces its own files.

The connections table is read in every batch, so a group connected later is
mapped from its next batch on; a history of connections maps each event as of its own
time instead. What a batch used is kept beside the checkpoint, and a replay uses
it again: its rows land where they were.

The audit counts records while the batch is written (observed metrics): nothing is
aggregated a second time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loglake import schema as S
from loglake.operators.ingest import disposition_metrics, explode_events, map_domain, parse_records, to_log_rows
from loglake.operators.joins import local_table
from loglake.operators.versions import REMOVED, VALID_FROM, is_history
from loglake.session import observed_metrics, path_exists
from loglake.sources.envelopes import read_envelopes
from loglake.sources.lake import write_logs

def stream_name(checkpoint: str) -> str:
    return "stream" + hashlib.sha1(checkpoint.rstrip("/").encode()).hexdigest()[:12]


def batch_key(stream: str, batch_id: int) -> str:
    return f"{stream}-{int(batch_id):012d}"


def mapping_of_batch(connections: DataFrame, state_path: str, key: str) -> DataFrame:
    """The mapping, or the history of it, that batch ``key`` used, kept at its first run."""
    path = f"{state_path.rstrip('/')}/mappings/{key}"
    mapping = connections.select("log_group", "domain", *([VALID_FROM, REMOVED] if is_history(connections) else []))
    if not path_exists(connections.sparkSession, f"{path}/_SUCCESS"):
        mapping.write.mode("overwrite").parquet(path)
    # A replay reads what the first run kept, whatever the table has become.
    return connections.sparkSession.read.parquet(path)


def ingest_batch(records: DataFrame, batch_id: int, connections: Callable[[], DataFrame],
                 lake_path: str, quarantine_path: str | None, fmt: str = "parquet",
                 stream: str = "stream", state_path: str | None = None, audit_path: str | None = None) -> None:
    """One micro-batch (also usable on a static DataFrame). Payloads are
    decoded and parsed once; all outputs read the persisted result."""
    key = batch_key(stream, batch_id)
    mapping = connections()
    if state_path:
        mapping = mapping_of_batch(mapping, state_path, key)
    # The decoded text is not needed once parsed: keep only what the
    # outputs read, so the persisted batch holds no second copy of it.
    observed = Observation()
    parsed = parse_records(records).drop("payload")
    if audit_path:
        parsed = parsed.observe(observed, *disposition_metrics())
    parsed = parsed.persist()
    try:
        rows = to_log_rows(map_domain(explode_events(parsed), mapping))
        write_logs(rows, lake_path, fmt, ingest_key=key)
        if quarantine_path:
            (parsed.where(F.col("disposition") == S.FAILED)
             .select("record_id", "data", "reason", F.lit(key).alias(S.INGEST_KEY))
             .write.partitionBy(S.INGEST_KEY).mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").json(quarantine_path))
        if audit_path:
            (audit_rows(records.sparkSession, observed_metrics(observed)).withColumn(S.INGEST_KEY, F.lit(key))
             .write.partitionBy(S.INGEST_KEY).mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").json(audit_path))
    finally:
        parsed.unpersist()


def audit_rows(spark: SparkSession, counts: dict) -> DataFrame:
    """(disposition, records) from a batch's observed metrics; none that did not occur."""
    return local_table(spark, [(d, counts[d]) for d in (S.OK, S.DROPPED, S.FAILED) if counts.get(d)], "disposition string, records long")


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"record_id string, data string, reason string, {S.INGEST_KEY} string").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """(ingest_key, disposition, records) of every batch."""
    return spark.read.schema(f"disposition string, records long, {S.INGEST_KEY} string").json(path)


def start_ingest(spark: SparkSession, source_path: str, lake_path: str, checkpoint: str,
                 connections: Callable[[], DataFrame], quarantine_path: str | None = None,
                 source_fmt: str = "json", fmt: str = "parquet", trigger: dict | None = None,
                 max_files_per_trigger: int | None = None, stream: str | None = None,
                 audit_path: str | None = None) -> StreamingQuery:
    """Start the stream. Default trigger: every FLUSH_SECONDS (the delivery buffer);
    tests pass ``{"availableNow": True}``."""
    records = read_envelopes(spark, source_path, source_fmt, streaming=True,
                             max_files_per_trigger=max_files_per_trigger)
    trig = trigger or {"processingTime": f"{S.FLUSH_SECONDS} seconds"}
    name = stream or stream_name(checkpoint)
    return (records.writeStream
            .foreachBatch(lambda df, bid: ingest_batch(df, bid, connections, lake_path, quarantine_path, fmt, name,
                                                       checkpoint.rstrip("/") + "-state", audit_path))
            .option("checkpointLocation", checkpoint)
            .trigger(**trig).start())
