"""Alerts over a stream: rule counts per event-time window.

Each micro-batch is joined once with the rules and adds its counts per (rule,
window) as files of its own key, next to the largest event time it saw. A window's
count is the sum over batches, so files may come in any order and a late event is
still counted; a batch that runs again replaces its own counts. A window is closed
once the largest event time, less ``delay_minutes``, has passed its end.
Nothing is held in memory between batches.

Rules may be a history (``operators.alerts.rule_history``): an event counts for the
version that holds at its own time, whenever it arrives. Counts are kept
without a threshold; a window is held against the one of the last version, with
its period, that held before the window's end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loglake import schema as S
from loglake.functions.time import iso_text
from loglake.operators.alerts import match_rules, version_side
from loglake.operators.versions import FOREVER
from loglake.streaming.ingest import batch_key, stream_name

PARTIAL = "name string, s long, span long, cnt long"
PROGRESS = "last long"


def _span():
    return (F.col("period_minutes") * 60_000_000).cast("long")


def window_partials(logs: DataFrame, rules: DataFrame, keyword_mode: str = "contains") -> DataFrame:
    """(name, s, span, cnt): tumbling windows of each rule's own period, in microseconds.

    An as-of join: an event meets the version of a rule that holds at its time.
    """
    micros = F.unix_micros("timestamp")
    start = micros - F.pmod(micros, _span())  # exact integer floor to the window
    held = (micros >= F.col("r_from")) & (micros < F.col("r_to"))
    return (match_rules(logs, version_side(rules), keyword_mode, held)
            .groupBy("name", start.alias("s"), _span().alias("span"))
            .agg(F.count(F.lit(1)).cast("long").alias("cnt")))


def _windows(partials: DataFrame, rules: DataFrame) -> DataFrame:
    counts = partials.groupBy("name", "s", "span").agg(F.sum("cnt").cast("long").alias("cnt"))
    # Versions with one period follow one another: each tells the threshold of the windows
    # that end after its beginning and not after the next one's.
    side = version_side(rules).select("name", _span().alias("span"), "threshold", "r_from")
    following = F.lead("r_from").over(Window.partitionBy("name", "span").orderBy("r_from"))
    side = side.withColumn("next", F.coalesce(following, F.lit(FOREVER)))
    end = F.col("w.s") + F.col("w.span")
    judged = counts.alias("w").join(side.alias("v"), (F.expr("w.name <=> v.name") & (F.col("w.span") == F.col("v.span"))
                                                      & (end > F.col("v.r_from")) & (end <= F.col("v.next"))))
    return judged.select("w.name", iso_text(F.timestamp_micros("s")).alias("window_start"),
                         iso_text(F.timestamp_micros(end)).alias("window_end"),
                         "cnt", "threshold", (F.col("cnt") > F.col("threshold")).alias("exceeded"))


def window_counts(logs: DataFrame, rules: DataFrame, keyword_mode: str = "contains") -> DataFrame:
    """Rule counts per window over all logs, in one pass."""
    return _windows(window_partials(logs, rules, keyword_mode), rules)


def alert_batch(logs: DataFrame, batch_id: int, rules: Callable[[], DataFrame], out_path: str, stream: str,
                keyword_mode: str = "contains") -> None:
    """Write one micro-batch's counts and its largest event time."""
    key = F.lit(batch_key(stream, batch_id)).alias(S.INGEST_KEY)
    logs = logs.persist()
    try:
        for name, df in (("partials", window_partials(logs, rules(), keyword_mode)),
                         ("progress", logs.agg(F.max(F.unix_micros("timestamp")).alias("last")))):
            (df.select("*", key).write.partitionBy(S.INGEST_KEY).mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").parquet(f"{out_path}/{name}"))
    finally:
        logs.unpersist()


def start_alerts(logs_stream: DataFrame, rules: Callable[[], DataFrame], out_path: str, checkpoint: str,
                 trigger: dict | None = None, stream: str | None = None, keyword_mode: str = "contains") -> StreamingQuery:
    """Count windows continuously; the rules, or their history, are read in every batch."""
    name = stream or stream_name(checkpoint)
    return (logs_stream.writeStream
            .foreachBatch(lambda df, bid: alert_batch(df, bid, rules, out_path, name, keyword_mode))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "60 seconds"})).start())


def closed_windows(spark: SparkSession, out_path: str, rules: DataFrame, delay_minutes: float = 0.0) -> DataFrame:
    """Closed windows of what :func:`start_alerts` has counted so far, held against the rules' thresholds."""
    partials = spark.read.schema(PARTIAL).parquet(f"{out_path}/partials")
    last = spark.read.schema(PROGRESS).parquet(f"{out_path}/progress").agg(F.max("last")).first()[0] or 0
    bound = last - int(delay_minutes * 60_000_000)
    return _windows(partials.where(F.col("s") + F.col("span") <= F.lit(bound)), rules)
