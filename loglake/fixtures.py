"""Fixture data derived from the driver's ``events`` table.

``logs_projection`` maps each event to one log row (see FIXTURES.md);
``encode_envelopes`` packs those rows into gzip+base64 delivery records, so
the ingest path decodes data whose volume grows with ``events``.
"""

from __future__ import annotations

import hashlib
import os
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake import schema as S
from loglake.functions.codec import gzip_base64, gzip_base64_padded
from loglake.operators.joins import local_table
from loglake.session import ensure_utc, path_exists, path_status, scoped_conf, scratch_path, write_text

# ---- fixed values ----------------------------------------------------------
# Registered domains (the default domain set).
DOMAINS = ["user", "order", "payment", "auth", "notification"]
# user_id % 6 -> domain and log group, in this order.
DOMAIN_OF_USER_MOD = ["user", "order", "payment", "auth", "notification", "unknown"]
LOG_GROUP_OF_USER_MOD = ["/ecs/user-api", "/ecs/order-api", "/ecs/payment-api",
                         "/ecs/auth-service", "/ecs/notification-service",
                         "/ecs/unmapped"]
# event_type -> level.
LEVEL_OF_EVENT_TYPE = {"error": "ERROR", "purchase": "WARN", "signup": "INFO",
                       "click": "DEBUG", "view": "TRACE"}
# The fixed clock of every fixture query (never the wall clock).
AS_OF = "2024-01-31 00:00:00"
RETENTION_DAYS = 14
ARCHIVE_DAYS = 7
# Events per delivery envelope: envelope key is (group, stream, event_id div N).
EVENTS_PER_ENVELOPE = 256
# Subscription filter pattern per connected log group ("" = every event).
FILTER_PATTERN_OF_GROUP = {"/ecs/user-api": "", "/ecs/order-api": "",
                           "/ecs/payment-api": "error", "/ecs/auth-service": "purchase",
                           "/ecs/notification-service": "k\": 1"}
# Alert rules: (name, domain, level, keyword, threshold, period_minutes).
BASE_RULES = [
    ("payment-errors", "payment", "ERROR", None, 10.0, 1440.0),
    ("order-k9", "order", None, "k\": 9}", 2.0, 10080.0),
    ("auth-last-hour", "auth", None, None, 0.0, 60.0),
    ("user-warn-k1x", "user", "WARN", "k\": 1_}", 3.0, 20160.0),
    ("notification-pct", "notification", None, "100%", 1.0, 43200.0),
    ("payment-quote", "payment", None, "it's", 0.0, 1440.0),
    ("order-backslash", "order", None, "a\\d", 0.0, 1440.0),
    ("unknown-errors", "unknown", "ERROR", None, 3.0, 20160.0),
    ("negative-threshold", "user", None, None, -1.0, 60.0),
    ("zero-period", "order", None, None, 5.0, 0.0),
    ("no-domain", "", "ERROR", None, 1.0, 60.0),
    ("payment-error-daily", "payment", "ERROR", None, 5.0, 1440.0),
    ("endless-period", "user", None, None, 1.0, float("inf")),
    ("twice-named", "auth", "INFO", None, 2.0, 1440.0),
    ("twice-named", "auth", "WARN", None, 2.0, 1440.0),
]
# ---------------------------------------------------------------------------


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def logs_projection(ev: DataFrame) -> DataFrame:
    """One log row per event, with the event id kept for tie-breaks.

    The timestamp is cut to milliseconds (what a log event carries).
    """
    epoch_ms = F.unix_millis(F.col("ts").cast("timestamp"))
    ts = F.timestamp_millis(epoch_ms)
    level = F.create_map(*[x for kv in LEVEL_OF_EVENT_TYPE.items() for x in map(F.lit, kv)])
    return ev.select(
        F.col("event_id"),
        ts.alias("timestamp"),
        level[F.col("event_type")].alias("level"),
        F.when(F.col("event_id") % 2 == 0, "api").otherwise("worker").alias("service"),
        F.concat(F.col("event_type"), F.lit(" --- "), F.col("props")).alias("message"),
        F.md5(F.col("event_id").cast("string")).alias("trace_id"),
        _pick(LOG_GROUP_OF_USER_MOD, F.col("user_id") % 6).alias("log_group"),
        F.concat(F.lit("stream-"), (F.col("user_id") % 4).cast("string")).alias("log_stream"),
        _pick(DOMAIN_OF_USER_MOD, F.col("user_id") % 6).alias("domain"),
        F.date_format(ts, "yyyy").alias("year"),
        F.date_format(ts, "MM").alias("month"),
        F.date_format(ts, "dd").alias("day"),
        epoch_ms.alias("epoch_ms"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_utc(spark)
    return logs_projection(events(spark, sf_dir))


def connections(spark: SparkSession) -> DataFrame:
    """The five registered log groups; ``/ecs/unmapped`` stays unconnected."""
    rows = [(g, FILTER_PATTERN_OF_GROUP[g], d)
            for g, d in zip(LOG_GROUP_OF_USER_MOD, DOMAIN_OF_USER_MOD) if d != "unknown"]
    return local_table(spark, rows, S.CONNECTIONS)


def domains(spark: SparkSession) -> DataFrame:
    return local_table(spark, [(d, f"{d}/") for d in DOMAINS], S.DOMAINS)


def base_rules(spark: SparkSession) -> DataFrame:
    return local_table(spark, BASE_RULES, S.RULES)


def derived_rules(lg: DataFrame) -> DataFrame:
    """One daily rule per (domain, level) seen in the logs; grows with them."""
    return (lg.select("domain", "level").where(F.col("level").isNotNull()).distinct()
            .select(F.concat_ws("-", "domain", F.lower("level"), F.lit("daily")).alias("name"),
                    "domain", "level", F.lit(None).cast("string").alias("keyword"),
                    F.lit(50.0).alias("threshold"), F.lit(1440.0).alias("period_minutes")))


def derived_connections(lg: DataFrame) -> DataFrame:
    """One connection per log group seen in the logs, its domain read from
    the group name (``/ecs/<domain>-...``)."""
    return (lg.select("log_group").distinct()
            .select("log_group", F.lit("").alias("filter_pattern"),
                    F.regexp_extract("log_group", r"^/ecs/([a-z]+)", 1).alias("domain")))


# ---- envelopes -------------------------------------------------------------

def _envelope_json(group: Column, stream: Column, events_arr: Column,
                   message_type: str = S.DATA_MESSAGE) -> Column:
    return F.to_json(F.struct(
        F.lit(message_type).alias("messageType"),
        F.lit("000000000000").alias("owner"),
        group.alias("logGroup"), stream.alias("logStream"),
        F.array(F.lit("loglake")).alias("subscriptionFilters"),
        events_arr.alias("logEvents")))


def encode_envelopes(lg: DataFrame, with_faults: bool = True) -> DataFrame:
    """Delivery records (record_id, data) carrying every row of ``lg``.

    Envelopes hold at most EVENTS_PER_ENVELOPE events, so no group grows with
    a hot log group. With ``with_faults`` each stream sends one truncated payload
    and each log group one record of every kind in ``odd_records``.
    """
    chunk = F.floor(F.col("event_id") / EVENTS_PER_ENVELOPE)
    env = (lg.groupBy("log_group", "log_stream", chunk.alias("chunk"))
           .agg(F.array_sort(F.collect_list(F.struct(
               F.col("event_id").cast("string").alias("id"),
               F.col("epoch_ms").alias("timestamp"),
               F.col("message").alias("message")))).alias("events")))
    data = env.select(
        F.concat_ws(":", "log_group", "log_stream", F.col("chunk").cast("string")).alias("record_id"),
        gzip_base64(_envelope_json(F.col("log_group"), F.col("log_stream"), F.col("events"))).alias("data"))
    if not with_faults:
        return data
    truncated = (env.groupBy("log_group", "log_stream").agg(F.min("chunk").alias("chunk"))
                 .join(data.withColumnRenamed("record_id", "rid"),
                       F.col("rid") == F.concat_ws(":", "log_group", "log_stream",
                                                   F.col("chunk").cast("string")))
                 .select(F.concat_ws(":", F.lit("truncated"), "rid").alias("record_id"),
                         F.substring("data", 1, 40).alias("data")))
    return data.unionByName(truncated).unionByName(odd_records(lg))


def odd_records(lg: DataFrame) -> DataFrame:
    """Per log group, with t its first event time: a control message and an envelope
    without events (Dropped); text behind the envelope, two envelopes, single quotes and an
    array root (ProcessingFailed); missing fields, a timestamp with a fraction and zero
    padding behind the payload (Ok, one event each)."""
    first = lg.groupBy("log_group").agg(F.min("epoch_ms").alias("t"))
    group, stream = F.col("log_group"), F.lit("s")

    def event(message):
        return F.array(F.struct(F.lit("1").alias("id"), F.col("t").alias("timestamp"), F.lit(message).alias("message")))

    def envelope(message):
        return _envelope_json(group, stream, event(message))

    bad = envelope("bad")
    texts = {
        "control": _envelope_json(F.lit(""), F.lit(""), event("CONTROL MESSAGE: checking health of destination"),
                                  message_type="CONTROL_MESSAGE"),
        "empty": _envelope_json(group, stream, F.slice(event("x"), 1, 0)),
        "trailing": F.concat(bad, F.lit(" junk")),
        "twice": F.concat(bad, bad),
        "quotes": F.replace(bad, F.lit('"'), F.lit("'")),
        "array": F.concat(F.lit("["), bad, F.lit("]")),
        "missing": F.to_json(F.struct(F.lit(S.DATA_MESSAGE).alias("messageType"),
                                      F.array(F.struct(F.col("t").alias("timestamp"))).alias("logEvents"))),
        "fraction": F.regexp_replace(envelope("fraction"), r'"timestamp":(-?\d+)', '"timestamp":$1.0'),
        "padded": envelope("padded"),
    }
    each = first.select("log_group", F.explode(F.create_map(
        *[x for k, v in texts.items() for x in (F.lit(k), v)])).alias("kind", "text"))
    data = F.when(F.col("kind") == "padded", gzip_base64_padded("text")).otherwise(gzip_base64("text"))
    return each.select(F.concat_ws(":", "kind", "log_group").alias("record_id"), data.alias("data"))


# ---- materialised lakes ----------------------------------------------------

_CODE_HASH: list = []


def _code_hash() -> str:
    """Hash of the package source: derived data written by older code is
    never reused after the code that writes it changes."""
    if not _CODE_HASH:
        h = hashlib.sha1()
        root = os.path.dirname(os.path.abspath(__file__))
        for d, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    with open(os.path.join(d, f), "rb") as fh:
                        h.update(f.encode() + fh.read())
        _CODE_HASH.append(h.hexdigest()[:12])
    return _CODE_HASH[0]


def _fingerprint(spark: SparkSession, sf_dir: str, *names: str) -> str:
    root = sf_dir.rstrip("/")
    h = hashlib.sha1(f"{root}:{_code_hash()}".encode())
    for n in names:
        h.update(f"{n}:{path_status(spark, f'{root}/{n}.parquet')}".encode())
    return h.hexdigest()[:16]


def derived_path(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """Where an input derived from the tables is kept for later queries."""
    return scratch_path(spark, _fingerprint(spark, sf_dir, "events"), kind)


def result_path(spark: SparkSession, kind: str) -> str:
    """A new path for what a query under test writes: its work is never reused."""
    return scratch_path(spark, "results", f"{kind}-{uuid.uuid4().hex}")


def materialise(spark: SparkSession, path: str, build) -> str:
    """Run ``build(path)`` once; later calls reuse the written data.

    A finished write leaves ``_SUCCESS`` (or ``_LOGLAKE_DONE`` for writers
    without one), so an interrupted write is redone, never half-read.
    """
    marker = path.rstrip("/") + "/_LOGLAKE_DONE"
    with _lock_for(path):
        if path_exists(spark, marker):
            return path
        build(path)
        write_text(spark, marker, "done")
    return path


_LOCKS: dict = {}
_LOCKS_GUARD = threading.Lock()


def _lock_for(path: str) -> threading.Lock:
    """One lock per derived path: concurrent callers in one driver build it once."""
    with _LOCKS_GUARD:
        return _LOCKS.setdefault(path, threading.Lock())


def lake_path(spark: SparkSession, sf_dir: str, fmt: str = "parquet") -> str:
    """The ``logs`` lake of ``sf_dir`` in ``fmt``, written once per session
    scratch root and reused."""
    from loglake.sources.lake import write_logs

    path = derived_path(spark, sf_dir, f"lake_{fmt}")
    return materialise(spark, path,
                       lambda p: write_logs(logs(spark, sf_dir), p, fmt, mode="overwrite"))


def lake(spark: SparkSession, sf_dir: str, fmt: str = "parquet") -> DataFrame:
    from loglake.sources.lake import read_logs

    ensure_utc(spark)
    return read_logs(spark, lake_path(spark, sf_dir, fmt), fmt)


def envelopes_path(spark: SparkSession, sf_dir: str, fmt: str = "json") -> str:
    """Delivery records for every event of ``sf_dir`` (plus the derived
    control and truncated records), written once."""
    from loglake.sources.envelopes import write_envelopes

    def build(path):
        # Envelope texts go to Python in Arrow batches; they are bounded by bytes, not only by rows.
        with scoped_conf(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}):
            write_envelopes(encode_envelopes(logs(spark, sf_dir)), path, fmt)

    return materialise(spark, derived_path(spark, sf_dir, f"envelopes_{fmt}"), build)


def bare_lake_path(spark: SparkSession, sf_dir: str) -> str:
    from loglake.sources.lake import write_bare_layout

    path = derived_path(spark, sf_dir, "lake_bare")
    return materialise(spark, path, lambda p: write_bare_layout(logs(spark, sf_dir), p))
