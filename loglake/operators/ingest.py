"""Ingest transform: delivery records -> log rows.

records(record_id, data) -> decode (base64, gunzip, UTF-8) -> parse the
envelope -> disposition per record (Ok / Dropped / ProcessingFailed) ->
explode events -> map the log group to a domain -> log rows with event-time
partition keys. Everything except gunzip is JVM-side; nothing is grouped or
shuffled: each record is handled where it is read, and the one join, with the
connections table, is a broadcast as long as Spark knows that table to be small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake import schema as S
from loglake.functions.codec import gunzip_json
from loglake.functions.time import MAX_EPOCH_MS, MIN_EPOCH_MS, iso_text
from loglake.operators.connections import mapping_lifetimes, unique_connections
from loglake.operators.versions import is_history

_JSON_OPTS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": S.CORRUPT,
              "allowSingleQuotes": "false", "allowUnquotedControlChars": "false"}


def parse_records(records: DataFrame) -> DataFrame:
    """Add ``payload`` (decoded text), ``env`` (parsed envelope),
    ``disposition`` and ``reason`` to each delivery record.

    Order of tests follows the per-record handler: undecodable -> failed;
    a known non-data message type -> dropped even if the rest is broken;
    unparsable JSON -> failed; missing type or no events -> dropped; any
    event without a usable timestamp fails the whole envelope (no partial
    output for one record).
    """
    binary = F.try_to_binary(F.col("data"), F.lit("base64"))
    df = records.select("*", binary.alias("_bin"))
    df = df.select("*", gunzip_json(F.col("_bin")).alias("_g"))
    df = df.select("*", F.col("_g.text").alias("payload"),
                   F.from_json(F.when(F.col("_g.is_object"), F.col("_g.text")), S.ENVELOPE, _JSON_OPTS).alias("env"))
    mt = F.col("env.messageType")
    events = F.coalesce(F.col("env.logEvents"), F.array())
    bad_event = F.exists(events, lambda e: e.isNull() | e["timestamp"].isNull()
                         | (e["timestamp"] < F.lit(MIN_EPOCH_MS))
                         | (e["timestamp"] > F.lit(MAX_EPOCH_MS)))
    # A known non-data type is dropped before its events are looked at; the
    # payload is known to be one JSON object by then.
    other_type = mt.isNotNull() & (mt != S.DATA_MESSAGE)
    not_json = ~F.coalesce(F.col("_g.is_object"), F.lit(False))
    not_envelope = F.col("env").isNull() | F.col(f"env.{S.CORRUPT}").isNotNull()
    cases = [
        (F.col("_bin").isNull(), S.FAILED, F.lit("not base64")),
        (F.col("payload").isNull(), S.FAILED, F.lit("not gzip or not UTF-8")),
        (not_json, S.FAILED, F.lit("not JSON")),
        (other_type, S.DROPPED, F.concat(F.lit("message type "), mt)),
        (not_envelope, S.FAILED, F.lit("not JSON")),
        (mt.isNull(), S.DROPPED, F.lit("no message type")),
        (F.size(events) == 0, S.DROPPED, F.lit("no log events")),
        (bad_event, S.FAILED, F.lit("event without a valid timestamp"))]
    disposition, reason = F, F
    for cond, outcome, why in cases:
        disposition, reason = disposition.when(cond, F.lit(outcome)), reason.when(cond, why)
    disposition = disposition.otherwise(F.lit(S.OK))
    return df.select(*[c for c in records.columns], "payload", "env",
                     disposition.alias("disposition"), reason.alias("reason"))


def rows_where(df: DataFrame, cond, cols: list) -> DataFrame:
    """``df.where(cond).select(cols)`` without a Filter node.

    On decoded records a Filter is pushed below the projection that runs
    gunzip and from_json and makes Spark evaluate both twice; a generator
    of zero or one row per record keeps a single evaluation.
    """
    packed = F.when(cond, F.array(F.struct(*[F.col(c) for c in cols])))
    return df.select(F.explode(packed).alias("_r")).select("_r.*")


def explode_events(parsed: DataFrame) -> DataFrame:
    """One row per event of every Ok record. Missing group, stream or
    message become ``""``; the event id is dropped.

    Non-Ok records explode a null array (no rows) instead of being filtered:
    a Filter on the disposition would be pushed below the decode projection
    and make Spark run gunzip and from_json twice per record.
    """
    ok_events = F.when(F.col("disposition") == S.OK, F.col("env.logEvents"))
    ev = parsed.select("record_id",
                       F.coalesce(F.col("env.logGroup"), F.lit("")).alias("log_group"),
                       F.coalesce(F.col("env.logStream"), F.lit("")).alias("log_stream"),
                       F.explode(ok_events).alias("e"))
    return ev.select("record_id", "log_group", "log_stream",
                     F.col("e.timestamp").cast("long").alias("epoch_ms"),
                     F.coalesce(F.col("e.message"), F.lit("")).alias("message"))


def map_domain(rows: DataFrame, connections: DataFrame) -> DataFrame:
    """Left lookup of ``log_group`` in the connections table; unmapped
    (and null) groups get ``unknown``. Of several domains for a group the smallest
    counts. Spark broadcasts the table when its size is small.

    A history of connections is joined as of each event's own time (``epoch_ms``):
    the lifetimes of a group's mappings do not overlap, so an event meets one at most.
    """
    if is_history(connections):
        held = mapping_lifetimes(connections).withColumnsRenamed({"domain": "_domain", "log_group": "_group"})
        micros = F.col("epoch_ms") * 1000
        on = (F.col("log_group") == F.col("_group")) & (micros >= F.col("r_from")) & (micros < F.col("r_to"))
        out = rows.join(held, on, "left").drop("_group", "r_from", "r_to")
    else:
        conn = connections.groupBy("log_group").agg(F.min("domain").alias("_domain"))
        out = rows.join(conn, "log_group", "left")
    return out.withColumn("domain", F.coalesce(F.col("_domain"), F.lit(S.UNKNOWN_DOMAIN))) \
              .drop("_domain")


def to_log_rows(mapped: DataFrame) -> DataFrame:
    """Shape mapped events as ``logs`` table rows (event-time partitions).
    Level, service and trace id are not in the envelope: null."""
    ts = F.timestamp_millis(F.col("epoch_ms"))
    none = F.lit(None).cast("string")
    return mapped.select(
        ts.alias("timestamp"), none.alias("level"), none.alias("service"),
        F.col("message"), none.alias("trace_id"), "log_group", "log_stream", "domain",
        F.date_format(ts, "yyyy").alias("year"), F.date_format(ts, "MM").alias("month"),
        F.date_format(ts, "dd").alias("day"))


def transform(records: DataFrame, connections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delivery records -> (log rows, parsed records with dispositions)."""
    parsed = parse_records(records)
    rows = to_log_rows(map_domain(explode_events(parsed), connections))
    return rows, parsed


def disposition_counts(parsed: DataFrame) -> DataFrame:
    """Output records per disposition: one per event when Ok, one per
    delivery record otherwise."""
    n = F.when(F.col("disposition") == S.OK, F.size("env.logEvents")).otherwise(F.lit(1))
    return parsed.groupBy("disposition").agg(F.sum(n).cast("long").alias("records"))


def disposition_metrics() -> list:
    """The same counts as metrics of a pass over parsed records, one column a disposition."""
    n = F.when(F.col("disposition") == S.OK, F.size("env.logEvents")).otherwise(F.lit(1))
    return [F.sum(F.when(F.col("disposition") == d, n)).cast("long").alias(d) for d in (S.OK, S.DROPPED, S.FAILED)]


def to_json_line(rows: DataFrame) -> DataFrame:
    """The transformed record as one JSON line (non-ASCII kept as is)."""
    return rows.select(F.to_json(F.struct(
        "domain", "log_group", "log_stream", iso_text(F.col("timestamp")).alias("timestamp"),
        "message")).alias("value"))


def subscription_filter(events: DataFrame, connections: DataFrame) -> DataFrame:
    """Events a subscription delivers: only connected groups, and only
    messages containing the group's pattern (``""`` keeps all). The domain
    is the connection's."""
    conn = unique_connections(connections).select(
        "log_group", F.coalesce("filter_pattern", F.lit("")).alias("filter_pattern"),
        F.col("domain").alias("_domain"))
    j = events.join(conn, "log_group", "inner")
    keep = (F.col("filter_pattern") == "") | F.contains(F.col("message"), F.col("filter_pattern"))
    return j.where(keep).drop("domain", "filter_pattern").withColumnRenamed("_domain", "domain")
