"""Schemas of every loglake table. Nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: table layout -------------------------------------------
# Data columns of the ``logs`` table and its partition keys, in table order.
DATA_COLUMNS = ["timestamp", "level", "service", "message", "trace_id",
                "log_group", "log_stream"]
PARTITION_COLUMNS = ["domain", "year", "month", "day"]
TABLE_COLUMNS = DATA_COLUMNS + PARTITION_COLUMNS
# The last directory level of the lake: which write a file belongs to.
INGEST_KEY = "ingest_key"
LAYOUT_COLUMNS = PARTITION_COLUMNS + [INGEST_KEY]
# Prefix the delivery stream gives to its failures in the bare layout.
ERRORS_PREFIX = "errors"

# Text form of a timestamp everywhere: millisecond ISO-8601 in UTC.
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"

# Dispositions of one delivery record.
OK, DROPPED, FAILED = "Ok", "Dropped", "ProcessingFailed"
DATA_MESSAGE = "DATA_MESSAGE"
UNKNOWN_DOMAIN = "unknown"
CORRUPT = "_corrupt_record"

# Price of the hosted SQL service: USD 5 per TiB scanned.
USD_PER_BYTE = 5.0 / (1024.0 ** 4)
BYTES_PER_MB = 1024.0 * 1024.0

# Result cache lifetime in seconds.
CACHE_TTL_SECONDS = 300
# Bytes of results that one session keeps at most.
CACHE_MAX_BYTES = 256 << 20
# Characters of SQL shown per line of the cost report (longer ones get "...").
SQL_PREVIEW_CHARS = 50
# Delivery buffer: flush every 300 s (the streaming trigger interval).
FLUSH_SECONDS = 300
# Delivery buffer: files of at least this size (MB).
TARGET_FILE_MB = 64
# Default retention when a caller asks for the default (days).
DEFAULT_RETENTION_DAYS = 90
# ---------------------------------------------------------------------------

_s = T.StringType()

LOG_EVENT = T.StructType([
    T.StructField("id", _s),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("message", _s),
])

ENVELOPE = T.StructType([
    T.StructField("messageType", _s),
    T.StructField("owner", _s),
    T.StructField("logGroup", _s),
    T.StructField("logStream", _s),
    T.StructField("subscriptionFilters", T.ArrayType(_s)),
    T.StructField("logEvents", T.ArrayType(LOG_EVENT)),
    T.StructField(CORRUPT, _s),
])

DELIVERY_RECORD = T.StructType([
    T.StructField("record_id", _s),
    T.StructField("data", _s),
])

PARTITION_FIELDS = [T.StructField(c, _s) for c in LAYOUT_COLUMNS]

# Parquet lake: real timestamp (row-group min/max prune time predicates).
LOGS_PARQUET = T.StructType(
    [T.StructField("timestamp", T.TimestampType())]
    + [T.StructField(c, _s) for c in DATA_COLUMNS[1:]]
    + PARTITION_FIELDS)

# JSON lake: the timestamp arrives as text and is cast after the read, so
# both "...Z" and "...+00:00" forms parse; broken lines land in CORRUPT.
LOGS_JSON = T.StructType(
    [T.StructField(c, _s) for c in DATA_COLUMNS]
    + [T.StructField(CORRUPT, _s)]
    + PARTITION_FIELDS)

RULES = T.StructType([
    T.StructField("name", _s),
    T.StructField("domain", _s),
    T.StructField("level", _s),
    T.StructField("keyword", _s),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("period_minutes", T.DoubleType()),
])

CONNECTIONS = T.StructType([
    T.StructField("log_group", _s),
    T.StructField("filter_pattern", _s),
    T.StructField("domain", _s),
])

DOMAINS = T.StructType([
    T.StructField("name", _s),
    T.StructField("prefix", _s),
])

HISTORY = T.StructType([
    T.StructField("n", T.LongType()),
    T.StructField("sql", _s),
    T.StructField("scanned_bytes", T.LongType()),
    T.StructField("cost", T.DoubleType()),
    T.StructField("timestamp", _s),
])
