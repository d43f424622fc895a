"""Registry of named queries (Spark) and their DuckDB oracle SQL.

Each Spark callable takes ``(spark, sf_dir)``; each oracle is ANSI SQL over
the raw ``events`` view with the same ``logs`` projection as a CTE. Column
names match one to one.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake import fixtures as FX
from loglake import schema as S
from loglake.operators import alerts as AL
from loglake.operators import connections as CN
from loglake.operators import cost as CO
from loglake.operators import ingest as I
from loglake.operators import queries as Q
from loglake.operators import retention as RT
from loglake.sources import files as FL
from loglake.sources import lake as L
from loglake.sources import tables as TB
from loglake.sources.envelopes import read_envelopes
from loglake.streaming import alerts as SA
from loglake.streaming import ingest as SI

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# ---- the logs projection in DuckDB ------------------------------------------

def _case(expr: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {arms} END"


_LEVEL_CASE = "CASE event_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in FX.LEVEL_OF_EVENT_TYPE.items()) + " END"

LOGS_CTE = f"""logs AS (
  SELECT event_id,
    date_trunc('milliseconds', ts) AS ts_ms,
    strftime(date_trunc('milliseconds', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS "timestamp",
    {_LEVEL_CASE} AS level,
    CASE WHEN event_id % 2 = 0 THEN 'api' ELSE 'worker' END AS service,
    event_type || ' --- ' || props AS message,
    md5(CAST(event_id AS VARCHAR)) AS trace_id,
    {_case('user_id % 6', FX.LOG_GROUP_OF_USER_MOD)} AS log_group,
    'stream-' || CAST(user_id % 4 AS VARCHAR) AS log_stream,
    {_case('user_id % 6', FX.DOMAIN_OF_USER_MOD)} AS domain,
    strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day,
    epoch_us(ts) // 1000 AS epoch_ms
  FROM events)"""

TABLE_SELECT = ('"timestamp", level, service, message, trace_id, log_group, log_stream, '
                'domain, year, month, day')

AS_OF = FX.AS_OF
AS_OF_TS = f"TIMESTAMP '{AS_OF}'"
YESTERDAY = (_dt.date.fromisoformat(AS_OF[:10]) - _dt.timedelta(days=1)).isoformat()


def with_logs(sql: str) -> str:
    return f"WITH {LOGS_CTE}\n{sql}"


def parquet_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.lake(spark, sf_dir, "parquet")


# ---- C: log queries ------------------------------------------------------------

@register("count_by_domain", with_logs(
    "SELECT domain, count(*) AS cnt FROM logs GROUP BY domain ORDER BY cnt DESC, domain"))
def _count_by_domain(spark, sf_dir):
    return Q.count_by_domain(parquet_lake(spark, sf_dir))


@register("domain_sample", with_logs(
    """SELECT "timestamp", level, service, message FROM logs WHERE domain = 'user'
       ORDER BY ts_ms, trace_id LIMIT 5"""))
def _domain_sample(spark, sf_dir):
    return Q.domain_sample(parquet_lake(spark, sf_dir), "user", 5)


@register("count_by_level", with_logs(
    """SELECT domain, level, count(*) AS cnt FROM logs WHERE domain = 'payment'
       GROUP BY domain, level ORDER BY cnt DESC, level"""))
def _count_by_level(spark, sf_dir):
    return Q.count_by_level(parquet_lake(spark, sf_dir), "payment")


@register("month_total", with_logs(
    "SELECT count(*) AS total FROM logs WHERE domain = 'order' AND year = '2024' AND month = '01'"))
def _month_total(spark, sf_dir):
    return Q.month_total(parquet_lake(spark, sf_dir), "order", "2024", "01")


@register("day_levels", with_logs(
    """SELECT level, count(*) AS cnt FROM logs WHERE year = '2024' AND month = '01' AND day = '15'
       GROUP BY level ORDER BY cnt DESC, level"""))
def _day_levels(spark, sf_dir):
    return Q.day_levels(parquet_lake(spark, sf_dir), "2024-01-15")


@register("domain_rows", with_logs(
    f"""SELECT {TABLE_SELECT} FROM logs WHERE domain = 'user' AND year = '2024' AND month = '01'
        ORDER BY ts_ms, trace_id LIMIT 10"""))
def _domain_rows(spark, sf_dir):
    return Q.domain_rows(parquet_lake(spark, sf_dir), "user", "2024", "01", 10)


@register("errors_on_day", with_logs(
    f"""SELECT count(*) AS errors FROM logs WHERE domain = 'payment' AND level = 'ERROR'
        AND year = '{YESTERDAY[:4]}' AND month = '{YESTERDAY[5:7]}' AND day = '{YESTERDAY[8:]}'"""))
def _errors_on_day(spark, sf_dir):
    return Q.errors_on_day(parquet_lake(spark, sf_dir), "payment", YESTERDAY)


@register("top_errors", with_logs(
    f"""SELECT message, count(*) AS cnt FROM logs
        WHERE domain = 'user' AND level = 'ERROR' AND ts_ms >= {AS_OF_TS} - INTERVAL 3 DAY
        GROUP BY message ORDER BY cnt DESC, message LIMIT 5"""))
def _top_errors(spark, sf_dir):
    return Q.top_messages(parquet_lake(spark, sf_dir), "user", AS_OF, days=3, k=5)


@register("domain_day", with_logs(
    f"""SELECT {TABLE_SELECT} FROM logs WHERE domain = 'order'
        AND year = '2024' AND month = '01' AND day = '28'"""))
def _domain_day(spark, sf_dir):
    return Q.domain_day(parquet_lake(spark, sf_dir), "order", "2024-01-28")


@register("keyword_search", with_logs(
    f"""SELECT {TABLE_SELECT} FROM logs WHERE contains(message, 'k": 7')"""))
def _keyword_search(spark, sf_dir):
    return Q.keyword_search(parquet_lake(spark, sf_dir), 'k": 7', "contains")


@register("keyword_like", with_logs(
    f"""SELECT {TABLE_SELECT} FROM logs WHERE message LIKE '%' || 'k": 1_}}' || '%'"""))
def _keyword_like(spark, sf_dir):
    return Q.keyword_search(parquet_lake(spark, sf_dir), 'k": 1_}', "like")


@register("recent_logs", with_logs(
    f"""SELECT {TABLE_SELECT} FROM logs WHERE ts_ms >= {AS_OF_TS} - INTERVAL 1440 MINUTE"""))
def _recent_logs(spark, sf_dir):
    return Q.recent_logs(parquet_lake(spark, sf_dir), AS_OF, 1440)


# ---- A / B: lake and ingest ----------------------------------------------------


def _conn_values() -> str:
    rows = []
    for g, d in zip(FX.LOG_GROUP_OF_USER_MOD, FX.DOMAIN_OF_USER_MOD):
        if d != "unknown":
            p = FX.FILTER_PATTERN_OF_GROUP[g].replace("'", "''")
            rows.append(f"('{g}', '{p}', '{d}')")
    return "(VALUES " + ", ".join(rows) + ") AS c(log_group, filter_pattern, domain)"


def _decoded(spark, sf_dir):
    from loglake.session import ensure_utc

    ensure_utc(spark)
    records = read_envelopes(spark, FX.envelopes_path(spark, sf_dir), "json")
    return I.transform(records, FX.connections(spark))


INGEST_COLS = "domain, log_group, log_stream, \"timestamp\", message"
# Rows the envelope files hold: all logs and the odd but valid records (FX.odd_records).
_T = "make_timestamp(t * 1000)"
_ODD = f"""strftime({_T}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS "timestamp", message,
           strftime({_T}, '%Y') AS year, strftime({_T}, '%m') AS month, strftime({_T}, '%d') AS day"""
INGEST_CTE = f"""first AS (SELECT log_group, domain, min(epoch_ms) AS t FROM logs GROUP BY log_group, domain),
ingested AS (
  SELECT domain, log_group, log_stream, "timestamp", message, year, month, day FROM logs
  UNION ALL SELECT 'unknown', '', '', {_ODD} FROM first, (SELECT '' AS message)
  UNION ALL SELECT domain, log_group, 's', {_ODD} FROM first, (VALUES ('fraction'), ('padded')) AS v(message))"""


def with_ingested(sql: str) -> str:
    return f"WITH {LOGS_CTE},\n{INGEST_CTE}\n{sql}"


@register("decode_envelopes", with_ingested(f"SELECT {INGEST_COLS} FROM ingested"))
def _decode_envelopes(spark, sf_dir):
    rows, _ = _decoded(spark, sf_dir)
    return Q.display(rows.select("domain", "log_group", "log_stream", "timestamp", "message"))


DISPOSITION_SQL = """
    SELECT 'Ok' AS disposition, count(*) AS records FROM ingested
    UNION ALL SELECT 'Dropped', 2 * count(*) FROM first
    UNION ALL SELECT 'ProcessingFailed', (SELECT count(*) FROM (SELECT DISTINCT log_group, log_stream FROM logs))
                                         + 4 * (SELECT count(*) FROM first)"""


@register("disposition_counts", with_ingested(DISPOSITION_SQL))
def _disposition_counts(spark, sf_dir):
    _, parsed = _decoded(spark, sf_dir)
    return I.disposition_counts(parsed)


@register("derive_partitions", with_ingested(
    "SELECT domain, log_group, message, year, month, day FROM ingested"))
def _derive_partitions(spark, sf_dir):
    rows, _ = _decoded(spark, sf_dir)
    return rows.select("domain", "log_group", "message", "year", "month", "day")


@register("to_json_line", with_ingested(
    """SELECT CAST(json_object('domain', domain, 'log_group', log_group, 'log_stream', log_stream,
                           'timestamp', "timestamp", 'message', message) AS VARCHAR) AS value
       FROM ingested"""))
def _to_json_line(spark, sf_dir):
    rows, _ = _decoded(spark, sf_dir)
    return I.to_json_line(rows)


@register("map_domain", with_logs(
    f"""SELECT trace_id, l.log_group, coalesce(c.domain, 'unknown') AS domain
        FROM logs l LEFT JOIN {_conn_values()} ON l.log_group = c.log_group"""))
def _map_domain(spark, sf_dir):
    lg = FX.logs(spark, sf_dir).select("trace_id", "log_group")
    return I.map_domain(lg, FX.connections(spark))


_REMAPPED = [("/ecs/user-api", "auth", "2024-01-10 12:00:00"), ("/ecs/user-api", "order", "2024-01-20 00:00:00"),
             ("/ecs/unmapped", "payment", "2024-01-05 06:00:00")]
_DISCONNECTED = ("/ecs/auth-service", "auth", "2024-01-15 00:00:00")


def _connection_history(spark):
    history = CN.connection_history(FX.connections(spark))
    for group, domain, at in _REMAPPED:
        history = CN.changed_connections(history, spark.createDataFrame([(group, "", domain)], S.CONNECTIONS), at)
    gone = spark.createDataFrame([_DISCONNECTED[:2]], "log_group string, domain string")
    return CN.removed_connections(history, gone, _DISCONNECTED[2])


def _mapped_sql(ts: str) -> str:
    """The domain a group has at a time (ISO text), from the same changes."""
    iso = lambda at: at.replace(" ", "T") + ".000Z"
    arms = [f"WHEN log_group = '{g}' AND {ts} >= '{iso(at)}' THEN '{d}'" for g, d, at in reversed(_REMAPPED)]
    g, _, at = _DISCONNECTED
    arms.append(f"WHEN log_group = '{g}' AND {ts} >= '{iso(at)}' THEN 'unknown'")
    arms += [f"WHEN log_group = '{g}' THEN '{d}'" for g, d in zip(FX.LOG_GROUP_OF_USER_MOD, FX.DOMAIN_OF_USER_MOD)]
    return f"CASE {' '.join(arms)} ELSE 'unknown' END"


_MAPPED = _mapped_sql('"timestamp"')


@register("map_domain_history", with_logs(f'SELECT trace_id, log_group, {_MAPPED} AS domain FROM logs'))
def _map_domain_history(spark, sf_dir):
    """A group mapped twice anew, one connected late and one disconnected: each event as of its time."""
    return I.map_domain(FX.logs(spark, sf_dir).select("trace_id", "log_group", "epoch_ms"), _connection_history(spark)).select(
        "trace_id", "log_group", "domain")


@register("stream_ingest_history", with_ingested(
    f"""SELECT domain, year, month, day, count(*) AS cnt FROM (SELECT {_MAPPED} AS domain, year, month, day FROM ingested)
        GROUP BY domain, year, month, day"""))
def _stream_ingest_history(spark, sf_dir):
    """The stream under a history of connections; its first batch is replayed at the end."""
    from loglake.session import ensure_utc

    ensure_utc(spark)
    base, src = FX.result_path(spark, "stream_history"), FX.envelopes_path(spark, sf_dir)
    history = _connection_history(spark)
    q = SI.start_ingest(spark, src, base + "/lake", base + "/_checkpoint", lambda: history, trigger={"availableNow": True}, stream="s")
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    SI.ingest_batch(read_envelopes(spark, src, "json"), 0, lambda: FX.connections(spark), base + "/lake", None, stream="s",
                    state_path=base + "/_checkpoint-state")
    return L.read_logs(spark, base + "/lake").groupBy(*S.PARTITION_COLUMNS).agg(F.count(F.lit(1)).alias("cnt"))


@register("epoch_to_iso", with_logs('SELECT trace_id, epoch_ms, "timestamp" FROM logs'))
def _epoch_to_iso(spark, sf_dir):
    lg = FX.logs(spark, sf_dir)
    from loglake.functions.time import iso_text

    return lg.select("trace_id", "epoch_ms",
                     iso_text(F.timestamp_millis("epoch_ms")).alias("timestamp"))


@register("subscription_filter", with_logs(
    f"""SELECT trace_id, l.log_group, c.domain, message
        FROM logs l JOIN {_conn_values()} ON l.log_group = c.log_group
        WHERE c.filter_pattern = '' OR contains(message, c.filter_pattern)"""))
def _subscription_filter(spark, sf_dir):
    lg = FX.logs(spark, sf_dir).select("trace_id", "log_group", "domain", "message")
    return I.subscription_filter(lg, FX.connections(spark)).select(
        "trace_id", "log_group", "domain", "message")


def _full_table(df):
    return Q.display(df.select(*S.TABLE_COLUMNS))


@register("scan_parquet", with_logs(f"SELECT {TABLE_SELECT} FROM logs"))
def _scan_parquet(spark, sf_dir):
    return _full_table(FX.lake(spark, sf_dir, "parquet"))


@register("scan_json", with_logs(f"SELECT {TABLE_SELECT} FROM logs"))
def _scan_json(spark, sf_dir):
    FX.lake(spark, sf_dir, "json")
    return _full_table(L.read_logs(spark, FX.lake_path(spark, sf_dir, "json"), "json", case_insensitive=False))


@register("scan_json_any_case", with_logs(f"SELECT {TABLE_SELECT} FROM logs"))
def _scan_json_any_case(spark, sf_dir):
    FX.lake(spark, sf_dir, "json")
    return _full_table(L.read_logs(spark, FX.lake_path(spark, sf_dir, "json"), "json",
                                   case_insensitive=True))


@register("scan_bare_layout", with_logs(f"SELECT {TABLE_SELECT} FROM logs"))
def _scan_bare_layout(spark, sf_dir):
    from loglake.session import ensure_utc

    ensure_utc(spark)
    return _full_table(L.read_bare_layout(spark, FX.bare_lake_path(spark, sf_dir), "json"))


@register("scan_bare_layout_pruned", with_logs(
    f"""SELECT {TABLE_SELECT} FROM logs WHERE domain IN ('payment', 'auth')
        AND year || '-' || month || '-' || day BETWEEN '2024-01-10' AND '2024-01-20'"""))
def _scan_bare_layout_pruned(spark, sf_dir):
    from loglake.session import ensure_utc

    ensure_utc(spark)
    return _full_table(L.read_bare_layout(spark, FX.bare_lake_path(spark, sf_dir), "json",
                                          ["payment", "auth"], ("2024-01-10", "2024-01-20")))


@register("scan_days", with_logs(
    f"""SELECT {TABLE_SELECT} FROM logs WHERE domain IN ('payment', 'auth')
        AND year || '-' || month || '-' || day BETWEEN '2024-01-10' AND '2024-01-20'"""))
def _scan_days(spark, sf_dir):
    """Folders worked out from domains and dates; nothing else of the lake is listed."""
    FX.lake(spark, sf_dir, "json")
    return _full_table(L.read_logs(spark, FX.lake_path(spark, sf_dir, "json"), "json", domains=["payment", "auth", "none"],
                                   dates=("2024-01-10", "2024-01-20")))


def _roundtrip(spark, sf_dir, fmt):
    rows, _ = _decoded(spark, sf_dir)
    path = FX.result_path(spark, f"ingested_{fmt}")
    L.write_logs(rows, path, fmt, mode="overwrite")
    back = L.read_logs(spark, path, fmt)
    return Q.display(back.select("domain", "log_group", "log_stream", "timestamp", "message",
                                 "year", "month", "day"))


_RT_SQL = with_ingested(f"SELECT {INGEST_COLS}, year, month, day FROM ingested")


@register("roundtrip_json", _RT_SQL)
def _roundtrip_json(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "json")


@register("roundtrip_parquet", _RT_SQL)
def _roundtrip_parquet(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "parquet")


_REGISTERED = ", ".join(f"'{d}'" for d in FX.DOMAINS)


@register("registered_domains", with_logs(
    f"SELECT domain, count(*) AS cnt FROM logs WHERE domain IN ({_REGISTERED}) GROUP BY domain"))
def _registered_domains(spark, sf_dir):
    return Q.count_by_domain(L.registered_only(parquet_lake(spark, sf_dir), FX.DOMAINS))


@register("partition_rows", with_logs(
    "SELECT domain, year, month, day, count(*) AS rows FROM logs GROUP BY domain, year, month, day"))
def _partition_rows(spark, sf_dir):
    return parquet_lake(spark, sf_dir).groupBy(*S.PARTITION_COLUMNS).agg(
        F.count(F.lit(1)).alias("rows"))


@register("partition_inventory", with_logs(
    """SELECT domain, year, month, day, count(*) AS rows, true AS has_files
       FROM logs GROUP BY domain, year, month, day"""))
def _partition_inventory(spark, sf_dir):
    """The file listing next to the rows; a test checks files and bytes by a walk."""
    found = FL.partition_inventory(spark, FX.lake_path(spark, sf_dir, "parquet"), "parquet")
    return _partition_rows(spark, sf_dir).join(found, list(S.PARTITION_COLUMNS), "full").select(
        *S.PARTITION_COLUMNS, "rows", ((F.col("files") > 0) & (F.col("bytes") > 0)).alias("has_files"))


@register("sql_passthrough", with_logs(
    """SELECT level, count(*) AS cnt FROM logs WHERE year = '2024' AND month = '01' AND day = '28'
       GROUP BY level"""))
def _sql_passthrough(spark, sf_dir):
    from loglake.operators.sql import run_sql

    return run_sql(spark, parquet_lake(spark, sf_dir),
                   "SELECT level, count(*) AS cnt FROM logs WHERE year = :y AND month = :m "
                   "AND day = :d GROUP BY level", {"y": "2024", "m": "01", "d": "28"})


# ---- E: alerts, F: connections ---------------------------------------------------


def _sql_str(v) -> str:
    if v is None:
        return "CAST(NULL AS VARCHAR)"
    return "'" + str(v).replace("'", "''") + "'"


def _sql_num(v) -> str:
    return "CAST(NULL AS DOUBLE)" if v is None else f"CAST('{float(v)!r}' AS DOUBLE)"


_BASE_RULES_SQL = "SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join([_sql_str(n), _sql_str(d), _sql_str(lv), _sql_str(k), _sql_num(t), _sql_num(p)]) + ")"
    for n, d, lv, k, t, p in FX.BASE_RULES) + \
    ") AS r(name, domain, level, keyword, threshold, period_minutes)"

RULES_CTE = f"""base_rules AS ({_BASE_RULES_SQL}),
derived_rules AS (
  SELECT domain || '-' || lower(level) || '-daily' AS name, domain, level,
         CAST(NULL AS VARCHAR) AS keyword, CAST(50.0 AS DOUBLE) AS threshold,
         CAST(1440.0 AS DOUBLE) AS period_minutes
  FROM (SELECT DISTINCT domain, level FROM logs WHERE level IS NOT NULL)),
rules AS (
  SELECT * FROM (
    SELECT * FROM base_rules WHERE name NOT IN (SELECT name FROM derived_rules)
    UNION ALL SELECT * FROM derived_rules)
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY domain, level NULLS FIRST, keyword NULLS FIRST, threshold, period_minutes) = 1),
checked AS (
  SELECT *, CASE
    WHEN name IS NULL OR name = '' THEN 'name is required'
    WHEN domain IS NULL OR domain = '' THEN 'domain is required'
    WHEN threshold IS NULL OR threshold < 0 THEN 'threshold must be a number >= 0'
    WHEN period_minutes IS NULL OR isnan(period_minutes) OR period_minutes * 60000 < 1 THEN 'period_minutes must be a number > 0'
    WHEN period_minutes > 5256000.0 THEN 'period_minutes must be at most ten years'
  END AS error FROM rules),
hits AS (
  SELECT r.name, count(*) AS cnt FROM logs l JOIN checked r
    ON r.error IS NULL AND l.domain = r.domain
   AND (NULLIF(trim(r.level), '') IS NULL OR l.level = r.level)
   AND (NULLIF(trim(r.keyword), '') IS NULL OR contains(l.message, r.keyword))
   AND l.ts_ms >= {AS_OF_TS} - to_microseconds(TRY_CAST(r.period_minutes * 60000000 AS BIGINT))
  GROUP BY r.name),
status AS (
  SELECT r.name, r.domain, r.level, r.keyword, r.threshold, r.period_minutes,
         coalesce(h.cnt, 0) AS cnt,
         CASE WHEN r.error IS NOT NULL THEN 'ERROR'
              WHEN coalesce(h.cnt, 0) > r.threshold THEN 'EXCEEDED' ELSE 'OK' END AS status,
         r.error
  FROM checked r LEFT JOIN hits h ON r.name = h.name)"""


def with_rules(sql: str) -> str:
    return f"WITH {LOGS_CTE},\n{RULES_CTE}\n{sql}"


def _rules(spark, sf_dir):
    return AL.upsert_rules(FX.base_rules(spark), FX.derived_rules(FX.logs(spark, sf_dir)))


def _status(spark, sf_dir):
    return AL.alert_status(parquet_lake(spark, sf_dir), _rules(spark, sf_dir), AS_OF)


@register("rule_counts", with_rules("SELECT name, cnt FROM status"))
def _rule_counts(spark, sf_dir):
    return AL.rule_counts(parquet_lake(spark, sf_dir), _rules(spark, sf_dir), AS_OF)


@register("rule_counts_like", with_rules("SELECT name, cnt FROM status").replace(
    "contains(l.message, r.keyword)", "l.message LIKE '%' || r.keyword || '%'"))
def _rule_counts_like(spark, sf_dir):
    return AL.rule_counts(parquet_lake(spark, sf_dir), _rules(spark, sf_dir), AS_OF,
                          keyword_mode="like")


_KEYWORD_RULES = """SELECT DISTINCT domain || ' ' || word AS name, domain, word AS keyword,
         CAST(500 AS DOUBLE) AS threshold, CAST(20160.0 AS DOUBLE) AS period_minutes
       FROM (SELECT domain, unnest([message, substr(message, -8), substr(message, -3), substr(message, 1, 2)]) AS word FROM logs)"""


@register("rule_counts_keywords", with_logs(
    f"""SELECT name, count(message) AS cnt FROM ({_KEYWORD_RULES}) r LEFT JOIN logs l
          ON l.domain = r.domain AND contains(l.message, r.keyword) AND l.ts_ms >= {AS_OF_TS} - INTERVAL 14 DAY
        GROUP BY name"""))
def _rule_counts_keywords(spark, sf_dir):
    """Keyword rules taken from the logs themselves, hundreds in one domain: whole messages and short pieces."""
    lg = parquet_lake(spark, sf_dir)
    pieces = F.array("message", F.substring("message", -8, 8), F.substring("message", -3, 3), F.substring("message", 1, 2))
    words = lg.select("domain", F.explode(pieces).alias("keyword")).distinct()
    rules = words.select(F.concat_ws(" ", "domain", "keyword").alias("name"), "domain", F.lit(None).cast("string").alias("level"),
                         "keyword", F.lit(500.0).alias("threshold"), F.lit(20160.0).alias("period_minutes"))
    return AL.rule_counts(lg, rules, AS_OF)


@register("alert_status", with_rules("SELECT * FROM status"))
def _alert_status(spark, sf_dir):
    return _status(spark, sf_dir)


@register("alert_summary", with_rules(
    """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'EXCEEDED') AS exceeded,
              count(*) FILTER (WHERE status = 'ERROR') AS errors FROM status"""))
def _alert_summary(spark, sf_dir):
    return AL.alert_summary(_status(spark, sf_dir))


@register("alert_payload", with_rules(
    """SELECT count(*) AS exceeded,
         'Alert: ' || CAST(count(*) AS VARCHAR) || ' rule(s) exceeded' || chr(10)
           || string_agg(line, chr(10) ORDER BY line) AS text
       FROM (SELECT '[' || name || '] ' || domain || ' / ' || coalesce(NULLIF(trim(level), ''), 'ALL')
                    || ': ' || CAST(cnt AS VARCHAR) || ' events (threshold: '
                    || CASE WHEN threshold = floor(threshold)
                            THEN CAST(CAST(threshold AS BIGINT) AS VARCHAR)
                            ELSE CAST(threshold AS VARCHAR) END || ')' AS line
             FROM status WHERE status = 'EXCEEDED')
       HAVING count(*) > 0"""))
def _alert_payload(spark, sf_dir):
    return AL.alert_payload(_status(spark, sf_dir))


@register("rules_upsert", with_rules(
    "SELECT name, domain, level, keyword, threshold, period_minutes FROM rules"))
def _rules_upsert(spark, sf_dir):
    return _rules(spark, sf_dir)


_REMOVED = "SELECT DISTINCT domain || '-error-daily' AS name FROM logs"


@register("rules_remove", with_rules(
    f"SELECT name, domain, level, keyword, threshold, period_minutes FROM rules WHERE name NOT IN ({_REMOVED})"))
def _rules_remove(spark, sf_dir):
    names = FX.logs(spark, sf_dir).select(F.concat("domain", F.lit("-error-daily")).alias("name")).distinct()
    return AL.remove_rules(_rules(spark, sf_dir), names)


@register("rules_list", with_rules("SELECT name, domain, level, keyword, threshold, period_minutes, error FROM checked"))
def _rules_list(spark, sf_dir):
    return AL.list_rules(_rules(spark, sf_dir))


@register("rules_invalid", with_rules("SELECT name, error FROM checked WHERE error IS NOT NULL"))
def _rules_invalid(spark, sf_dir):
    return AL.invalid_rules(_rules(spark, sf_dir))


_DOMAINS_SQL = "(VALUES " + ", ".join(f"('{d}')" for d in FX.DOMAINS) + ") AS dm(name)"

CONN_CTE = f"""base_conn AS (SELECT * FROM {_conn_values()}),
derived_conn AS (
  SELECT DISTINCT log_group, '' AS filter_pattern,
         regexp_extract(log_group, '^/ecs/([a-z]+)', 1) AS domain FROM logs),
domains AS (SELECT * FROM {_DOMAINS_SQL})"""


def with_conn(sql: str) -> str:
    return f"WITH {LOGS_CTE},\n{CONN_CTE}\n{sql}"


@register("connections_upsert", with_conn(
    """, valid AS (SELECT * FROM derived_conn WHERE domain IN (SELECT name FROM domains))
       SELECT log_group, filter_pattern, domain FROM base_conn
        WHERE log_group NOT IN (SELECT log_group FROM valid)
       UNION ALL SELECT log_group, filter_pattern, domain FROM valid"""))
def _connections_upsert(spark, sf_dir):
    return CN.upsert_connections(FX.connections(spark), FX.derived_connections(FX.logs(spark, sf_dir)),
                                 FX.domains(spark))


@register("connections_remove", with_conn(
    """SELECT log_group, filter_pattern, domain FROM base_conn b
       WHERE NOT EXISTS (
         SELECT 1 FROM (SELECT DISTINCT log_group, domain FROM logs WHERE domain IN ('payment', 'auth')
                        UNION SELECT DISTINCT log_group, 'user' FROM logs WHERE domain = 'order') x
         WHERE x.log_group = b.log_group AND x.domain = b.domain)"""))
def _connections_remove(spark, sf_dir):
    lg = FX.logs(spark, sf_dir)
    to_remove = (lg.where(F.col("domain").isin("payment", "auth")).select("log_group", "domain")
                 .unionByName(lg.where(F.col("domain") == "order")
                              .select("log_group", F.lit("user").alias("domain"))).distinct())
    return CN.remove_connections(FX.connections(spark), to_remove)


@register("connections_invalid", with_conn(
    """SELECT log_group, domain, 'unknown domain ''' || domain || '''' AS error FROM derived_conn
       WHERE domain NOT IN (SELECT name FROM domains)"""))
def _connections_invalid(spark, sf_dir):
    return CN.invalid_connections(FX.derived_connections(FX.logs(spark, sf_dir)), FX.domains(spark))


@register("filter_name", with_logs(
    """SELECT DISTINCT log_group, domain,
         'loglake-' || domain || '-' || replace(regexp_replace(log_group, '^/+|/+$', '', 'g'), '/', '-')
           AS filter_name FROM logs"""))
def _filter_name(spark, sf_dir):
    lg = FX.logs(spark, sf_dir).select("log_group", "domain").distinct()
    return CN.filter_names(lg)


# ---- G: cost, K: retention ---------------------------------------------------------


HIST_CTE = """hist AS (
  SELECT 'SELECT * FROM logs WHERE domain = ''' || domain || ''' AND year = ''' || year
           || ''' AND month = ''' || month || ''' AND day = ''' || day || '''' AS sql,
         CAST(sum(coalesce(strlen(level), 0) + coalesce(strlen(service), 0) + coalesce(strlen(message), 0)
                  + coalesce(strlen(trace_id), 0) + coalesce(strlen(log_group), 0)
                  + coalesce(strlen(log_stream), 0) + 24) AS BIGINT) AS scanned_bytes,
         strftime(max(ts_ms), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS "timestamp"
  FROM logs GROUP BY domain, year, month, day),
priced AS (SELECT *, CAST(scanned_bytes AS DOUBLE) * (5.0 / 1099511627776.0) AS cost FROM hist)"""


def with_hist(sql: str) -> str:
    return f"WITH {LOGS_CTE},\n{HIST_CTE}\n{sql}"


def _history(spark, sf_dir):
    return CO.partition_scan_estimates(parquet_lake(spark, sf_dir))


@register("query_cost", with_hist('SELECT sql, scanned_bytes, cost, "timestamp" FROM priced'))
def _query_cost(spark, sf_dir):
    return _history(spark, sf_dir)


@register("cost_totals", with_hist(
    """SELECT count(*) AS queries, CAST(coalesce(sum(scanned_bytes), 0) AS BIGINT) AS total_bytes,
         round(coalesce(sum(scanned_bytes), 0) / 1048576.0, 2) AS total_mb,
         round(CAST(coalesce(sum(scanned_bytes), 0) AS DOUBLE) * (5.0 / 1099511627776.0), 6) AS total_usd
       FROM priced"""))
def _cost_totals(spark, sf_dir):
    return CO.cost_totals(_history(spark, sf_dir))


@register("cost_report", with_hist(
    """SELECT row_number() OVER (ORDER BY "timestamp", sql) AS n, substr("timestamp", 1, 19) AS time,
         CASE WHEN length(sql) > 50 THEN substr(sql, 1, 50) || '...' ELSE sql END AS sql_preview,
         round(scanned_bytes / 1048576.0, 2) AS mb, round(cost, 6) AS usd
       FROM priced"""))
def _cost_report(spark, sf_dir):
    return CO.cost_report(_history(spark, sf_dir))


@register("query_history", with_logs(
    """SELECT row_number() OVER (ORDER BY domain) AS n,
         'SELECT count(*) AS cnt FROM logs WHERE domain = ''' || domain || '''' AS sql, true AS charged
       FROM (SELECT DISTINCT domain FROM logs)"""))
def _query_history(spark, sf_dir):
    """Real queries through the facade, one per domain and each twice: the history
    has every first run in order, with the bytes its scan read; repeats are free."""
    from loglake.api import LogLake

    path = FX.lake_path(spark, sf_dir, "parquet")
    lake = LogLake(spark, path, history_path=FX.result_path(spark, "history"))
    domains = FL.list_files(spark, path).select("domain").distinct().orderBy("domain")
    for r in domains.collect():  # the lake's few top-level directories
        sql = f"SELECT count(*) AS cnt FROM logs WHERE domain = '{r['domain']}'"
        lake.query(sql)
        lake.query(sql)
    return lake.history.frame().select("n", "sql", (F.col("scanned_bytes") > 0).alias("charged"))


_DAYS = ("2024-01-10", "2024-01-20")


@register("query_days_cache", with_logs(
    f"""SELECT step, cnt, charged FROM (VALUES ('1 first', 1, true), ('2 other domain written', 1, false), ('3 other day written', 1, false),
                                               ('4 this domain and day written', 2, true)) AS s(step, parts, charged),
         LATERAL (SELECT count(*) AS cnt FROM logs WHERE domain = 'user' AND event_id % 2 < parts
                  AND year || '-' || month || '-' || day BETWEEN '{_DAYS[0]}' AND '{_DAYS[1]}')"""))
def _query_days_cache(spark, sf_dir):
    """One query of a domain's days, again after writes elsewhere (a hit, free) and there (run anew)."""
    from loglake.api import LogLake

    path, logs = FX.result_path(spark, "days"), FX.logs(spark, sf_dir)
    reached = (F.col("domain") == "user") & F.concat_ws("-", "year", "month", "day").between(*_DAYS)
    first = F.col("event_id") % 2 == 0
    lake = LogLake(spark, path, history_path=FX.result_path(spark, "days-history"))
    rows, charged = None, 0
    for step, part in (("1 first", logs.where(first & reached)), ("2 other domain written", logs.where(first & (F.col("domain") == "order"))),
                       ("3 other day written", logs.where(first & (F.col("domain") == "user") & ~reached)),
                       ("4 this domain and day written", logs.where(~first & reached))):
        L.write_logs(part, path)
        result = lake.query("SELECT count(*) AS cnt FROM logs", domains=["user"], dates=_DAYS)
        before, charged = charged, lake.history.frame().count()
        row = spark.createDataFrame([(step, result.first()["cnt"], charged > before)], "step string, cnt long, charged boolean")
        rows = row if rows is None else rows.unionByName(row)
    return rows


TIER_SQL = f"""SELECT domain, year, month, day, age_days,
         CASE WHEN age_days >= {FX.RETENTION_DAYS} THEN 'expired'
              WHEN age_days >= {FX.ARCHIVE_DAYS} THEN 'archive' ELSE 'hot' END AS tier
       FROM (SELECT DISTINCT domain, year, month, day,
               CAST(date_diff('day', make_date(CAST(year AS BIGINT), CAST(month AS BIGINT), CAST(day AS BIGINT)),
                              DATE '{AS_OF[:10]}') AS INTEGER) AS age_days FROM logs)"""


@register("retention_plan", with_logs(TIER_SQL))
def _retention_plan(spark, sf_dir):
    listing = FL.list_files(spark, FX.lake_path(spark, sf_dir, "parquet"))
    return RT.retention_plan(listing, AS_OF, FX.RETENTION_DAYS, FX.ARCHIVE_DAYS)


def _aged_lake(spark, sf_dir):
    """A lake of its own and its archive after retention ran, late rows came, and it ran again."""
    base = FX.result_path(spark, "retention")
    hot, cold = f"{base}/hot", f"{base}/archive"
    logs = FX.logs(spark, sf_dir)
    late = F.col("event_id") % 10 == 3
    for part in (logs.where(~late), logs.where(late)):
        L.write_logs(part, hot, "parquet")
        plan = RT.retention_plan(FL.list_files(spark, hot), AS_OF, FX.RETENTION_DAYS, FX.ARCHIVE_DAYS)
        RT.apply_retention(spark, hot, plan, archive_root=cold, dry_run=False)
    return hot, cold


@register("retention_apply", with_logs(
    f"""SELECT {TABLE_SELECT} FROM logs l JOIN ({TIER_SQL}) p USING (domain, year, month, day) WHERE tier = 'hot'"""))
def _retention_apply(spark, sf_dir):
    return _full_table(L.read_logs(spark, _aged_lake(spark, sf_dir)[0]))


@register("archive_scan", with_logs(
    f"""SELECT {TABLE_SELECT} FROM logs l JOIN ({TIER_SQL}) p USING (domain, year, month, day) WHERE tier = 'archive'"""))
def _archive_scan(spark, sf_dir):
    return _full_table(L.read_logs(spark, _aged_lake(spark, sf_dir)[1]))


@register("retention_resume", with_logs(
    f"""SELECT tier, domain, count(*) AS cnt FROM logs l JOIN ({TIER_SQL}) p USING (domain, year, month, day)
        WHERE tier <> 'expired' GROUP BY tier, domain"""))
def _retention_resume(spark, sf_dir):
    """Three runs that die after the journal, the copies and a part of the deletes; each is
    finished from its journal, and rows that came meanwhile are in no run but the next."""
    base = FX.result_path(spark, "resume")
    hot, cold = f"{base}/hot", f"{base}/archive"
    logs = FX.logs(spark, sf_dir)
    for step in range(3):
        L.write_logs(logs.where(F.col("event_id") % 3 == step), hot, max_records_per_file=100)
        plan = RT.retention_plan(FL.list_files(spark, hot), AS_OF, FX.RETENTION_DAYS, FX.ARCHIVE_DAYS)
        journal = RT.begin_retention(spark, hot, plan, archive_root=cold)
        if step > 0:
            RT.copy_planned(spark, hot, journal)
        if step > 1:  # deleted, but its job died before it noted so
            FL.delete_files(journal.files().where((F.col("state") == "copied") & (F.xxhash64("path") % 2 == 0)))
        RT.resume_retention(spark, hot)
    counts = None
    for tier, root in ((RT.HOT, hot), (RT.ARCHIVE, cold)):
        part = L.read_logs(spark, root).groupBy(F.lit(tier).alias("tier"), "domain").agg(F.count(F.lit(1)).alias("cnt"))
        counts = part if counts is None else counts.unionByName(part)
    return counts


@register("archive_expire", with_logs(
    f"""SELECT domain, count(*) AS cnt FROM logs l JOIN ({TIER_SQL}) p USING (domain, year, month, day)
        WHERE tier = 'archive' AND age_days < 10 GROUP BY domain"""))
def _archive_expire(spark, sf_dir):
    cold = _aged_lake(spark, sf_dir)[1]
    RT.expire_archive(spark, cold, AS_OF, 10, dry_run=False)
    return L.read_logs(spark, cold).groupBy("domain").agg(F.count(F.lit(1)).alias("cnt"))


@register("retention_off", with_logs(f"SELECT * FROM ({TIER_SQL}) WHERE false"))
def _retention_off(spark, sf_dir):
    return RT.retention_plan(FL.list_files(spark, FX.lake_path(spark, sf_dir, "parquet")), AS_OF, None)


@register("scan_bytes", with_logs(
    """SELECT 'payment 2024-01-15' AS scope, count(*) > 0 AS reads_files, false AS reads_all FROM logs
        WHERE domain = 'payment' AND year = '2024' AND month = '01' AND day = '15'
       UNION ALL SELECT 'whole lake', true, true"""))
def _scan_bytes(spark, sf_dir):
    """Bytes a domain-day query reads, next to the whole lake; a test checks them by a walk."""
    path = FX.lake_path(spark, sf_dir, "parquet")
    day = (F.col("domain") == "payment") & (F.col("year") == "2024") & (F.col("month") == "01") & (F.col("day") == "15")
    total = FL.scan_estimate(spark, path).select(F.col("scanned_bytes").alias("total"))
    both = (FL.scan_estimate(spark, path, predicate=day).select(F.lit("payment 2024-01-15").alias("scope"), "*")
            .unionByName(FL.scan_estimate(spark, path).select(F.lit("whole lake").alias("scope"), "*")))
    return both.join(total, F.col("scanned_bytes") <= F.col("total")).select(  # a total of one row
        "scope", (F.col("scanned_bytes") > 0).alias("reads_files"), (F.col("scanned_bytes") == F.col("total")).alias("reads_all"))


# ---- A / C: catalog table, saved results, checks ---------------------------------------


def _table_name() -> tuple[str, str]:
    import uuid

    return "loglake_check", f"logs_{uuid.uuid4().hex[:12]}"


@register("table_scan", with_ingested(f"SELECT {INGEST_COLS}, year, month, day FROM ingested"))
def _table_scan(spark, sf_dir):
    """A catalog table over a streamed lake."""
    lake_p, _, _ = _streamed_lake(spark, sf_dir)
    name = _table_name()
    TB.create_log_table(spark, *name, lake_p)
    return Q.display(TB.read_table(spark, *name, registered_only=False).select(
        "domain", "log_group", "log_stream", "timestamp", "message", "year", "month", "day"))


@register("mixed_lake", with_ingested(
    """SELECT domain, count(*) AS cnt FROM (SELECT domain FROM ingested UNION ALL SELECT domain FROM logs) GROUP BY domain"""))
def _mixed_lake(spark, sf_dir):
    """A stream and a batch writer on one path, read through the path and a table."""
    lake_p, _, _ = _streamed_lake(spark, sf_dir)
    L.write_logs(FX.logs(spark, sf_dir), lake_p, "parquet")
    name = _table_name()
    TB.create_log_table(spark, *name, lake_p)
    by_table = Q.count_by_domain(TB.read_table(spark, *name, registered_only=False))
    return by_table.join(Q.count_by_domain(L.read_logs(spark, lake_p)), ["domain", "cnt"], "left_semi")


@register("table_lifecycle", with_logs(
    f"SELECT domain, count(*) AS cnt FROM logs WHERE domain IN ({', '.join(repr(d) for d in FX.DOMAINS[:3])}) GROUP BY domain"))
def _table_lifecycle(spark, sf_dir):
    """Create, list, drop (data stays), recreate with other registered domains, read those."""
    path, name = FX.lake_path(spark, sf_dir, "parquet"), _table_name()
    TB.create_log_table(spark, *name, path, domains=FX.DOMAINS)
    TB.create_log_table(spark, *name, path)
    assert name[1] in TB.list_tables(spark, name[0])
    TB.drop_log_table(spark, *name)
    TB.recreate_log_table(spark, *name, path, domains=FX.DOMAINS)
    TB.set_domains(spark, *name, FX.DOMAINS[:3])
    return Q.count_by_domain(TB.read_table(spark, *name))


@register("table_sync", with_logs("SELECT domain, count(*) AS cnt FROM logs GROUP BY domain"))
def _table_sync(spark, sf_dir):
    """Partitions that are written after the table was made, registered by a sync."""
    path, name = FX.result_path(spark, "sync"), _table_name()
    logs = FX.logs(spark, sf_dir)
    L.write_logs(logs.where("event_id % 2 = 0"), path)
    TB.create_log_table(spark, *name, path)
    L.write_logs(logs.where("event_id % 2 = 1"), path)
    TB.sync_partitions(spark, *name)
    return Q.count_by_domain(TB.read_table(spark, *name, registered_only=False))


@register("table_add_partitions", with_logs("SELECT domain, count(*) AS cnt FROM logs GROUP BY domain"))
def _table_add_partitions(spark, sf_dir):
    """Three writes into a table that is there already; each registers what it touched, without a repair."""
    path, name = FX.result_path(spark, "touched"), _table_name()
    logs = FX.logs(spark, sf_dir)
    L.write_logs(logs.where("event_id % 4 = 0"), path)
    TB.create_log_table(spark, *name, path)
    for k in (1, 2, 3):
        TB.write_to_table(spark, *name, logs.where(F.col("event_id") % 4 == k), path)
    return Q.count_by_domain(TB.read_table(spark, *name, registered_only=False))


@register("saved_result", with_logs("SELECT domain, level, count(*) AS cnt FROM logs GROUP BY domain, level"))
def _saved_result(spark, sf_dir):
    path = FX.result_path(spark, "saved")
    L.save_result(parquet_lake(spark, sf_dir).groupBy("domain", "level").agg(F.count(F.lit(1)).alias("cnt")), path)
    return spark.read.option("header", True).schema("domain string, level string, cnt long").csv(path)


@register("quarantine_batch", with_ingested(
    """SELECT reason, count(*) AS cnt FROM (
         SELECT 'not gzip or not UTF-8' AS reason FROM (SELECT DISTINCT log_group, log_stream FROM logs)
         UNION ALL SELECT 'not JSON' FROM first, (SELECT unnest(range(4)))) GROUP BY reason"""))
def _quarantine_batch(spark, sf_dir):
    _, parsed = _decoded(spark, sf_dir)
    path = FX.result_path(spark, "quarantine")
    L.write_quarantine(parsed, path)
    return (spark.read.schema("record_id string, data string, reason string").json(path)
            .groupBy("reason").agg(F.count(F.lit(1)).alias("cnt")))


@register("safe_literals", with_logs(
    """SELECT level, count(*) AS cnt FROM logs WHERE message LIKE '%"k"%' AND domain <> 'x'' OR ''1''=''1' GROUP BY level"""))
def _safe_literals(spark, sf_dir):
    from loglake.operators.sql import run_sql

    return run_sql(spark, parquet_lake(spark, sf_dir),
                   "SELECT level, count(*) AS cnt FROM logs WHERE message LIKE :m AND domain <> :d GROUP BY level",
                   {"m": '%"k"%', "d": "x' OR '1'='1"})


@register("empty_result", with_logs("SELECT domain, level, count(*) AS cnt FROM logs WHERE domain = 'none' GROUP BY domain, level"))
def _empty_result(spark, sf_dir):
    return Q.count_by_level(parquet_lake(spark, sf_dir), "none").select("domain", "level", "cnt")


@register("pruning_check", with_logs(
    """SELECT 'domain' AS query, true AS pruned, count(*) AS cnt FROM logs WHERE domain = 'user'
       UNION ALL SELECT 'not null', false, count(*) FROM logs
       UNION ALL SELECT 'one of two', false, count(*) + count(*) FILTER (WHERE domain = 'user') FROM logs"""))
def _pruning_check(spark, sf_dir):
    import warnings

    from loglake.plans.inspect import check_pruned

    logs = parquet_lake(spark, sf_dir).select("domain", "level")
    user = logs.where("domain = 'user'")
    out = None
    for name, df in (("domain", user), ("not null", logs.where("domain IS NOT NULL")), ("one of two", logs.unionByName(user))):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            pruned = check_pruned(df)
        row = df.agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(name).alias("query"), F.lit(pruned).alias("pruned"), "cnt")
        out = row if out is None else out.unionByName(row)
    return out


@register("compacted_lake", with_logs(f"SELECT {TABLE_SELECT} FROM logs"))
def _compacted_lake(spark, sf_dir):
    """A lake of several small writes after its closed days were compacted."""
    path = FX.result_path(spark, "compacted")
    logs = FX.logs(spark, sf_dir)
    for k in range(3):
        L.write_logs(logs.where(F.col("event_id") % 3 == k), path)
    RT.compact(spark, path, AS_OF[:10])
    return _full_table(L.read_logs(spark, path))


# ---- L: streaming ---------------------------------------------------------------------


def _streamed_lake(spark, sf_dir):
    """Run the streaming ingest once over the envelope files (availableNow):
    lake, quarantine and audit paths."""
    from loglake.session import ensure_utc

    ensure_utc(spark)
    src = FX.envelopes_path(spark, sf_dir)
    base = FX.result_path(spark, "stream_ingest")
    q = SI.start_ingest(spark, src, base + "/lake", base + "/_checkpoint", lambda: FX.connections(spark),
                        quarantine_path=base + "/quarantine", trigger={"availableNow": True}, audit_path=base + "/audit")
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return base + "/lake", base + "/quarantine", base + "/audit"


@register("stream_ingest", _RT_SQL)
def _stream_ingest(spark, sf_dir):
    lk = L.read_logs(spark, _streamed_lake(spark, sf_dir)[0])
    return Q.display(lk.select("domain", "log_group", "log_stream", "timestamp", "message",
                               "year", "month", "day"))


@register("stream_audit", with_ingested(DISPOSITION_SQL))
def _stream_audit(spark, sf_dir):
    audit = SI.read_audit(spark, _streamed_lake(spark, sf_dir)[2])
    return audit.groupBy("disposition").agg(F.sum("records").cast("long").alias("records"))


@register("stream_quarantine", with_ingested(
    """SELECT DISTINCT 'truncated:' || log_group || ':' || log_stream || ':' || CAST(min(event_id // 256)
         OVER (PARTITION BY log_group, log_stream) AS VARCHAR) AS record_id,
         'not gzip or not UTF-8' AS reason FROM logs
       UNION ALL SELECT kind || ':' || log_group, 'not JSON'
         FROM first, (VALUES ('trailing'), ('twice'), ('quotes'), ('array')) AS k(kind)"""))
def _stream_quarantine(spark, sf_dir):
    return SI.read_quarantine(spark, _streamed_lake(spark, sf_dir)[1]).select("record_id", "reason")


WINDOW_SQL = """SELECT name, strftime(make_timestamp(s), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS window_start,
         strftime(make_timestamp(s + span), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS window_end,
         cnt, threshold, cnt > threshold AS exceeded
  FROM (SELECT r.name, r.threshold, TRY_CAST(r.period_minutes * 60000000 AS BIGINT) AS span,
               CAST(floor(epoch_us(l.ts_ms) / TRY_CAST(r.period_minutes * 60000000 AS BIGINT)) AS BIGINT)
                 * TRY_CAST(r.period_minutes * 60000000 AS BIGINT) AS s,
               count(*) AS cnt
        FROM logs l JOIN checked r
          ON r.error IS NULL AND l.domain = r.domain
         AND (NULLIF(trim(r.level), '') IS NULL OR l.level = r.level)
         AND (NULLIF(trim(r.keyword), '') IS NULL OR contains(l.message, r.keyword))
        GROUP BY 1, 2, 3, 4)"""


@register("window_counts", with_rules(WINDOW_SQL))
def _window_counts(spark, sf_dir):
    return SA.window_counts(parquet_lake(spark, sf_dir), _rules(spark, sf_dir))


STREAM_WINDOW_SQL = WINDOW_SQL.replace(
    "GROUP BY 1, 2, 3, 4)",
    "GROUP BY 1, 2, 3, 4)\n  WHERE make_timestamp(s + span) <= (SELECT max(ts_ms) FROM logs)")


@register("stream_alerts", with_rules(STREAM_WINDOW_SQL))
def _stream_alerts(spark, sf_dir):
    """Closed windows from the streaming alert job over the lake files, which come in
    no order of time and a fifth of them per micro-batch."""
    from loglake.session import ensure_utc

    ensure_utc(spark)
    lake_p = FX.lake_path(spark, sf_dir, "parquet")
    base = FX.result_path(spark, "stream_alerts")
    files = FL.list_files(spark, lake_p).count()
    rules = _rules(spark, sf_dir)
    stream = (spark.readStream.schema(S.LOGS_PARQUET).option("maxFilesPerTrigger", max(1, -(-files // 5))).parquet(lake_p))
    q = SA.start_alerts(stream, lambda: rules, base + "/out", base + "/_checkpoint", trigger={"availableNow": True})
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return SA.closed_windows(spark, base + "/out", rules)


# Three versions of the rules: all of them always; from the middle of the month every valid
# threshold is doubled and ERROR rules lose their keyword; later the daily rules of WARN are removed.
_CHANGED, _DROPPED = "2024-01-15 06:30:00", "2024-01-22 18:00:00"
VERSIONS_CTE = f"""versions AS (
  SELECT name, domain, level, keyword, threshold, period_minutes, error, false AS removed, NULL AS valid_from FROM checked
  UNION ALL SELECT name, domain, level, CASE WHEN level = 'ERROR' THEN NULL ELSE keyword END, threshold * 2, period_minutes, error, false,
    TIMESTAMP '{_CHANGED}' FROM checked WHERE error IS NULL
  UNION ALL SELECT name, NULL, NULL, NULL, NULL, NULL, NULL, true, TIMESTAMP '{_DROPPED}' FROM checked WHERE name LIKE '%-warn-daily'),
held AS (SELECT *, coalesce(epoch_us(valid_from), -4000000000000000000) AS r_from,
           coalesce(epoch_us(lead(valid_from) OVER (PARTITION BY name ORDER BY valid_from NULLS FIRST)), 4000000000000000000) AS r_to FROM versions),
valid AS (SELECT *, TRY_CAST(period_minutes * 60000000 AS BIGINT) AS span FROM held WHERE NOT removed AND error IS NULL),
counted AS (
  SELECT r.name, r.span, CAST(floor(epoch_us(l.ts_ms) / r.span) AS BIGINT) * r.span AS s, count(*) AS cnt
  FROM logs l JOIN valid r ON l.domain = r.domain AND epoch_us(l.ts_ms) >= r.r_from AND epoch_us(l.ts_ms) < r.r_to
   AND (NULLIF(trim(r.level), '') IS NULL OR l.level = r.level)
   AND (NULLIF(trim(r.keyword), '') IS NULL OR contains(l.message, r.keyword))
  GROUP BY 1, 2, 3)"""
VERSIONS_SQL = f"""SELECT c.name, strftime(make_timestamp(s), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS window_start,
         strftime(make_timestamp(s + c.span), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS window_end, cnt, v.threshold, cnt > v.threshold AS exceeded
  FROM counted c JOIN valid v ON v.name = c.name AND v.span = c.span AND v.r_from < s + c.span
  WHERE make_timestamp(s + c.span) <= (SELECT max(ts_ms) FROM logs)
  QUALIFY row_number() OVER (PARTITION BY c.name, c.span, s ORDER BY v.r_from DESC) = 1"""


def _rule_history(rules):
    valid = AL.list_rules(rules).where("error IS NULL")
    changed = valid.withColumn("threshold", F.col("threshold") * 2).withColumn(
        "keyword", F.when(F.col("level") == "ERROR", None).otherwise(F.col("keyword"))).drop("error")
    history = AL.changed_rules(AL.rule_history(rules), changed, _CHANGED)
    return AL.removed_rules(history, rules.where(F.col("name").endswith("-warn-daily")).select("name"), _DROPPED)


@register("stream_alerts_versions", f"WITH {LOGS_CTE},\n{RULES_CTE},\n{VERSIONS_CTE}\n{VERSIONS_SQL}")
def _stream_alerts_versions(spark, sf_dir):
    """The alert stream under a history of rules. Files come in no order of time, so every
    batch has events of all versions; each counts for the one that held at its time."""
    from loglake.session import ensure_utc

    ensure_utc(spark)
    lake_p = FX.lake_path(spark, sf_dir, "parquet")
    base = FX.result_path(spark, "stream_versions")
    files = FL.list_files(spark, lake_p).count()
    history = _rule_history(_rules(spark, sf_dir))
    stream = (spark.readStream.schema(S.LOGS_PARQUET).option("maxFilesPerTrigger", max(1, -(-files // 3))).parquet(lake_p))
    q = SA.start_alerts(stream, lambda: history, base + "/out", base + "/_checkpoint", trigger={"availableNow": True})
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return SA.closed_windows(spark, base + "/out", history)


@register("rules_as_of", f"""WITH {LOGS_CTE},\n{RULES_CTE},\n{VERSIONS_CTE}
  SELECT name, domain, level, keyword, threshold, period_minutes FROM held
  WHERE NOT removed AND r_from <= epoch_us(TIMESTAMP '{_DROPPED}') AND r_to > epoch_us(TIMESTAMP '{_DROPPED}')""")
def _rules_as_of(spark, sf_dir):
    return AL.rules_at(_rule_history(_rules(spark, sf_dir)), _DROPPED)
