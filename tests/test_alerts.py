"""Alert boundaries and the one-scan plan."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loglake import schema as S
from loglake.operators import alerts as AL
from loglake.plans.inspect import join_strategies, partition_filters

AS_OF = "2024-01-31 00:00:00"


def _logs(spark, rows):
    df = spark.createDataFrame(rows, "ts string, domain string, level string, message string")
    ts = F.to_timestamp("ts")
    return df.select(ts.alias("timestamp"), "domain", "level", "message",
                     F.date_format(ts, "yyyy").alias("year"), F.date_format(ts, "MM").alias("month"),
                     F.date_format(ts, "dd").alias("day"))


def _rules(spark, rows):
    return spark.createDataFrame(rows, S.RULES)


@pytest.fixture()
def logs(spark):
    return _logs(spark, [
        ("2024-01-30 23:55:00", "payment", "ERROR", "timeout 100% a_b it's C:\\dir"),
        ("2024-01-30 23:58:00", "payment", "ERROR", "timeout again"),
        ("2024-01-30 23:50:00", "payment", "ERROR", "edge of window"),
        ("2024-01-30 23:49:59.999", "payment", "ERROR", "just outside"),
        ("2024-01-30 23:59:00", "payment", "WARN", "slow"),
        ("2024-01-29 10:00:00", "order", "ERROR", "old"),
    ])


def test_counts_threshold_and_window_edge(spark, logs):
    rules = _rules(spark, [
        ("eq", "payment", "ERROR", None, 3.0, 10.0),     # 3 events in [23:50, now): 3 > 3 is false
        ("over", "payment", "ERROR", None, 2.0, 10.0),
        ("none", "order", "ERROR", None, 0.0, 10.0),     # no match -> 0, OK
        ("all", "payment", None, None, 3.0, 10.0),       # no level: 4 events
        ("bad-threshold", "payment", None, None, -1.0, 10.0),
        ("bad-period", "payment", None, None, 1.0, 0.0),
        ("blank-level", "payment", "", "", 0.0, 10.0),
    ])
    st = {r["name"]: (r["cnt"], r["status"]) for r in AL.alert_status(logs, rules, AS_OF).collect()}
    assert st["eq"] == (3, "OK")
    assert st["over"] == (3, "EXCEEDED")
    assert st["none"] == (0, "OK")
    assert st["all"] == (4, "EXCEEDED")
    assert st["bad-threshold"] == (0, "ERROR")
    assert st["bad-period"] == (0, "ERROR")
    assert st["blank-level"] == (4, "EXCEEDED")
    summ = AL.alert_summary(AL.alert_status(logs, rules, AS_OF)).first()
    assert (summ["total"], summ["exceeded"], summ["errors"]) == (7, 3, 2)


def test_keyword_literal_versus_like(spark, logs):
    rules = _rules(spark, [
        ("pct", "payment", None, "100%", 0.0, 60.0),
        ("under", "payment", None, "a_b", 0.0, 60.0),
        ("wild", "payment", None, "a_", 0.0, 60.0),
        ("quote", "payment", None, "it's", 0.0, 60.0),
        ("backslash", "payment", None, "C:\\dir", 0.0, 60.0),
        ("pct-wild", "payment", None, "time%again", 0.0, 60.0),
    ])
    lit = {r["name"]: r["cnt"] for r in AL.rule_counts(logs, rules, AS_OF).collect()}
    like = {r["name"]: r["cnt"] for r in AL.rule_counts(logs, rules, AS_OF, keyword_mode="like").collect()}
    assert lit == {"pct": 1, "under": 1, "wild": 1, "quote": 1, "backslash": 1, "pct-wild": 0}
    assert like["pct-wild"] == 1 and like["backslash"] == 1 and like["quote"] == 1


def test_payload(spark, logs):
    rules = _rules(spark, [("b", "payment", None, None, 1.0, 10.0), ("a", "payment", "ERROR", None, 2.5, 10.0),
                           ("c", "order", None, None, 5.0, 10.0)])
    p = AL.alert_payload(AL.alert_status(logs, rules, AS_OF)).collect()
    assert len(p) == 1 and p[0]["exceeded"] == 2
    assert p[0]["text"].split("\n") == [
        "Alert: 2 rule(s) exceeded",
        "[a] payment / ERROR: 3 events (threshold: 2.5)",
        "[b] payment / ALL: 4 events (threshold: 1)"]
    none = _rules(spark, [("c", "order", None, None, 5.0, 10.0)])
    assert AL.alert_payload(AL.alert_status(logs, none, AS_OF)).count() == 0


def test_upsert_remove_validate(spark):
    base = _rules(spark, [("a", "user", None, None, 1.0, 5.0), ("b", "user", None, None, 1.0, 5.0)])
    new = _rules(spark, [("b", "order", "ERROR", None, 9.0, 60.0), ("c", "auth", None, None, 0.0, 1.0)])
    up = {r["name"]: r["domain"] for r in AL.upsert_rules(base, new).collect()}
    assert up == {"a": "user", "b": "order", "c": "auth"}
    rm = AL.remove_rules(AL.upsert_rules(base, new), spark.createDataFrame([("a",)], "name string"))
    assert sorted(r["name"] for r in rm.collect()) == ["b", "c"]
    gone = spark.createDataFrame([("a",), ("zz",)], "name string")
    assert [r["name"] for r in AL.missing_rules(base, gone).collect()] == ["zz"]
    inv = _rules(spark, [("", "d", None, None, 1.0, 1.0), ("x", None, None, None, 1.0, 1.0),
                         ("y", "d", None, None, None, 1.0), ("z", "d", None, None, 0.0, -1.0)])
    errs = {r["name"]: r["error"] for r in AL.invalid_rules(inv).collect()}
    assert errs == {"": "name is required", "x": "domain is required",
                    "y": "threshold must be a number >= 0", "z": "period_minutes must be a number > 0"}


def test_one_scan_plan_on_lake(spark, sf):
    from loglake import fixtures as FX

    lake = FX.lake(spark, sf, "parquet")
    rules = AL.upsert_rules(FX.base_rules(spark), FX.derived_rules(FX.logs(spark, sf)))
    df = AL.rule_counts(lake, rules, FX.AS_OF)
    assert "CartesianProduct" not in join_strategies(df) and "BroadcastNestedLoopJoin" not in join_strategies(df)
    pf = [f for f in partition_filters(df) if f]
    assert any("year" in f for f in pf)
    assert df.count() == rules.count()


def _join_keys(df):
    import re

    from loglake.plans.inspect import plan_text

    return sorted(re.sub(r"#\d+L?", "", x) for x in re.findall(r"Join \[[^]]*\], \[[^]]*\]", plan_text(df, "simple")))


def test_one_plan_for_any_number_of_rules(spark, logs):
    """200,000 rules: the same equi-join on domain and level, no bound, right counts."""
    few = _rules(spark, [("r0", "payment", "ERROR", None, 1.0, 10.0)])
    many = spark.range(200_000).select(
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("name"),
        F.when(F.col("id") % 2 == 0, "payment").otherwise("order").alias("domain"),
        F.when(F.col("id") % 3 == 0, "ERROR").otherwise(F.lit(None)).alias("level"), F.lit(None).cast("string").alias("keyword"),
        F.lit(3.5).alias("threshold"), F.lit(10.0).alias("period_minutes"))
    for rules in (few, many):
        assert any("domain, _level" in k and "r_domain, r_level" in k for k in _join_keys(AL.rule_counts(logs, rules, AS_OF)))
    st = AL.alert_status(logs, many, AS_OF).groupBy("cnt", "status").count().collect()
    assert {(r["cnt"], r["status"]): r["count"] for r in st} == {
        (3, "OK"): 33_334, (4, "EXCEEDED"): 66_666, (0, "OK"): 100_000}


def test_one_bad_rule_and_shared_names_leave_others_alone(spark, logs):
    rules = _rules(spark, [
        ("good", "payment", "ERROR", None, 2.0, 10.0), ("inf", "payment", None, None, 0.0, float("inf")),
        ("huge", "payment", None, None, 0.0, 2e9), ("nan", "payment", None, None, float("nan"), 10.0),
        ("same", "payment", "ERROR", None, 2.0, 10.0), ("same", "payment", None, None, 2.0, 10.0), (None, "payment", None, None, 1.0, 1.0)])
    st = {r["name"]: (r["cnt"], r["status"]) for r in AL.alert_status(logs, rules, AS_OF).collect()}
    assert st == {"good": (3, "EXCEEDED"), "inf": (0, "ERROR"), "huge": (0, "ERROR"), "nan": (0, "ERROR"),
                  "same": (4, "EXCEEDED"), None: (0, "ERROR")}
    twice = _rules(spark, [("n", "a", None, None, 1.0, 1.0), ("n", "b", None, None, 1.0, 1.0)])
    assert [r["domain"] for r in AL.upsert_rules(rules.limit(0), twice).collect()] == ["a"]
    assert AL.list_rules(rules).count() == 6


def test_payload_pages(spark, logs):
    rules = _rules(spark, [(f"r{i:03d}", "payment", None, None, 0.0, 10.0) for i in range(120)])
    status = AL.alert_status(logs, rules, AS_OF)
    one, many = AL.alert_payload(status).collect(), AL.alert_payload(status, max_lines=10).collect()
    assert len(one) == 1 and 1 < len(many) <= 12
    lines = lambda rows: sorted(x for r in rows for x in r["text"].split("\n")[1:])
    assert lines(one) == lines(many) and {r["exceeded"] for r in many} == {120}


def test_empty_rules(spark, logs):
    empty = spark.createDataFrame([], S.RULES)
    assert AL.rule_counts(logs, empty, AS_OF).count() == 0
    assert AL.alert_summary(AL.alert_status(logs, empty, AS_OF)).first()["total"] == 0
    assert dt.datetime(2024, 1, 31)  # fixed clock, never now()


def test_message_column_read_only_for_keyword_rules(spark, sf):
    from loglake import fixtures as FX
    from loglake.plans.inspect import plan_text

    lake = FX.lake(spark, sf, "parquet")
    plain = _rules(spark, [("a", "payment", "ERROR", None, 1.0, 1440.0), ("b", "user", None, "", 1.0, 60.0)])
    kw = _rules(spark, [("a", "payment", "ERROR", 'k": 9', 1.0, 1440.0)])
    import re
    schemas = lambda df: re.findall(r"ReadSchema: (struct<[^>]*>)", plan_text(df, "simple"))
    assert not any("message" in x for x in schemas(AL.rule_counts(lake, plain, FX.AS_OF)))
    assert any("message" in x for x in schemas(AL.rule_counts(lake, kw, FX.AS_OF)))


def test_keyword_semantics_brute_force(spark):
    """Random messages and keywords over an alphabet rich in %, _, \\ and ':
    Spark's predicate equals a direct Python implementation, both modes."""
    import random
    import re as _re

    from loglake.functions.text import keyword_match

    rnd = random.Random(7)
    alpha = "ab%_\\'x"
    pairs = [("".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 8))),
              "".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 3)))) for _ in range(400)]

    def like(msg, kw):  # SQL LIKE without escape char: % any run, _ any one char
        rx = "".join(".*" if c == "%" else "." if c == "_" else _re.escape(c) for c in kw)
        return _re.fullmatch(".*" + rx + ".*", msg, flags=_re.S) is not None

    df = spark.createDataFrame(pairs, "m string, k string")
    got = df.select("m", "k",
                    keyword_match(F.col("m"), F.col("k"), "contains").alias("c"),
                    keyword_match(F.col("m"), F.col("k"), "like").alias("l")).collect()
    for r in got:
        assert r["c"] == (r["k"] in r["m"]), (r["m"], r["k"])
        assert r["l"] == like(r["m"], r["k"]), (r["m"], r["k"])


def _random_rules(n, words, seed):
    import random

    r = random.Random(seed)
    levels = ["ERROR", "WARN", None, "", " "]
    return [(f"r{i}", r.choice(["payment", "order"]), r.choice(levels), "".join(r.choice(words) for _ in range(r.randint(1, 3))), 1.0, r.choice([10.0, 1e5]))
            for i in range(n)]


@pytest.mark.parametrize("mode", ["contains", "like"])
def test_keywords_found_by_pieces_count_the_same(spark, monkeypatch, mode):
    """Against every rule on every row: pieces that are shared, short keywords, wildcards, characters beyond 16 bits."""
    import random
    import re as _re

    r = random.Random(11)
    words = ["id=", "id", "7", "42", "é", "\U0001F600", "x\U0001F600y", "%", "_", "\\", "' ", "timeout", "time"]
    message = lambda: "".join(r.choice(words) for _ in range(r.randint(0, 9)))
    rows = [(f"2024-01-30 23:{r.randrange(60):02d}:00", r.choice(["payment", "order", "user"]), r.choice(["ERROR", "WARN", "", None]), r.choice([message(), message(), None]))
            for _ in range(400)]
    rules = _random_rules(300, words, 3) + [("bare", "order", None, None, 1.0, 30.0), ("wild", "order", None, "%", 1.0, 30.0), ("any", "order", None, "_", 1.0, 30.0)]

    def hit(m, kw):
        if m is None:
            return False
        if mode == "contains":
            return kw in m
        return _re.search("".join(".*" if c == "%" else "." if c == "_" else _re.escape(c) for c in kw), m, _re.S) is not None

    def count(rule):
        _, domain, level, kw, _, period = rule
        lower = dt.datetime(2024, 1, 31) - dt.timedelta(minutes=period)
        return sum(d == domain and (not (level or "").strip() or lv == level) and (not (kw or "").strip() or hit(m, kw))
                   and dt.datetime.fromisoformat(t) >= lower for t, d, lv, m in rows)

    want = {x[0]: count(x) for x in rules}
    logs, side = _logs(spark, rows), _rules(spark, rules)
    for crowd, block in ((64, 100_000), (5, 40)):
        monkeypatch.setattr(AL, "GRAM_RULES", crowd)
        monkeypatch.setattr(AL, "BLOCK_RULES", block)
        assert {x["name"]: x["cnt"] for x in AL.rule_counts(logs, side, AS_OF, mode).collect()} == want
    assert sum(want.values()) > 1000


def test_twenty_thousand_keywords_in_one_domain(spark):
    """No join of rows with all rules of their domain: pieces are keys of the join, and few pairs are compared."""
    from loglake.plans.inspect import plan_text

    rules = spark.range(20_000).select(
        F.concat(F.lit("r"), "id").alias("name"), F.lit("payment").alias("domain"), F.lit(None).cast("string").alias("level"),
        F.concat(F.lit("order id "), F.conv(F.col("id") * 7919, 10, 36)).alias("keyword"), F.lit(0.0).alias("threshold"), F.lit(60.0).alias("period_minutes"))
    rows = [("2024-01-30 23:55:00", "payment", "ERROR", f"status of order id {x} is unknown") for x in ("ZZZZZZZZ", "0", "63Z", "NOPE")] * 50
    df = AL.rule_counts(_logs(spark, rows), rules, AS_OF)
    got = {r["name"]: r["cnt"] for r in df.where("cnt > 0").collect()}
    base36 = lambda n: (base36(n // 36) if n >= 36 else "") + "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[n % 36]
    want = {}
    for i in range(20_000):
        n = sum(f"order id {base36(i * 7919)}" in m for *_, m in rows)
        if n:
            want[f"r{i}"] = n
    assert got == want and "r0" in want
    text = plan_text(df, "simple")
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert any("_gram" in k and "r_gram" in k for k in _join_keys(df))
    # Every join of log rows by (domain, level) alone is with the rules that have no piece: none here.
    side = AL.rule_side(rules)
    assert AL.with_gram(side, _logs(spark, rows), "contains").where("r_gram IS NULL").count() == 0


def test_a_blank_level_of_a_row_is_no_second_copy(spark):
    logs = _logs(spark, [("2024-01-30 23:55:00", "payment", "", "m"), ("2024-01-30 23:55:00", "payment", "*", "m")])
    rules = _rules(spark, [("any", "payment", None, None, 0.0, 60.0), ("star", "payment", "*", None, 0.0, 60.0)])
    assert {r["name"]: r["cnt"] for r in AL.rule_counts(logs, rules, AS_OF).collect()} == {"any": 2, "star": 1}


def test_the_payload_runs_the_scan_once(spark, logs):
    rules = _rules(spark, [("b", "payment", None, None, 1.0, 10.0)])
    scans = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def watched(m):
        scans.add(1)
        return m

    status = AL.alert_status(logs.where("domain = 'payment'").withColumn("level", watched("level")), rules, AS_OF)
    assert AL.alert_payload(status).count() == 1 and scans.value == 4  # the rows in the window, once


def _history(spark):
    history = AL.rule_history(_rules(spark, [("t", "payment", "ERROR", None, 15.0, 60.0), ("k", "payment", None, "a", 0.0, 60.0), ("p", "order", None, None, 0.0, 60.0)]))
    history = AL.changed_rules(history, _rules(spark, [("t", "payment", "ERROR", None, 14.0, 60.0), ("bad", "order", None, None, -1.0, 60.0)]), "2024-01-10 00:30:00")
    history = AL.changed_rules(history, _rules(spark, [("k", "payment", None, "b", 5.0, 60.0), ("p", "order", None, None, 2.0, 30.0)]), "2024-01-10 00:20:00")
    return AL.removed_rules(history, spark.createDataFrame([("k",)], "name string"), "2024-01-10 02:00:00")


def test_rules_at_a_time(spark):
    h = _history(spark)
    at = lambda t: {r["name"]: (r["keyword"], r["threshold"], r["period_minutes"]) for r in AL.rules_at(h, t).collect()}
    assert at("2024-01-10 00:00:00") == {"t": (None, 15.0, 60.0), "k": ("a", 0.0, 60.0), "p": (None, 0.0, 60.0)}
    assert at("2024-01-10 00:30:00") == {"t": (None, 14.0, 60.0), "k": ("b", 5.0, 60.0), "p": (None, 2.0, 30.0), "bad": (None, -1.0, 60.0)}
    assert set(at("2024-01-10 02:00:00")) == {"t", "p", "bad"}
    again = AL.changed_rules(h, _rules(spark, [("k", "payment", None, "c", 1.0, 60.0)]), "2024-01-10 03:00:00")
    assert {r["name"] for r in AL.rules_at(again, "2024-01-10 03:00:00").collect()} == {"t", "k", "p", "bad"}
