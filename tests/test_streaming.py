from pyspark.sql import functions as F

from loglake import fixtures as FX
from loglake import schema as S
from loglake.operators.ingest import transform
from loglake.sources.lake import read_logs, write_logs
from loglake.streaming import alerts as SA
from loglake.streaming import ingest as SI


def test_stream_equals_batch_and_replay_is_idempotent(spark, sf, tmp_path):
    src = FX.envelopes_path(spark, sf)
    lake, ck, q = str(tmp_path / "lake"), str(tmp_path / "ck"), str(tmp_path / "q")
    run = SI.start_ingest(spark, src, lake, ck, lambda: FX.connections(spark), quarantine_path=q,
                          trigger={"availableNow": True}, max_files_per_trigger=1)
    run.awaitTermination()
    assert run.exception() is None
    got = read_logs(spark, lake)
    want = transform(spark.read.schema(S.DELIVERY_RECORD).json(src), FX.connections(spark))[0]
    key = ["domain", "log_group", "message", "year", "month", "day"]
    assert got.select(*key).exceptAll(want.select(*key)).count() == 0
    assert got.count() == want.count()
    # Replaying batch 0 (as after a crash) must not duplicate it.
    recs = spark.read.schema(S.DELIVERY_RECORD).json(src).orderBy("record_id").limit(5).cache()
    replay = str(tmp_path / "replay")
    once = transform(recs, FX.connections(spark))[0].count()
    SI.ingest_batch(recs, 3, lambda: FX.connections(spark), replay, None)
    SI.ingest_batch(recs, 4, lambda: FX.connections(spark), replay, None)
    SI.ingest_batch(recs, 3, lambda: FX.connections(spark), replay, None)
    back = read_logs(spark, replay, keep_key=True)
    assert back.where(F.col("ingest_key") == SI.batch_key("stream", 3)).count() == once
    assert back.count() == 2 * once
    assert spark.read.json(q).count() > 0


def test_stream_alerts_match_batch_closed_windows(spark, sf, tmp_path):
    from loglake.operators.alerts import upsert_rules

    lake_p = FX.lake_path(spark, sf)
    rules = upsert_rules(FX.base_rules(spark), FX.derived_rules(FX.logs(spark, sf)))
    stream = spark.readStream.schema(S.LOGS_PARQUET).option("maxFilesPerTrigger", 50).parquet(lake_p)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    q = SA.start_alerts(stream, lambda: rules, out, ck, trigger={"availableNow": True})
    q.awaitTermination()
    got = SA.closed_windows(spark, out, rules)
    batch = SA.window_counts(FX.lake(spark, sf), rules)
    last = FX.lake(spark, sf).agg(F.max("timestamp")).first()[0]
    closed = batch.where(F.to_timestamp("window_end") <= F.lit(last))
    cols = ["name", "window_start", "window_end", "cnt"]
    assert got.select(*cols).exceptAll(batch.select(*cols)).count() == 0
    assert closed.select(*cols).exceptAll(got.select(*cols)).count() == 0


def test_connections_reread_per_batch_and_late_rows(spark, tmp_path):
    """A group connected between batches is mapped from the next batch on
    (the connections table is read again in every batch), and a late event
    lands in the partition of its own event date."""
    import os

    from helpers import b64gz, envelope

    src, conn_dir = tmp_path / "src", tmp_path / "conns"
    src.mkdir()
    lake, ck = str(tmp_path / "lake"), str(tmp_path / "ck")

    def write_records(name, rows):
        import json
        with open(src / name, "w") as f:
            for rid, data in rows:
                f.write(json.dumps({"record_id": rid, "data": data}) + "\n")

    def write_conns(rows):
        spark.createDataFrame(rows, S.CONNECTIONS).coalesce(1).write.mode("overwrite").json(str(conn_dir))

    def conns():
        return spark.read.schema(S.CONNECTIONS).json(str(conn_dir))

    write_conns([("/ecs/other", "", "user")])
    ev1 = [{"id": "1", "timestamp": 1704412800000, "message": "first"}]        # 2024-01-05
    write_records("a.json", [("a", b64gz(envelope(group="/ecs/new", events=ev1)))])
    run = lambda: SI.start_ingest(spark, str(src), lake, ck, conns,
                                  trigger={"availableNow": True})
    q = run()
    q.awaitTermination()
    write_conns([("/ecs/other", "", "user"), ("/ecs/new", "", "auth")])
    ev2 = [{"id": "2", "timestamp": 1704153600000, "message": "late"}]         # 2024-01-02
    write_records("b.json", [("b", b64gz(envelope(group="/ecs/new", events=ev2)))])
    q = run()
    q.awaitTermination()
    got = {r["message"]: (r["domain"], r["day"], r["ingest_key"])
           for r in read_logs(spark, lake, keep_key=True).collect()}
    assert got["first"][:2] == ("unknown", "05")
    assert got["late"][:2] == ("auth", "02")
    assert got["late"][2] > got["first"][2]
    assert os.path.isdir(os.path.join(lake, "domain=auth", "year=2024", "month=01", "day=02"))


def _records(spark, n, text="m"):
    from helpers import b64gz, envelope

    rows = [(f"{text}{i}", b64gz(envelope(group="/ecs/new", events=[{"id": "1", "timestamp": 1704412800000, "message": f"{text}{i}"}])))
            for i in range(n)]
    return spark.createDataFrame(rows, S.DELIVERY_RECORD)


def test_streams_fresh_checkpoints_and_batch_writes_add_up(spark, tmp_path):
    from loglake.sources import tables as TB

    lake = str(tmp_path / "lake")
    conns = lambda: FX.connections(spark)
    for k in range(2):  # two streams, and one of them from a fresh checkpoint
        src = str(tmp_path / f"src{k}")
        _records(spark, 3, f"s{k}-").coalesce(1).write.json(src)
        for ck in ("ck", "fresh")[:k + 1]:
            SI.start_ingest(spark, src, lake, str(tmp_path / f"{ck}{k}"), conns, trigger={"availableNow": True}).awaitTermination()
    write_logs(transform(_records(spark, 2, "batch"), conns())[0], lake)
    got = read_logs(spark, lake).groupBy("message").count().collect()
    assert {r["message"]: r["count"] for r in got} == {
        **{f"s0-{i}": 1 for i in range(3)}, **{f"s1-{i}": 2 for i in range(3)}, "batch0": 1, "batch1": 1}
    TB.create_log_table(spark, "streamdb", "logs", lake)
    assert TB.read_table(spark, "streamdb", "logs").count() == 11
    TB.drop_log_table(spark, "streamdb", "logs", drop_database=True)


def test_replay_after_a_mapping_change_moves_nothing(spark, tmp_path):
    lake, state = str(tmp_path / "lake"), str(tmp_path / "state")
    one = spark.createDataFrame([("/ecs/new", "", "auth")], S.CONNECTIONS)
    other = spark.createDataFrame([("/ecs/new", "", "user")], S.CONNECTIONS)
    for conns in (one, other):
        SI.ingest_batch(_records(spark, 4), 0, lambda c=conns: c, lake, None, state_path=state)
    assert [tuple(r) for r in read_logs(spark, lake).groupBy("domain").count().collect()] == [("auth", 4)]


def test_audit_and_file_counts_over_many_batches(spark, tmp_path):
    from loglake.operators.retention import compact
    from loglake.sources.files import list_files

    src, lake, audit = str(tmp_path / "src"), str(tmp_path / "lake"), str(tmp_path / "audit")
    for k in range(20):
        _records(spark, 2, f"b{k}-").coalesce(1).write.mode("append").json(src)
    SI.start_ingest(spark, src, lake, str(tmp_path / "ck"), lambda: FX.connections(spark), trigger={"availableNow": True},
                    max_files_per_trigger=1, audit_path=audit).awaitTermination()
    assert list_files(spark, lake).count() == 20  # one file a batch: all rows are of one day
    assert SI.read_audit(spark, audit).groupBy("disposition").agg(F.sum("records")).collect()[0][1] == 40
    assert compact(spark, lake, "2024-01-06") == 20
    assert list_files(spark, lake).count() == 1 and read_logs(spark, lake).count() == 40


def test_alert_windows_of_fractions_late_rows_and_replays(spark, tmp_path):
    rules = spark.createDataFrame([("short", "auth", None, None, 0.0, 0.01), ("minute", "auth", "ERROR", None, 1.0, 1.0),
                                   ("endless", "auth", None, None, 0.0, float("inf"))], S.RULES)
    row = lambda ms, level="ERROR": (ms, "auth", level, "m")
    frame = lambda rows: spark.createDataFrame(rows, "ms long, domain string, level string, message string").select(
        F.timestamp_millis("ms").alias("timestamp"), "domain", "level", "message")
    out, t = str(tmp_path / "out"), 1_704_412_800_000
    SA.alert_batch(frame([row(t + 30_000), row(t + 200_000)]), 0, lambda: rules, out, "s")
    for _ in range(2):  # late rows, and their batch again
        SA.alert_batch(frame([row(t + 10), row(t + 20, "WARN"), row(t + 700)]), 1, lambda: rules, out, "s")
    got = {(r["name"], r["window_start"][17:]): (r["cnt"], r["exceeded"]) for r in SA.closed_windows(spark, out, rules).collect()}
    assert got == {("minute", "00.000Z"): (3, True), ("short", "00.000Z"): (2, True), ("short", "00.600Z"): (1, True), ("short", "30.000Z"): (1, True)}
    assert SA.closed_windows(spark, out, rules, delay_minutes=10).count() == 0


def test_a_threshold_changed_between_batches_splits_no_window(spark, tmp_path):
    """10 and 10 events of one window, and the threshold lowered in between: one row of 20, held against the new one."""
    from loglake.operators import alerts as AL

    rule = lambda t: spark.createDataFrame([("t", "payment", None, None, t, 60.0)], S.RULES)
    t = 1_704_844_800_000  # 2024-01-10 00:00
    frame = lambda first, n: spark.createDataFrame([(t + 60_000 * (first + i), "payment", "ERROR", "m") for i in range(n)],
                                                   "ms long, domain string, level string, message string").select(
        F.timestamp_millis("ms").alias("timestamp"), "domain", "level", "message")
    out, history = str(tmp_path / "out"), AL.rule_history(rule(25.0))
    SA.alert_batch(frame(0, 10), 0, lambda: history, out, "s")
    history = AL.changed_rules(history, rule(14.0), "2024-01-10 00:15:00")
    SA.alert_batch(frame(30, 10), 1, lambda: history, out, "s")
    SA.alert_batch(frame(70, 1), 2, lambda: history, out, "s")
    seen = lambda h: [tuple(r)[3:] for r in SA.closed_windows(spark, out, h).orderBy("window_start").collect()]
    assert seen(history) == [(20, 14.0, True)]
    # A change after the window's end does not reach it; one from its first moment on does.
    assert seen(AL.changed_rules(history, rule(50.0), "2024-01-10 01:00:00")) == [(20, 14.0, True)]
    assert seen(AL.changed_rules(history, rule(20.0), "2024-01-10 00:59:59.999")) == [(20, 20.0, False)]


def test_versions_by_brute_force(spark, tmp_path):
    """Events in no order over batches, every kind of change: each event counts for the version of its time."""
    import random

    from loglake.operators import alerts as AL

    r = random.Random(5)
    t0 = 1_704_844_800_000
    versions = []  # (from minute or None, rule or None)
    history = None
    minutes = [None, 47, 130, 131, 200, 260]
    for m in minutes:
        rule = ("x", r.choice(["a", "b"]), r.choice(["E", None]), r.choice(["p", None]), float(r.randint(0, 9)), r.choice([60.0, 30.0])) if m != 200 else None
        versions.append((m, rule))
        when = None if m is None else f"2024-01-10 {m // 60:02d}:{m % 60:02d}:00"
        if history is None:
            history = AL.rule_history(spark.createDataFrame([rule], S.RULES))
        elif rule is None:
            history = AL.removed_rules(history, spark.createDataFrame([("x",)], "name string"), when)
        else:
            history = AL.changed_rules(history, spark.createDataFrame([rule], S.RULES), when)
    events = [(t0 + 60_000 * r.randrange(300) + r.randrange(60_000), r.choice("ab"), r.choice("EW"), r.choice(["p q", "q"])) for _ in range(600)]
    out = str(tmp_path / "out")
    for k in range(3):
        SA.alert_batch(spark.createDataFrame(events[k::3], "ms long, domain string, level string, message string").select(
            F.timestamp_millis("ms").alias("timestamp"), "domain", "level", "message"), k, lambda: history, out, "s")
    counts = {}
    for ms, d, lv, text in events:
        m = (ms - t0) / 60_000
        rule = [v for f, v in versions if f is None or f <= m][-1]
        if rule and rule[1] == d and rule[2] in (None, lv) and (rule[3] is None or rule[3] in text):
            key = (int(m // rule[5] * rule[5]), rule[5])
            counts[key] = counts.get(key, 0) + 1
    last = (max(ms for ms, *_ in events) - t0) / 60_000
    want = set()
    for (s, span), n in counts.items():
        if s + span <= last:
            threshold = [v[4] for f, v in versions if v and v[5] == span and (f is None or f < s + span)][-1]
            want.add((s, span, n, threshold, n > threshold))
    got = set()
    for x in SA.closed_windows(spark, out, history).collect():
        a, b = (int(x[c][11:13]) * 60 + int(x[c][14:16]) for c in ("window_start", "window_end"))
        got.add((a, float(b - a), x["cnt"], x["threshold"], x["exceeded"]))
    assert got == want and len(want) > 4


def test_the_audit_is_observed_and_not_aggregated_again(spark, tmp_path, monkeypatch):
    """No job groups the parsed records: the counts come from the pass that writes the batch."""
    from helpers import b64gz, envelope
    from loglake.operators import ingest as I

    rows = [("a", b64gz(envelope(group="/ecs/new", events=[{"id": str(i), "timestamp": 1704412800000 + i, "message": "m"} for i in range(5)]))),
            ("b", b64gz(envelope(mtype="CONTROL_MESSAGE"))), ("c", "no payload"), ("d", b64gz("{")), ("e", b64gz(envelope(events=[])))]
    records = spark.createDataFrame(rows, S.DELIVERY_RECORD).repartition(3)
    monkeypatch.setattr(I, "disposition_counts", lambda *_: (_ for _ in ()).throw(AssertionError("aggregated again")))
    audit = str(tmp_path / "audit")
    for _ in range(2):  # a replay replaces its counts
        SI.ingest_batch(records, 3, lambda: FX.connections(spark), str(tmp_path / "lake"), str(tmp_path / "q"), audit_path=audit)
    assert {r["disposition"]: r["records"] for r in SI.read_audit(spark, audit).collect()} == {"Ok": 5, "Dropped": 2, "ProcessingFailed": 2}
    SI.ingest_batch(records.limit(0), 4, lambda: FX.connections(spark), str(tmp_path / "lake"), None, audit_path=audit)
    assert SI.read_audit(spark, audit).count() == 3
