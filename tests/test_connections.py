from loglake import schema as S
from loglake.operators import connections as CN


def test_connections(spark):
    conns = spark.createDataFrame([("/ecs/a", "", "user"), ("/ecs/b", "ERROR", "order")], S.CONNECTIONS)
    doms = spark.createDataFrame([("user", "user/"), ("order", "order/")], S.DOMAINS)
    moved = spark.createDataFrame([("/ecs/a", "WARN", "order"), ("/ecs/c", "", "nope")], S.CONNECTIONS)
    up = {r["log_group"]: (r["filter_pattern"], r["domain"])
          for r in CN.upsert_connections(conns, moved, doms).collect()}
    assert up == {"/ecs/a": ("WARN", "order"), "/ecs/b": ("ERROR", "order")}
    twice = spark.createDataFrame([("/ecs/n", "", "user"), ("/ecs/n", "", "order")], S.CONNECTIONS)
    assert [r["domain"] for r in CN.upsert_connections(conns.limit(0), twice, doms).collect()] == ["order"]
    bad = CN.invalid_connections(moved, doms).collect()
    assert [(r["log_group"], r["error"]) for r in bad] == [("/ecs/c", "unknown domain 'nope'")]
    wrong = spark.createDataFrame([("/ecs/b", "user"), ("/ecs/a", "user")], "log_group string, domain string")
    left = sorted(r["log_group"] for r in CN.remove_connections(conns, wrong).collect())
    assert left == ["/ecs/b"]
    miss = [(r["log_group"], r["domain"]) for r in CN.unmatched_removals(conns, wrong).collect()]
    assert miss == [("/ecs/b", "user")]
    names = spark.createDataFrame([("//ecs/pay/api//", "payment"), ("plain", "x")], "log_group string, domain string")
    got = sorted(r["filter_name"] for r in CN.filter_names(names, prefix="p-").collect())
    assert got == ["p-payment-ecs-pay-api", "p-x-plain"]


def test_filter_name_brute_force(spark):
    import random
    import re

    rnd = random.Random(3)
    groups = ["".join(rnd.choice("/ab-") for _ in range(rnd.randint(0, 9))) for _ in range(300)]
    df = spark.createDataFrame([(g, "d") for g in groups], "log_group string, domain string")
    for r in CN.filter_names(df, prefix="p-").collect():
        trimmed = re.sub(r"^/+|/+$", "", r["log_group"])
        assert r["filter_name"] == "p-d-" + trimmed.replace("/", "-"), r["log_group"]


def _history(spark):
    conn = lambda *rows: spark.createDataFrame(list(rows), S.CONNECTIONS)
    h = CN.connection_history(conn(("/ecs/a", "", "user"), ("/ecs/b", "", "order")))
    h = CN.changed_connections(h, conn(("/ecs/a", "", "auth"), ("/ecs/c", "", "nope")), "2024-01-10 12:00:00",
                               spark.createDataFrame([("user", ""), ("order", ""), ("auth", "")], S.DOMAINS))
    h = CN.changed_connections(h, conn(("/ecs/a", "", "order")), "2024-01-20 00:00:00")
    return CN.removed_connections(h, spark.createDataFrame([("/ecs/b", "order"), ("/ecs/a", "user")], "log_group string, domain string"), "2024-01-15 00:00:00")


def test_events_are_mapped_as_of_their_time(spark):
    import datetime as dt

    from loglake.operators.ingest import map_domain

    h = _history(spark)
    at = lambda t: {r["log_group"]: r["domain"] for r in CN.connections_at(h, t).collect()}
    assert at("2024-01-10 11:59:59") == {"/ecs/a": "user", "/ecs/b": "order"}
    assert at("2024-01-15 00:00:00") == {"/ecs/a": "auth"}  # removed only where the domain of that time matches
    ms = lambda t: int(dt.datetime.fromisoformat(t + "+00:00").timestamp() * 1000)
    times = ["2023-01-01T00:00:00", "2024-01-10T11:59:59.999", "2024-01-10T12:00:00", "2024-01-19T23:59:59.999", "2024-01-20T00:00:00", "2030-01-01T00:00:00"]
    rows = spark.createDataFrame([(g, ms(t), t) for g in ("/ecs/a", "/ecs/b", "/ecs/c", None) for t in times], "log_group string, epoch_ms long, t string")
    got = {(r["log_group"], r["t"]): r["domain"] for r in map_domain(rows, h).collect()}
    assert [got["/ecs/a", t] for t in times] == ["user", "user", "auth", "auth", "order", "order"]
    assert [got["/ecs/b", t] for t in times] == ["order"] * 3 + ["unknown"] * 3
    assert {got[g, t] for g in ("/ecs/c", None) for t in times} == {"unknown"} and len(got) == 24
    assert map_domain(rows, h).columns == map_domain(rows, CN.connections_at(h, "2024-01-01")).columns


def test_late_and_replayed_batches_land_as_of_their_time(spark, tmp_path):
    from helpers import b64gz, envelope
    from loglake.sources.lake import read_logs
    from loglake.streaming import ingest as SI

    h, lake, state = _history(spark), str(tmp_path / "lake"), str(tmp_path / "state")
    events = [{"id": "1", "timestamp": t, "message": str(t)} for t in (1704067200000, 1705276800000, 1706659200000)]  # Jan 1, 15, 31
    records = spark.createDataFrame([("r", b64gz(envelope(group="/ecs/a", events=events)))], S.DELIVERY_RECORD)
    SI.ingest_batch(records, 0, lambda: h, lake, None, state_path=state)
    want = [("user", "01"), ("auth", "15"), ("order", "31")]
    got = lambda: [(r["domain"], r["day"]) for r in read_logs(spark, lake).orderBy("timestamp").collect()]
    assert got() == want
    changed = CN.changed_connections(h, spark.createDataFrame([("/ecs/a", "", "auth")], S.CONNECTIONS), "2024-01-01 00:00:00")
    SI.ingest_batch(records, 0, lambda: changed, lake, None, state_path=state)  # a replay
    assert got() == want
