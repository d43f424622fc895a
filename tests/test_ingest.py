"""Transform edge cases (hand-made envelopes)."""

import base64
import json

from pyspark.sql import functions as F

from helpers import b64gz, envelope
from loglake import schema as S
from loglake.operators import ingest as I

CONN = [("/ecs/payment-api", "", "payment"), ("/ecs/order-api", "", "order")]


def _run(spark, records):
    df = spark.createDataFrame(records, S.DELIVERY_RECORD)
    conns = spark.createDataFrame(CONN, S.CONNECTIONS)
    rows, parsed = I.transform(df, conns)
    disp = {r["record_id"]: (r["disposition"], r["reason"]) for r in parsed.collect()}
    return rows, disp


def test_dispositions(spark):
    ev = [{"id": "1", "timestamp": 1706659200000, "message": "ERROR boom"}]
    records = [
        ("ok", b64gz(envelope(events=ev))),
        ("control", b64gz(envelope(mtype="CONTROL_MESSAGE", events=ev))),
        ("empty", b64gz(envelope(events=[]))),
        ("null_events", b64gz(envelope(events=None) | {"logEvents": None})),
        ("bad_b64", "!!!not base64!!!"),
        ("not_gzip", "aGVsbG8gd29ybGQ="),
        ("not_json", b64gz("{bad json")),
        ("array_json", b64gz("[]")),
        ("empty_obj", b64gz("{}")),
        ("no_ts", b64gz(envelope(events=ev + [{"id": "2", "message": "x"}]))),
        ("bad_ts", b64gz('{"messageType":"DATA_MESSAGE","logGroup":"g","logEvents":[{"timestamp":"abc"}]}')),
        ("control_broken", b64gz('{"messageType":"CONTROL_MESSAGE","logEvents":"oops"}')),
        ("control_truncated", b64gz('{"messageType":"CONTROL_MESSAGE","logEvents":[{"id":')),
        ("empty_text", b64gz("")),
        ("trailing", b64gz(json.dumps(envelope(events=ev)) + " junk")),
        ("twice", b64gz(json.dumps(envelope(events=ev)) * 2)),
        ("single_quotes", b64gz(str(envelope(events=[{"timestamp": 1706659200000}])))),
        ("array", b64gz(json.dumps([envelope(events=ev)]))),
        ("padded", base64.b64encode(base64.b64decode(b64gz(envelope(events=ev))) + bytes(8)).decode()),
        ("fraction", b64gz(json.dumps(envelope(events=ev)).replace("1706659200000", "1706659200000.0"))),
    ]
    rows, d = _run(spark, records)
    assert d["ok"][0] == S.OK
    assert d["control"][0] == S.DROPPED
    assert d["empty"][0] == S.DROPPED
    assert d["null_events"][0] == S.DROPPED
    assert d["bad_b64"] == (S.FAILED, "not base64")
    assert d["not_gzip"] == (S.FAILED, "not gzip or not UTF-8")
    assert d["not_json"] == (S.FAILED, "not JSON")
    assert d["array_json"][0] == S.FAILED
    assert d["empty_obj"][0] == S.DROPPED
    # One event without a timestamp fails the whole envelope: no partial rows.
    assert d["no_ts"][0] == S.FAILED
    assert d["bad_ts"][0] == S.FAILED
    # The type is tested before events are read.
    assert d["control_broken"][0] == S.DROPPED
    # Broken JSON fails even when its type field was read before the break.
    assert d["control_truncated"] == (S.FAILED, "not JSON")
    assert d["empty_text"] == (S.FAILED, "not JSON")
    for kind in ("trailing", "twice", "single_quotes", "array"):
        assert d[kind] == (S.FAILED, "not JSON"), kind
    assert d["padded"][0] == d["fraction"][0] == S.OK
    assert [str(r["timestamp"]) for r in rows.collect()] == ["2024-01-31 00:00:00"] * 3


def test_rows_defaults_and_mapping(spark):
    ev = [{"id": "1", "timestamp": 1706659200000, "message": "héllo — 世界"},
          {"id": "2", "timestamp": 1706659201234},
          {"id": "3", "timestamp": 1706659199999, "message": None}]
    records = [("a", b64gz(envelope(events=ev))),
               ("b", b64gz(envelope(group="/ecs/elsewhere", events=ev[:1]))),
               ("c", b64gz({"messageType": "DATA_MESSAGE", "logEvents": ev[:1]}))]
    rows, d = _run(spark, records)
    out = I.to_json_line(rows).collect()
    got = sorted((r["domain"], r["log_group"], r["message"], r["year"], r["month"], r["day"])
                 for r in rows.collect())
    assert ("payment", "/ecs/payment-api", "héllo — 世界", "2024", "01", "31") in got
    assert ("payment", "/ecs/payment-api", "", "2024", "01", "31") in got
    # 1706659199999 ms is the last millisecond of 2024-01-30 (UTC).
    assert ("payment", "/ecs/payment-api", "", "2024", "01", "30") in got
    assert ("unknown", "/ecs/elsewhere", "héllo — 世界", "2024", "01", "31") in got
    assert ("unknown", "", "héllo — 世界", "2024", "01", "31") in got
    iso = sorted(r["value"] for r in out)
    assert any('"timestamp":"2024-01-31T00:00:01.234Z"' in v for v in iso)
    assert any('"timestamp":"2024-01-31T00:00:00.000Z"' in v for v in iso)
    assert any("世界" in v for v in iso)


def test_disposition_counts(spark):
    ev = [{"id": str(i), "timestamp": 1706659200000 + i, "message": "m"} for i in range(3)]
    records = [("a", b64gz(envelope(events=ev))), ("b", "###"),
               ("c", b64gz(envelope(mtype="CONTROL_MESSAGE", events=ev)))]
    df = spark.createDataFrame(records, S.DELIVERY_RECORD)
    parsed = I.parse_records(df)
    got = {r["disposition"]: r["records"] for r in I.disposition_counts(parsed).collect()}
    assert got == {S.OK: 3, S.FAILED: 1, S.DROPPED: 1}


def test_subscription_filter(spark):
    ev = spark.createDataFrame(
        [("/ecs/payment-api", "error --- x"), ("/ecs/payment-api", "view --- x"),
         ("/ecs/order-api", "view"), ("/ecs/none", "error")], "log_group string, message string")
    conns = spark.createDataFrame([("/ecs/payment-api", "error", "payment"),
                                   ("/ecs/order-api", "", "order")], S.CONNECTIONS)
    got = sorted((r["log_group"], r["message"], r["domain"])
                 for r in I.subscription_filter(ev, conns).collect())
    assert got == [("/ecs/order-api", "view", "order"), ("/ecs/payment-api", "error --- x", "payment")]


def test_map_domain_is_broadcast(spark):
    rows = spark.range(100).select(F.when(F.col("id") % 2 == 0, "/ecs/order-api")
                                   .otherwise(F.concat(F.lit("/g/"), F.col("id").cast("string")))
                                   .alias("log_group"))
    conns = spark.createDataFrame(CONN, S.CONNECTIONS)
    from loglake.plans.inspect import join_strategies
    out = I.map_domain(rows, conns)
    assert I.map_domain(spark.createDataFrame([(None,)], "log_group string"), conns.union(
        spark.createDataFrame([(None, "", "user")], S.CONNECTIONS))).first()["domain"] == "unknown"
    assert len(join_strategies(out)) == 1
    got = dict(out.groupBy("domain").count().collect())
    assert got == {"order": 50, "unknown": 50}


def test_fixture_envelopes_are_bounded(spark, sf):
    from loglake import fixtures as FX

    recs = FX.encode_envelopes(FX.logs(spark, sf), with_faults=False)
    parsed = I.parse_records(recs)
    sizes = parsed.select(F.size("env.logEvents").alias("n"))
    assert sizes.agg(F.max("n")).first()[0] <= FX.EVENTS_PER_ENVELOPE
    assert sizes.agg(F.sum("n")).first()[0] == FX.logs(spark, sf).count()


def test_decode_runs_gunzip_and_parse_once(spark):
    """Regression guard: a pushed-down disposition filter made Spark run the
    gunzip UDF and from_json twice per record."""
    from loglake.plans.inspect import plan_text

    ev = [{"id": "1", "timestamp": 1706659200000, "message": "m"}]
    df = spark.createDataFrame([("a", b64gz(envelope(events=ev)))], S.DELIVERY_RECORD)
    rows, _ = I.transform(df, spark.createDataFrame(CONN, S.CONNECTIONS))
    text = plan_text(rows, "simple")
    assert text.count("ArrowEvalPython") == 1
    assert text.count("from_json(") == 1


def test_codec_gives_results_back_in_parts(spark):
    """A batch of long texts comes back in parts of bounded size, complete and in order."""
    import pyarrow as pa

    from loglake.functions import codec as C

    n = 40
    texts = [None if i % 7 == 3 else json.dumps({"i": i, "t": "x" * (3 * C.PART_BYTES if i == 5 else C.PART_BYTES // 4)}) for i in range(n)]
    packed = [x for part in C.gzip_base64.func(iter([pa.array(texts[:9]), pa.array(texts[9:])])) for x in part.to_pylist()]
    blobs = [p and base64.b64decode(p) for p in packed]
    parts = [p.to_pylist() for p in C.gunzip_json.func(iter([pa.array([], pa.binary()), pa.array(blobs)]))]
    assert [x["text"] for p in parts for x in p] == texts
    assert [x["is_object"] for p in parts for x in p] == [t and True for t in texts]
    assert all(sum(len(x["text"] or "") for x in p[:-1]) < C.PART_BYTES for p in parts)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = df.select("i", C.gzip_base64("t").alias("z"), C.gzip_base64_padded("t").alias("p")).select(
        "i", *[C.gunzip_json(F.unbase64(c))["text"].alias(c) for c in "zp"]).collect()
    assert {x["i"]: (x["z"], x["p"]) for x in got} == {i: (t, t) for i, t in enumerate(texts)}
