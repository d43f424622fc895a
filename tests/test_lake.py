"""Lake writers/readers, layouts, pruning."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loglake import fixtures as FX
from loglake import schema as S
from loglake.plans.inspect import check_pruned, partition_filters, run_measured
from loglake.sources import files as FL
from loglake.sources import lake as L


def test_roundtrip_both_formats(spark, sf, tmp_path):
    src = FX.logs(spark, sf)
    want = sorted((r["trace_id"], r["domain"], r["day"]) for r in src.collect())
    for fmt in ("parquet", "json"):
        p = str(tmp_path / fmt)
        L.write_logs(src, p, fmt, mode="overwrite")
        back = L.read_logs(spark, p, fmt)
        assert [f.dataType.simpleString() for f in back.schema.fields
                if f.name in S.PARTITION_COLUMNS] == ["string"] * 4
        assert sorted((r["trace_id"], r["domain"], r["day"]) for r in back.collect()) == want
        assert back.where(F.col("timestamp").isNull()).count() == 0
        assert os.path.isdir(os.path.join(p, "domain=payment"))


def test_partition_pruning_and_measured_bytes(spark, sf):
    lake = FX.lake(spark, sf, "parquet")
    q = lake.where((F.col("domain") == "payment") & (F.col("day") == "15")).groupBy("level").count()
    assert any("domain" in f for f in partition_filters(q))
    assert check_pruned(q, strict=True)
    m = run_measured(q)
    whole = run_measured(lake.groupBy("level").count())
    assert 0 < m["scanned_bytes"] < whole["scanned_bytes"]
    assert m["files"] == 1


def test_json_corrupt_lines_and_letter_case(spark, tmp_path):
    d = tmp_path / "domain=user" / "year=2024" / "month=03" / "day=05"
    d.mkdir(parents=True)
    lines = [json.dumps({"timestamp": "2024-03-05T01:02:03.004Z", "level": "ERROR", "message": "a"}),
             json.dumps({"Timestamp": "2024-03-05T01:02:03+00:00", "LEVEL": "WARN", "Message": "b"}),
             "{broken json",
             json.dumps({"timestamp": "not a time", "message": "c"})]
    (d / "part-0.json").write_text("\n".join(lines) + "\n")
    root = str(tmp_path)
    for any_case in (False, True):
        rows = L.read_logs(spark, root, "json", case_insensitive=any_case, keep_corrupt=True).collect()
        assert sum(1 for r in rows if r[S.CORRUPT] is not None) == 1 and len(rows) == 4
        assert {r["month"] for r in rows} == {"03"}
    read = L.read_logs(spark, root, "json")  # any letter case is the default
    assert read._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 2
    ci = {r["message"]: r for r in read.collect()}
    assert ci["b"]["level"] == "WARN" and ci["b"]["timestamp"] is not None
    assert ci["c"]["timestamp"] is None


def test_bare_layout_prunes_files(spark, sf):
    p = FX.bare_lake_path(spark, sf)
    df = L.read_bare_layout(spark, p, "json")
    one = df.where(F.col("domain") == "auth")
    assert run_measured(one)["files"] < run_measured(df)["files"]
    assert one.select("domain").distinct().collect()[0][0] == "auth"
    assert df.count() == FX.logs(spark, sf).count()


def test_quarantine_and_inventory(spark, sf, tmp_path):
    from loglake.operators.ingest import parse_records
    recs = spark.createDataFrame([("r1", "!!"), ("r2", "aGk=")], S.DELIVERY_RECORD)
    L.write_quarantine(parse_records(recs), str(tmp_path / "q"))
    got = spark.read.json(str(tmp_path / "q")).collect()
    assert sorted(r["record_id"] for r in got) == ["r1", "r2"] and all(r["data"] for r in got)
    inv = FL.partition_inventory(spark, FX.lake_path(spark, sf), "parquet")
    tot = inv.agg(F.sum("files"), F.min("bytes")).first()
    assert tot[0] >= inv.count() and tot[1] > 0


def test_hot_partition_is_split(spark, tmp_path):
    """A domain-day holding most rows is written by several tasks (AQE
    splits the rebalance partition), not by one straggler."""
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        n = 300_000
        df = spark.range(n).select(
            F.when(F.col("id") % 3 == 0, F.lit("order")).otherwise(F.lit("payment")).alias("domain"),
            F.timestamp_seconds(F.lit(1706659200) + (F.col("id") % 3 == 0).cast("int") * F.col("id"))
            .alias("timestamp"),
            F.sha2(F.col("id").cast("string"), 256).alias("message"))
        df = df.select("*", F.date_format("timestamp", "yyyy").alias("year"),
                       F.date_format("timestamp", "MM").alias("month"),
                       F.date_format("timestamp", "dd").alias("day"))
        p = str(tmp_path / "skew")
        L.write_logs(df, p, "parquet", mode="overwrite", target_file_mb=None)
        hot = os.path.join(p, "domain=payment", "year=2024", "month=01", "day=31", "ingest_key=main")
        files = [f for f in os.listdir(hot) if f.endswith(".parquet")]
        assert len(files) > 1
        assert L.read_logs(spark, p).count() == n
        assert L.lake_version(spark, p)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)


def test_save_result(spark, tmp_path):
    df = spark.createDataFrame([("ERROR", 3)], "level string, cnt long")
    L.save_result(df, str(tmp_path / "r"))
    back = spark.read.option("header", True).csv(str(tmp_path / "r")).collect()
    assert [(r["level"], r["cnt"]) for r in back] == [("ERROR", "3")]


def test_time_ordered_files_skip_row_groups(spark, tmp_path):
    """INT64 timestamps + time order inside files: a one-hour predicate on a
    day partition reads only the row groups of that hour."""
    from loglake.plans.inspect import _walk

    n = 200_000
    df = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, "payment").otherwise("order").alias("domain"),
        F.timestamp_seconds(F.lit(1706572800) + ((F.col("id") * 7919) % 86400)).alias("timestamp"),
        F.sha2(F.col("id").cast("string"), 256).alias("message"))
    df = df.select("*", F.date_format("timestamp", "yyyy").alias("year"),
                   F.date_format("timestamp", "MM").alias("month"),
                   F.date_format("timestamp", "dd").alias("day"))
    p = str(tmp_path / "lake")
    L.write_logs(df, p, "parquet", mode="overwrite", options={"parquet.block.size": str(1 << 19)})
    q = L.read_logs(spark, p).where((F.col("domain") == "payment") & (
        F.col("timestamp") >= F.to_timestamp(F.lit("2024-01-30 23:00:00"))))
    agg = q.groupBy("domain").count()
    plan = agg._jdf.queryExecution().executedPlan()
    plan.execute().count()
    rows_read = sum(s["numOutputRows"] for s in _walk(plan, []))
    assert rows_read < (n // 2) / 4
    assert q.count() == df.where("domain = 'payment' AND timestamp >= '2024-01-30 23:00:00'").count()


def test_file_cut_and_empty_result_schema(spark, sf, tmp_path):
    from loglake.operators.sql import run_sql

    lg = FX.logs(spark, sf).where(F.col("domain") == "payment")
    p = str(tmp_path / "cut")
    L.write_logs(lg, p, "parquet", mode="overwrite", max_records_per_file=2)
    n_files = sum(len([f for f in fs if f.endswith(".parquet")]) for _, _, fs in os.walk(p))
    assert n_files >= lg.count() / 2
    empty = run_sql(spark, L.read_logs(spark, p),
                    "SELECT level, count(*) AS cnt FROM logs WHERE domain = :d GROUP BY level",
                    {"d": "nope"})
    assert empty.columns == ["level", "cnt"] and empty.count() == 0


def test_inventory_and_scan_bytes_against_filesystem(spark, sf):
    """The two rows-only queries, checked by brute force on the files."""
    root = FX.lake_path(spark, sf, "parquet")
    walk = {}
    for d, _, files in os.walk(root):
        parts = dict(x.split("=", 1) for x in os.path.relpath(d, root).split(os.sep) if "=" in x)
        data = [f for f in files if f.endswith(".parquet")]
        if data:
            key = (parts["domain"], parts["year"], parts["month"], parts["day"])
            n, size = walk.get(key, (0, 0))
            walk[key] = (n + len(data), size + sum(os.path.getsize(os.path.join(d, f)) for f in data))
    inv = {(r["domain"], r["year"], r["month"], r["day"]): (r["files"], r["bytes"])
           for r in FL.partition_inventory(spark, root).collect()}
    assert inv == walk
    day = (F.col("domain") == "payment") & (F.col("year") == "2024") & (F.col("month") == "01") & (F.col("day") == "15")
    assert tuple(FL.scan_estimate(spark, root, predicate=day).first()) == walk[("payment", "2024", "01", "15")]
    whole = tuple(FL.scan_estimate(spark, root).first())
    assert whole == (sum(v[0] for v in walk.values()), sum(v[1] for v in walk.values()))
    # The estimate is what a query reads, data filters or not.
    for df in (FX.lake(spark, sf).where(day).groupBy("level").count(),
               FX.lake(spark, sf).where(day & (F.col("level") == "ERROR")).groupBy("level").count()):
        m = run_measured(df)
        assert (m["files"], m["scanned_bytes"]) == walk[("payment", "2024", "01", "15")]


def test_check_pruned_flags_unpruned_queries(spark, sf):
    import warnings

    import pytest

    lake = FX.lake(spark, sf, "parquet")
    unpruned = lake.groupBy("level").count()
    with pytest.raises(ValueError):
        check_pruned(unpruned, strict=True)
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert check_pruned(unpruned) is False
        assert any("domain" in str(x.message) for x in w)


def test_bare_layout_rewrite_is_idempotent(spark, sf, tmp_path):
    """Files are named by task partition, so writing again (as a retried
    task does) replaces them instead of adding copies."""
    lg = FX.logs(spark, sf).where(F.col("domain").isin("payment", "auth"))
    root = str(tmp_path / "bare")
    L.write_bare_layout(lg, root)
    first = sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs)
    L.write_bare_layout(lg, root)
    second = sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs)
    assert first == second
    assert L.read_bare_layout(spark, root, "json").count() == lg.count()


def test_check_pruned_is_exact(spark, sf):
    import warnings

    lake = FX.lake(spark, sf, "parquet")
    user = lake.where("domain = 'user'")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert not check_pruned(lake.where("domain IS NOT NULL"))
        assert not check_pruned(user.unionByName(lake))
        many = lake.where(F.col("domain").isin([f"d{i:03d}" for i in range(300)]))
        assert check_pruned(many) and check_pruned(user.unionByName(user.where("level = 'ERROR'")))


def test_bare_layout_leaves_failures_out(spark, tmp_path):
    for domain in ("user", S.ERRORS_PREFIX):
        d = tmp_path / domain / "2024" / "03" / "05"
        d.mkdir(parents=True)
        (d / "part-0.json").write_text('{"message": "m", "timestamp": "2024-03-05T00:00:00.000Z"}\n')
    read = L.read_bare_layout(spark, str(tmp_path))
    assert [r["domain"] for r in read.collect()] == ["user"]
    assert L.read_bare_layout(spark, str(tmp_path), dates=("2024-03-06", "2024-03-07")).count() == 0
    assert L.read_bare_layout(spark, str(tmp_path), domains=[S.ERRORS_PREFIX]).count() == 1


def test_listing_reads_no_rows_and_undoes_escapes(spark, tmp_path):
    from loglake.plans.inspect import plan_text

    root = str(tmp_path / "lake")
    rows = spark.createDataFrame([("a:b", "2024", "01", "02", "m+%x")], "domain string, year string, month string, day string, message string")
    L.write_logs(rows.withColumn("timestamp", F.lit("2024-01-02").cast("timestamp")), root, ingest_key="k")
    files = FL.list_files(spark, root)
    assert [tuple(r)[2:] for r in files.collect()] == [("a:b", "2024", "01", "02", "k")]
    assert "content" not in plan_text(files, "simple").split("ReadSchema")[1]
    assert FL.delete_files(files) == 1 and FL.list_files(spark, root).count() == 0
    assert FL.list_files(spark, str(tmp_path / "none")).count() == 0


def test_writes_of_different_keys_add_up_and_equal_keys_replace(spark, sf, tmp_path):
    lg, root = FX.logs(spark, sf), str(tmp_path / "lake")
    n = lg.count()
    for _ in range(2):
        L.write_logs(lg, root, ingest_key="a")
    L.write_logs(lg, root, ingest_key="b")
    L.write_logs(lg, root)
    assert L.read_logs(spark, root).count() == 3 * n
    assert FL.snapshot(spark, root) != FL.snapshot(spark, FX.lake_path(spark, sf))


def test_top_messages_count_hashes_first(spark, monkeypatch):
    """Against a plain count, with ties, few messages and messages that share a hash; the first shuffle has no text."""
    import random
    from collections import Counter

    from loglake.operators import queries as Q
    from loglake.plans.inspect import plan_text

    r = random.Random(4)
    rows = [("2024-01-30 10:00:00", r.choice(["user", "order"]), r.choice(["ERROR", "WARN"]), f"message {int(r.random() ** 2 * 40)}") for _ in range(800)]
    rows += [("2024-01-30 10:00:00", "user", "ERROR", None)] * 30
    logs = spark.createDataFrame(rows, "ts string, domain string, level string, message string").select(
        F.to_timestamp("ts").alias("timestamp"), "domain", "level", "message", F.lit("2024").alias("year"), F.lit("01").alias("month"), F.lit("30").alias("day"))
    counts = Counter(m for _, d, lv, m in rows if (d, lv) == ("user", "ERROR"))
    want = lambda k: sorted(((m, n) for m, n in counts.items()), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))[:k]
    got = lambda k: [(x["message"], x["cnt"]) for x in Q.top_messages(logs, "user", "2024-01-31", 3, k).collect()]
    for k in (1, 5, 17, 500):
        assert got(k) == want(k)
    first = []
    keep = Q.saved
    monkeypatch.setattr(Q, "saved", lambda df, name: first.append((name, plan_text(df, "simple"))) or keep(df, name))
    got(5)
    exchanges = [line for name, text in first if name == "message-counts" for line in text.split("\n") if "HashAggregate" in line or "Exchange" in line]
    assert exchanges and not any("message" in line.split("keys=")[-1].split("functions")[0] for line in exchanges)
    # Everything shares one of three hashes.
    monkeypatch.setattr(F, "xxhash64", lambda c: F.pmod(F.crc32(F.coalesce(F.col(c), F.lit(""))), F.lit(3)))
    for k in (1, 5, 17):
        assert got(k) == want(k)
    assert Q.top_messages(logs, "nobody", "2024-01-31", 3).count() == 0


@pytest.mark.parametrize("hive", [True, False])
def test_only_the_days_asked_for_are_listed(spark, tmp_path, monkeypatch, hive):
    """10,000 days of two domains: a predicate of six days lists its months and nothing else."""
    import datetime as dt

    name = (lambda k, v: f"{k}={v}") if hive else (lambda k, v: v)
    for domain in ("user", "order"):
        for i in range(10_000):
            d = dt.date(2000, 1, 1) + dt.timedelta(days=i)
            os.makedirs(os.path.join(tmp_path, name("domain", domain), name("year", f"{d.year}"), name("month", f"{d.month:02d}"), name("day", f"{d.day:02d}")))
    for day in ("2010-02-27", "2010-03-02", "2010-03-05"):
        y, m, d = day.split("-")
        folder = os.path.join(tmp_path, name("domain", "user"), name("year", y), name("month", m), name("day", d), *(["ingest_key=k"] if hive else []))
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/part-0.json", "w") as f:
            f.write(f'{{"message": "{day}", "timestamp": "{day}T00:00:00.000Z"}}\n')
    listed = []
    keep = L.list_names
    monkeypatch.setattr(L, "list_names", lambda s, p: listed.append(p) or keep(s, p))
    read = (lambda **kw: L.read_logs(spark, str(tmp_path), "json", **kw)) if hive else (lambda **kw: L.read_bare_layout(spark, str(tmp_path), **kw))
    df = read(domains=["user", "none"], dates=("2010-02-26", "2010-03-03"))
    assert sorted((r["message"], r["domain"], r["month"]) for r in df.collect()) == [("2010-02-27", "user", "02"), ("2010-03-02", "user", "03")]
    assert len(listed) == 4 and len(df.inputFiles()) == 2
    listed.clear()
    assert read(dates=("2010-03-05", "2010-03-05")).count() == 1 and len(listed) == 3  # the root, and a month of each domain
    empty = read(domains=["user"], dates=("1999-01-01", "1999-01-31"))
    assert empty.count() == 0 and empty.columns == df.columns
    assert L.months_between("2023-11-30", "2024-02-01") == [("2023", "11"), ("2023", "12"), ("2024", "01"), ("2024", "02")]


def test_days_of_escaped_domains(spark, tmp_path):
    root = str(tmp_path / "lake")
    rows = spark.createDataFrame([("a:b", "2024", "01", "02", "m"), ("c", "2024", "01", "02", "n")], "domain string, year string, month string, day string, message string")
    L.write_logs(rows.withColumn("timestamp", F.lit("2024-01-02").cast("timestamp")), root)
    for domains in (["a:b"], None):
        got = {r["domain"] for r in L.read_logs(spark, root, domains=domains, dates=("2024-01-01", "2024-01-31")).collect()}
        assert got == set(domains or ["a:b", "c"])


def _small_files(spark, root, n=3000, **kw):
    """One day of ``n`` rows of a KB each."""
    text = F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(k)), 512) for k in range(8)])
    rows = spark.range(0, n, 1, 8).select(F.lit("a").alias("domain"), F.lit("2024").alias("year"), F.lit("01").alias("month"), F.lit("02").alias("day"),
                                          F.timestamp_seconds(F.col("id") + 1_704_153_600).alias("timestamp"), text.alias("message"))
    L.write_logs(rows, root, **kw)
    return rows


def test_tasks_of_small_files_are_cut_by_their_number(spark, tmp_path):
    root = str(tmp_path / "lake")
    rows = _small_files(spark, root, max_records_per_file=16)
    names = [os.path.basename(r["path"]) for r in FL.list_files(spark, root).collect()]
    assert len({n.split("-")[1] for n in names}) > 1  # one task of 188 files before
    assert -(-3000 // 16) <= len(names) < 200
    assert sorted(r[0] for r in L.read_logs(spark, root).select("message").collect()) == sorted(r[0] for r in rows.select("message").collect())
    whole = str(tmp_path / "whole")
    _small_files(spark, whole)
    assert FL.list_files(spark, whole).count() == 1


def test_local_files_have_checksums_in_their_pages_only(spark, tmp_path):
    import pyarrow.parquet as pq

    root = str(tmp_path / "lake")
    _small_files(spark, root, n=100)
    found = [os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if "domain=" in d]
    assert len(found) == 1 and found[0].endswith(".parquet")  # no .crc file
    assert pq.ParquetFile(found[0], page_checksum_verification=True).read().num_rows == 100
    data = bytearray(open(found[0], "rb").read())
    data[len(data) // 2] ^= 1
    open(found[0], "wb").write(data)
    with pytest.raises(OSError):
        pq.ParquetFile(found[0], page_checksum_verification=True).read()


def test_only_local_folders_get_the_plain_filesystem(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace as N

    from loglake import session

    assert "RawLocal" in session.local_write_options(spark, str(tmp_path))["fs.file.impl"]
    for scheme, own in (("s3a", None), ("viewfs", None), ("file", "my.LocalFileSystem")):
        fs = N(getUri=lambda s=scheme: N(getScheme=lambda: s), getConf=lambda o=own: N(get=lambda key: o))
        monkeypatch.setattr(session, "_hadoop", lambda spark, path, fs=fs: (path, fs))
        assert session.local_write_options(spark, "x") == {}
