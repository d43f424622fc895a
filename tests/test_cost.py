from pyspark.sql import Window
from pyspark.sql import functions as F

from loglake import schema as S
from loglake.operators import cost as CO
from loglake.operators.numbering import global_row_number


def test_price():
    assert round(1024 ** 3 * S.USD_PER_BYTE, 6) == 0.004883
    assert round(1024 ** 4 * S.USD_PER_BYTE, 6) == 5.0


def test_totals_and_report(spark, tmp_path):
    empty = spark.createDataFrame([], S.HISTORY)
    t = CO.cost_totals(empty).first()
    assert (t["queries"], t["total_bytes"], t["total_mb"], t["total_usd"]) == (0, 0, 0.0, 0.0)
    h = CO.QueryHistory(spark, str(tmp_path / "history"))
    h.append("x" * 50, 1024 ** 3, "2024-01-01T00:00:02.000Z")
    h.append("y" * 51, 3 * 1024 ** 2, "2024-01-01T00:00:01.000Z")
    rep = CO.cost_report(h.frame()).orderBy("n").collect()
    assert [r["n"] for r in rep] == [1, 2]  # the order they ran in, whatever the clock said
    assert rep[1]["sql_preview"] == "y" * 50 + "..." and rep[1]["mb"] == 3.0
    assert rep[0]["sql_preview"] == "x" * 50 and rep[0]["usd"] == 0.004883
    assert rep[0]["time"] == "2024-01-01T00:00:02"
    t = CO.cost_totals(h.frame()).first()
    assert t["queries"] == 2 and t["total_mb"] == 1027.0
    by_time = CO.cost_report(h.frame().drop("n")).orderBy("n").collect()
    assert [r["mb"] for r in by_time] == [3.0, 1024.0]
    again = CO.QueryHistory(spark, str(tmp_path / "history"))  # a later session goes on counting
    again.append("z", 1)
    assert sorted(r["n"] for r in again.frame().collect()) == [1, 2, 3]


def test_global_row_number_matches_window(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("k"), F.col("id"))
    got = global_row_number(df, [F.col("k"), F.col("id")], num_partitions=7)
    want = df.withColumn("n", F.row_number().over(Window.orderBy("k", "id")))
    assert got.exceptAll(want.select(*got.columns)).count() == 0
    assert got.count() == 5000


def test_result_cache_ttl(spark):
    now = [0.0]
    c = CO.ResultCache(ttl=300, clock=lambda: now[0])
    df = spark.range(3)
    c.put(("q", ()), df)
    assert c.get(("q", ())) is not None
    now[0] = 300.0
    assert c.get(("q", ())) is not None
    now[0] = 300.5
    assert c.get(("q", ())) is None and len(c) == 0


def test_cache_is_bounded(spark):
    c = CO.ResultCache(max_bytes=100)
    a, b = spark.range(3).persist(), spark.range(4).persist()
    c.put("a", a, 80)
    c.put("b", b, 30)
    assert c.get("a") is a and c.get("b") is None and a.is_cached and not b.is_cached


def test_facade_history_and_cache(spark, sf, tmp_path):
    from loglake import fixtures as FX
    from loglake.api import LogLake

    lake = LogLake(spark, FX.lake_path(spark, sf), "parquet", history_path=str(tmp_path / "history"))
    sql = "SELECT level, count(*) AS cnt FROM logs WHERE domain = :d GROUP BY level"
    a = lake.query(sql, {"d": "payment"})
    b = lake.query(sql, {"d": "payment"})
    assert a is b and lake.history.frame().count() == 1
    lake.query("SELECT count(*) AS n FROM logs")
    hist = lake.history.frame().orderBy("n").collect()
    assert 0 < hist[0]["scanned_bytes"] < hist[1]["scanned_bytes"]
    # Bytes are those of the files it reads, though the cache holds a result over the same files.
    from loglake.sources.files import scan_estimate
    assert hist[1]["scanned_bytes"] == scan_estimate(spark, lake.path).first()["scanned_bytes"]
    small = LogLake(spark, FX.lake_path(spark, sf), "parquet", history_path=str(tmp_path / "small"), cache_bytes=0)
    assert small.query("SELECT * FROM logs").count() == FX.logs(spark, sf).count() and len(small.cache) == 0
    assert lake.cost_totals().first()["queries"] == 2


def test_cache_misses_after_a_write(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from loglake import fixtures as FX
    from loglake.api import LogLake
    from loglake.sources.lake import write_logs

    root = str(tmp_path / "lake")
    lg = FX.logs(spark, sf)
    write_logs(lg.where(F.col("day") == "01"), root, "parquet", mode="overwrite")
    ll = LogLake(spark, root, "parquet")
    sql = "SELECT count(*) AS n FROM logs"
    runs = lambda: ll.history.frame().count()
    first = ll.query(sql).first()["n"]
    assert ll.query(sql).first()["n"] == first and runs() == 1   # hit
    write_logs(lg.where(F.col("day") == "02"), root, "parquet", mode="append")
    second = ll.query(sql).first()["n"]                                        # miss: new version
    assert second == first + lg.where(F.col("day") == "02").count()
    assert runs() == 2
    # A writer that is no loglake: a copy of a file, beside it.
    import glob
    import shutil
    some = glob.glob(f"{root}/domain=user/**/*.parquet", recursive=True)[0]
    shutil.copy(some, some.replace(".parquet", "-copy.parquet"))
    extra = spark.read.parquet(some).count()
    assert ll.query(sql).first()["n"] == second + extra and runs() == 3
    assert ll.query("SELECT count(*) AS m FROM logs").first()["m"] == second + extra


def test_several_users_append_to_one_history(spark, tmp_path):
    path = str(tmp_path / "history")
    users = [CO.QueryHistory(spark, path) for _ in range(3)]
    order = [0, 1, 0, 2, 2, 1, 0]
    for i, u in enumerate(order):
        users[u].append(f"q{i}", i, "2024-01-01T00:00:00.000Z")
    rows = sorted((r["n"], r["sql"]) for r in users[0].frame().collect())
    assert rows == [(i + 1, f"q{i}") for i in range(7)]
    assert users[1].fold(min_files=8) == 0 and users[1].fold(min_files=2) == 7
    assert sorted((r["n"], r["sql"]) for r in users[2].frame().collect()) == rows
    users[2].append("later", 1)
    assert max((r["n"], r["sql"]) for r in users[0].frame().collect()) == (8, "later")


def test_a_fold_that_died_counts_no_row_twice(spark, tmp_path, monkeypatch):
    import pytest

    h = CO.QueryHistory(spark, str(tmp_path / "history"))
    for i in range(4):
        h.append(f"q{i}", i)
    monkeypatch.setattr(CO, "delete_files", lambda files: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        h.fold(2)
    monkeypatch.undo()
    assert h.frame().count() == 4 and h.fold(2) == 5 and h.frame().count() == 4
