from loglake import fixtures as FX
from loglake.sources import tables as T
from loglake.sources.lake import write_logs


def test_table_lifecycle(spark, sf, tmp_path):
    root = str(tmp_path / "lake")
    write_logs(FX.logs(spark, sf), root, "parquet", mode="overwrite")
    T.create_log_table(spark, "lakedb", "logs", root, "parquet", domains=FX.DOMAINS)
    T.create_log_table(spark, "lakedb", "logs", root, "parquet", domains=FX.DOMAINS)  # idempotent
    assert "logs" in T.list_tables(spark, "lakedb")
    total = FX.logs(spark, sf).count()
    unknown = FX.logs(spark, sf).where("domain = 'unknown'").count()
    assert T.read_table(spark, "lakedb", "logs").count() == total - unknown
    assert T.read_table(spark, "lakedb", "logs", registered_only=False).count() == total
    T.set_domains(spark, "lakedb", "logs", ["payment"])
    assert T.get_domains(spark, "lakedb", "logs") == ["payment"]
    pay = FX.logs(spark, sf).where("domain = 'payment'").count()
    assert T.read_table(spark, "lakedb", "logs").count() == pay
    T.drop_log_table(spark, "lakedb", "logs")
    assert "logs" not in T.list_tables(spark, "lakedb")
    T.recreate_log_table(spark, "lakedb", "logs", root, "parquet")
    assert T.read_table(spark, "lakedb", "logs").count() == total  # data kept across drop
    T.drop_log_table(spark, "lakedb", "logs", drop_database=True)


def test_identifiers_checked(spark):
    import pytest
    with pytest.raises(ValueError):
        T.create_log_table(spark, "db; DROP", "logs", "/tmp/x")


def test_new_partitions_need_sync_in_catalog(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    root = str(tmp_path / "lake2")
    lg = FX.logs(spark, sf)
    write_logs(lg.where(F.col("day") == "01"), root, "parquet", mode="overwrite")
    T.create_log_table(spark, "lakedb2", "logs", root, "parquet")
    n1 = T.read_table(spark, "lakedb2", "logs").count()
    write_logs(lg.where(F.col("day") == "02"), root, "parquet", mode="append")
    assert T.read_table(spark, "lakedb2", "logs").count() == n1          # not yet visible
    T.sync_partitions(spark, "lakedb2", "logs")
    assert T.read_table(spark, "lakedb2", "logs").count() == n1 + lg.where(F.col("day") == "02").count()
    from loglake.sources.lake import read_logs
    assert read_logs(spark, root).count() == T.read_table(spark, "lakedb2", "logs").count()
    T.drop_log_table(spark, "lakedb2", "logs", drop_database=True)


def test_writes_register_what_they_touch(spark, sf, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    root, lg = str(tmp_path / "lake3"), FX.logs(spark, sf)
    T.create_log_table(spark, "lakedb3", "logs", root, "parquet")
    monkeypatch.setattr(T, "sync_partitions", lambda *a: (_ for _ in ()).throw(AssertionError("repair")))
    odd = lg.limit(3).withColumn("domain", F.lit("it's:odd"))
    for part in (lg.where("day = '03'"), lg.where("day IN ('02', '28')"), odd, lg.limit(0)):
        T.write_to_table(spark, "lakedb3", "logs", part, root)
    assert T.read_table(spark, "lakedb3", "logs").count() == lg.where("day IN ('02', '03', '28')").count() + 3
    assert T.read_table(spark, "lakedb3", "logs").where("domain = \"it's:odd\"").count() == 3
    T.drop_log_table(spark, "lakedb3", "logs", drop_database=True)
