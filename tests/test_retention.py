import os

import pytest
from pyspark.sql import functions as F

from loglake import fixtures as FX
from loglake.operators import retention as RT
from loglake.sources.files import list_files
from loglake.sources.lake import read_logs, write_logs


def _parts(spark, days):
    return spark.createDataFrame([("user", "2024", "01", d) for d in days],
                                 "domain string, year string, month string, day string")


def test_plan_boundaries(spark):
    plan = {r["day"]: (r["age_days"], r["tier"]) for r in
            RT.retention_plan(_parts(spark, ["17", "16", "24", "23", "25"]), "2024-01-31 00:00:00", 14, 7).collect()}
    assert plan == {"17": (14, "expired"), "16": (15, "expired"), "24": (7, "archive"),
                    "23": (8, "archive"), "25": (6, "hot")}
    assert RT.retention_plan(_parts(spark, ["01"]), "2024-01-31", None).count() == 0
    only = RT.retention_plan(_parts(spark, ["20"]), "2024-01-31", 14).first()
    assert only["tier"] == "hot"


def test_apply(spark, sf, tmp_path):
    root, arch = str(tmp_path / "hot"), str(tmp_path / "archive")
    write_logs(FX.logs(spark, sf), root, "parquet", mode="overwrite")
    before = read_logs(spark, root).count()
    plan = RT.retention_plan(list_files(spark, root), FX.AS_OF, FX.RETENTION_DAYS, FX.ARCHIVE_DAYS).cache()
    assert plan.exceptAll(RT.retention_plan(read_logs(spark, root), FX.AS_OF, FX.RETENTION_DAYS, FX.ARCHIVE_DAYS)).count() == 0
    dry = RT.apply_retention(spark, root, plan, dry_run=True).collect()
    assert dry and all(os.path.exists(r["path"].removeprefix("file:")) for r in dry)
    with pytest.raises(ValueError, match="archive_root"):
        RT.apply_retention(spark, root, plan, dry_run=False)
    assert read_logs(spark, root).count() == before
    tiers = {r["tier"]: r["n"] for r in plan.groupBy("tier").count().withColumnRenamed("count", "n").collect()}
    assert set(tiers) == {"hot", "archive", "expired"}
    archived_rows = read_logs(spark, root).join(plan.where("tier = 'archive'"),
                                                ["domain", "year", "month", "day"]).count()
    RT.apply_retention(spark, root, plan, archive_root=arch, dry_run=False)
    hot = read_logs(spark, root)
    assert hot.count() < before
    assert read_logs(spark, arch).count() == archived_rows
    assert RT.retention_plan(hot, FX.AS_OF, 14, 7).where("tier != 'hot'").count() == 0


def test_plan_brute_force(spark):
    import datetime as dt
    import random

    rnd = random.Random(5)
    as_of = dt.date(2024, 3, 1)
    days = sorted({as_of - dt.timedelta(days=rnd.randint(-3, 60)) for _ in range(200)})
    parts = spark.createDataFrame([("x", f"{d.year:04d}", f"{d.month:02d}", f"{d.day:02d}") for d in days],
                                  "domain string, year string, month string, day string")
    got = {(r["year"], r["month"], r["day"]): (r["age_days"], r["tier"])
           for r in RT.retention_plan(parts, "2024-03-01 00:00:00", 30, 10).collect()}
    for d in days:
        age = (as_of - d).days
        tier = "expired" if age >= 30 else "archive" if age >= 10 else "hot"
        assert got[(f"{d.year:04d}", f"{d.month:02d}", f"{d.day:02d}")] == (age, tier)


def _day(spark, day, texts, domain="user"):
    rows = [(f"2024-01-{day} 00:00:00", domain, "2024", "01", day, t) for t in texts]
    df = spark.createDataFrame(rows, "ts string, domain string, year string, month string, day string, message string")
    return df.withColumn("timestamp", F.to_timestamp("ts"))


def test_late_rows_after_archiving_are_kept(spark, tmp_path):
    hot, cold = str(tmp_path / "hot"), str(tmp_path / "cold")

    def age():
        plan = RT.retention_plan(list_files(spark, hot), "2024-01-31", 90, 7)
        RT.apply_retention(spark, hot, plan, archive_root=cold, dry_run=False)

    write_logs(_day(spark, "20", ["a", "b"]), hot, mode="overwrite")
    age()
    write_logs(_day(spark, "20", ["late"]), hot, mode="overwrite")  # the same key and day again
    age()
    assert sorted(r["message"] for r in read_logs(spark, cold).collect()) == ["a", "b", "late"]
    assert list_files(spark, hot).count() == 0


def test_a_copy_made_again_replaces_itself(spark, tmp_path):
    """As after a run that died between the copy and the deletes."""
    hot, cold = str(tmp_path / "hot"), str(tmp_path / "cold")
    write_logs(_day(spark, "20", ["a", "b"]), hot)
    files = list_files(spark, hot)
    for _ in range(2):
        RT.copy_files(spark, hot, files, cold)
    assert read_logs(spark, cold).count() == 2


def test_escaped_names_and_archive_expiry(spark, tmp_path):
    hot, cold = str(tmp_path / "hot"), str(tmp_path / "cold")
    write_logs(_day(spark, "01", ["old"], "a:b"), hot)
    write_logs(_day(spark, "20", ["kept"], "a:b"), hot)
    RT.apply_retention(spark, hot, RT.retention_plan(list_files(spark, hot), "2024-01-31", 30, 7), archive_root=cold, dry_run=False)
    assert list_files(spark, hot).count() == 0
    assert [r["message"] for r in read_logs(spark, cold).collect()] == ["kept"]
    RT.expire_archive(spark, cold, "2024-01-31", 11, dry_run=False)
    assert list_files(spark, cold).count() == 0


def test_compaction(spark, tmp_path):
    root = str(tmp_path / "lake")
    for k in range(6):
        write_logs(_day(spark, "10", [f"m{k}"]), root)
        write_logs(_day(spark, "30", [f"n{k}"]), root)
    want = sorted(r["message"] for r in read_logs(spark, root).collect())
    assert RT.compact(spark, root, "2024-01-30") == 6
    assert sorted(r["message"] for r in read_logs(spark, root).collect()) == want
    days = {r["day"]: r["n"] for r in list_files(spark, root).groupBy("day").count().withColumnRenamed("count", "n").collect()}
    assert days == {"10": 1, "30": 6}
    assert RT.compact(spark, root, "2024-01-30") == 0


@pytest.mark.parametrize("written", [True, False])
def test_compaction_that_died_is_finished(spark, tmp_path, monkeypatch, written):
    root = str(tmp_path / "lake")
    for k in range(3):
        write_logs(_day(spark, "10", [f"m{k}"]), root)
    if written:  # dies before the deletes
        monkeypatch.setattr(RT, "_finish_compaction", _lost)
    else:  # dies after the copy, before it is known to be whole
        write = RT.write_text
        monkeypatch.setattr(RT, "write_text", lambda s, p, t: write(s, p, t) if "WRITTEN" not in p else _lost())
    with pytest.raises(RuntimeError):
        RT.compact(spark, root, "2024-01-30")
    monkeypatch.undo()
    assert read_logs(spark, root).count() == 6
    with pytest.raises(RuntimeError, match="another run holds"):
        RT.compact(spark, root, "2024-01-30")
    RT.compact(spark, root, "2024-01-30", lease_seconds=0)
    assert sorted(r["message"] for r in read_logs(spark, root).collect()) == ["m0", "m1", "m2"]
    assert list_files(spark, root).count() == 1
    assert RT.compact(spark, root, "2024-01-30") == 0


def _lost(*_):
    raise RuntimeError("lost")


def test_compaction_that_was_taken_over_deletes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "lake")
    for k in range(3):
        write_logs(_day(spark, "10", [f"m{k}"]), root)
    copy = RT.copy_files

    def slow(*args, **kw):  # another run comes while this one writes
        monkeypatch.setattr(RT, "copy_files", copy)
        copy(*args, **kw)
        assert RT.compact(spark, root, "2024-01-30", lease_seconds=0) == 3

    monkeypatch.setattr(RT, "copy_files", slow)
    with pytest.raises(RuntimeError, match="taken"):
        RT.compact(spark, root, "2024-01-30")
    assert sorted(r["message"] for r in read_logs(spark, root).collect()) == ["m0", "m1", "m2"]


def test_compaction_packs_small_files_only(spark, tmp_path):
    """Sizes in units of the files written here: a bin is full, a large file stays, a late one meets small ones only."""
    big, small = "".join(chr(97 + i * i % 26) for i in range(500)), [f"m{k}" for k in range(9)]
    root = str(tmp_path / "lake")
    for k in small:
        write_logs(_day(spark, "10", [k]), root)
    write_logs(_day(spark, "10", [big + str(i * 7919 % 10007) for i in range(40_000)]), root, "parquet")
    sizes = sorted(r["bytes"] for r in list_files(spark, root).collect())
    assert sizes[-1] > (1 << 20) * 0.5 > 9 * sizes[0]
    want = sorted(r["message"] for r in read_logs(spark, root).collect())
    large = [r["path"] for r in list_files(spark, root).collect() if r["bytes"] == sizes[-1]]
    compact = lambda: RT.compact(spark, root, "2024-01-30", target_mb=1)
    assert compact() == 9 and compact() == 0
    write_logs(_day(spark, "10", ["late"]), root)
    assert compact() == 2 and compact() == 0  # the late file and the packed one
    assert sorted(r["message"] for r in read_logs(spark, root).collect()) == sorted([*want, "late"])
    assert [r["path"] for r in list_files(spark, root).collect() if r["bytes"] == sizes[-1]] == large


def test_compaction_bins_by_brute_force(spark):
    import random

    r = random.Random(2)
    schema = "path string, bytes long, domain string, year string, month string, day string, ingest_key string"
    rows = [(f"p{i}", r.choice((1, 9, 30, 31, 33, 64, 300)) << 20, r.choice("ab"), "2024", "01", r.choice(("10", "11", "30")),
             r.choice(("k", "compact-full-x", "compact-part-y"))) for i in range(300)]
    got = RT.compaction_plan(spark.createDataFrame(rows, schema), "2024-01-30", target_mb=64).collect()
    want = {}
    for domain in "ab":
        for day in ("10", "11"):
            total, bins = 0, {}
            for path, size, *_ in sorted((x for x in rows if x[2] == domain and x[5] == day and x[1] < 32 << 20 and x[6] != "compact-full-x"),
                                         key=lambda x: (x[1], x[0])):
                bins.setdefault(total // (64 << 20), []).append((path, size))
                total += size
            for members in bins.values():
                if len(members) > 1:
                    full = sum(s for _, s in members) >= 32 << 20
                    want |= {p: (frozenset(x for x, _ in members), full) for p, _ in members}
    by_key = {}
    for x in got:
        by_key.setdefault((x["domain"], x["day"], x["new_key"]), set()).add(x["path"])
    assert {p: (frozenset(m), k[2].startswith("compact-full")) for k, m in by_key.items() for p in m} == want and want


def _lake_of_parts(spark, tmp_path):
    """Days of every tier; the tasks that wrote them cut their rows into several files (.c000, .c001, ...)."""
    hot, cold = str(tmp_path / "hot"), str(tmp_path / "cold")
    for day in ("02", "20", "30"):
        write_logs(_day(spark, day, [f"{day}-{i}" for i in range(20)]), hot, max_records_per_file=5)
    assert any(".c003." in r["path"] for r in list_files(spark, hot).collect())
    return hot, cold


def _messages(spark, *roots):
    return sorted(r["message"] for root in roots if os.path.exists(root) for r in read_logs(spark, root).collect())


@pytest.mark.parametrize("by_rows", [False, True])
@pytest.mark.parametrize("step", ["copies", "some copies", "copied", "some deletes", "deleted", "end"])
def test_retention_killed_after_each_step(spark, tmp_path, monkeypatch, step, by_rows):
    hot, cold = _lake_of_parts(spark, tmp_path)
    plan = RT.retention_plan(list_files(spark, hot), "2024-01-31", 20, 7).cache()
    note = RT.Journal.note
    if by_rows:  # as for stores that tasks do not reach by themselves
        monkeypatch.setattr(RT, "tasks_reach", lambda path: False)

    def dying(self, done, state):
        if (state, step) in (("copied", "some copies"), ("deleted", "some deletes")):
            list_ = done.select("path").collect() if by_rows and state == "deleted" else None
            if by_rows and state == "copied":
                RT.copy_files(spark, hot, self.files().where("target is not null").limit(2), cold)
            elif list_ is None:
                done.limit(2).collect()  # some tasks have run, their job has not ended
            _lost()
        if (state, step) in (("copied", "copies"),):
            done.collect()
            _lost()
        note(self, done, state)
        if (state, step) in (("copied", "copied"), ("deleted", "deleted")):
            _lost()

    monkeypatch.setattr(RT.Journal, "note", dying)
    if step == "end":
        monkeypatch.setattr(RT.Journal, "end", _lost)
    with pytest.raises(RuntimeError, match="lost"):
        RT.apply_retention(spark, hot, plan, archive_root=cold, dry_run=False)
    monkeypatch.setattr(RT.Journal, "note", note)
    if step == "end":
        monkeypatch.undo()
    assert RT.resume_retention(spark, hot) == 1 and RT.resume_retention(spark, hot) == 0
    assert _messages(spark, hot) == sorted(f"30-{i}" for i in range(20))
    assert _messages(spark, cold) == sorted(f"20-{i}" for i in range(20))


def test_the_next_run_finishes_first_and_lists_then(spark, tmp_path):
    hot, cold = _lake_of_parts(spark, tmp_path)
    days = _parts(spark, ["02", "20", "30"])
    plan = RT.retention_plan(days, "2024-01-31", 20, 7)
    RT.copy_planned(spark, hot, RT.begin_retention(spark, hot, plan, archive_root=cold))
    write_logs(_day(spark, "20", ["late"]), hot)
    assert len(_messages(spark, hot, cold)) == 81
    moved = RT.apply_retention(spark, hot, plan, archive_root=cold, dry_run=False).collect()
    assert [r["tier"] for r in moved] == ["archive"]
    assert _messages(spark, hot) == sorted(f"30-{i}" for i in range(20))
    assert _messages(spark, cold) == sorted(["late", *(f"20-{i}" for i in range(20))])


def test_moved_files_keep_their_bytes(spark, tmp_path):
    hot, cold = _lake_of_parts(spark, tmp_path)
    before = {r["path"].replace("/hot/", "/cold/"): open(r["path"].removeprefix("file:"), "rb").read() for r in list_files(spark, hot).where("day = '20'").collect()}
    RT.apply_retention(spark, hot, RT.retention_plan(list_files(spark, hot), "2024-01-31", 20, 7), archive_root=cold, dry_run=False)
    assert {r["path"]: open(r["path"].removeprefix("file:"), "rb").read() for r in list_files(spark, cold).collect()} == before


def test_which_stores_tasks_reach(tmp_path):
    from loglake.sources.files import tasks_reach

    assert tasks_reach(f"file:{tmp_path}/a%3Ab c") and not tasks_reach("s3a://bucket/key") and not tasks_reach("viewfs://in/x")


def test_a_listing_takes_few_tasks(spark, tmp_path, monkeypatch):
    hot, tasks, begin = str(tmp_path / "hot"), [], RT.Journal.begin
    write_logs(_day(spark, "20", [str(i) for i in range(400)]), hot, max_records_per_file=1)

    def seen(folder, files, about=""):
        tasks.append(list_files(spark, hot).rdd.getNumPartitions())
        return begin(folder, files, about)

    monkeypatch.setattr(RT.Journal, "begin", seen)
    was = spark.conf.get("spark.sql.files.openCostInBytes")
    journal = RT.begin_retention(spark, hot, RT.retention_plan(list_files(spark, hot), "2024-01-31", 20, 7), archive_root=f"{hot}-cold")
    assert journal.planned().count() == 400 and tasks[0] <= spark.sparkContext.defaultParallelism + 1  # one for each 32 files before
    assert spark.conf.get("spark.sql.files.openCostInBytes") == was
