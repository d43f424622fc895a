"""Read physical plans through the public ``explain`` text."""

from __future__ import annotations

import contextlib
import io
import re
import warnings

from pyspark.sql import DataFrame

from loglake.session import scoped_conf


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def partition_filters(df: DataFrame) -> list[str]:
    """The PartitionFilters of every file scan in the plan (empty lists
    included), in full length."""
    with scoped_conf(df.sparkSession, {"spark.sql.maxMetadataStringLength": "1000000", "spark.sql.debug.maxToStringFields": "10000"}):
        text = plan_text(df, "simple")
    return re.findall(r"PartitionFilters: \[(.*?)\], (?:PushedFilters|ReadSchema|Location|DataFilters)", text)


def prunes_on(filters: str, on: str) -> bool:
    """Whether a scan's filters say more about ``on`` than that it is not null."""
    return re.search(rf"\b{re.escape(on)}#\d+", re.sub(rf"isnotnull\({re.escape(on)}#\d+\)", "", filters)) is not None


def check_pruned(df: DataFrame, on: str = "domain", strict: bool = False) -> bool:
    """Warn (or raise when ``strict``) unless every scan filters on partition key
    ``on`` — the "always include a domain predicate" advice as a check."""
    scans = partition_filters(df)
    ok = bool(scans) and all(prunes_on(f, on) for f in scans)
    if not ok:
        msg = f"query does not prune on partition column {on!r}: some scan reads every {on}"
        if strict:
            raise ValueError(msg)
        warnings.warn(msg, stacklevel=2)
    return ok


def join_strategies(df: DataFrame) -> list[str]:
    return re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|"
                      r"BroadcastNestedLoopJoin|CartesianProduct)", plan_text(df, "simple"))


# ---- scan metrics after execution -------------------------------------------------
# Python has no public handle on a query's SQL metrics, so these two functions use
# Spark's private bridge (``_jdf``). The other use is session.py's, for files.

def _walk(p, out: list) -> list:
    name = p.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _walk(p.executedPlan(), out)
    if name.endswith("QueryStageExec"):
        return _walk(p.plan(), out)
    if name == "InMemoryTableScanExec":
        _walk(p.relation().cachedPlan(), out)
    if name.startswith("FileSourceScan"):
        m = p.metrics()
        out.append({k: int(m.apply(k).value()) for k in ("numFiles", "filesSize", "numOutputRows")
                    if m.contains(k)})
    it = p.children().iterator()
    while it.hasNext():
        _walk(it.next(), out)
    return out


def run_measured(df: DataFrame) -> dict:
    """Execute ``df`` once (results stay on the executors: the plan's RDD is
    only counted) and return files and bytes its file scans selected after
    partition pruning. Persist ``df`` first to keep the results for reuse."""
    qe = df._jdf.queryExecution()
    plan = qe.executedPlan()
    plan.execute().count()
    scans = _walk(plan, [])
    return {"files": sum(s.get("numFiles", 0) for s in scans),
            "scanned_bytes": sum(s.get("filesSize", 0) for s in scans),
            "scans": len(scans)}


def cached_bytes(df: DataFrame) -> int:
    """Bytes that a persisted and computed result takes."""
    return int(str(df._jdf.queryExecution().withCachedData().stats().sizeInBytes()))
