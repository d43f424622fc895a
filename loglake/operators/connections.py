"""Connections: which log group feeds which domain, with which filter.

A history of connections keeps every mapping with the time from which it holds, so
an event can be mapped as of its own time, however late it comes or is replayed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.functions.text import filter_name as _filter_name
from loglake.operators.versions import as_history, held_at, lifetimes, removals


def invalid_connections(new: DataFrame, domains: DataFrame) -> DataFrame:
    """Rows whose domain is not registered, with the reason."""
    return (new.join(domains.select(F.col("name").alias("domain")), "domain", "left_anti")
            .select("log_group", "domain",
                    F.format_string("unknown domain '%s'", F.col("domain")).alias("error")))


def unique_connections(conns: DataFrame) -> DataFrame:
    """One row per log group: of several, the smallest row."""
    rest = [c for c in conns.columns if c != "log_group"]
    return (conns.groupBy("log_group").agg(F.min(F.struct(*rest)).alias("_c"))
            .select("log_group", *[F.col("_c")[c].alias(c) for c in rest]).select(*conns.columns))


def upsert_connections(conns: DataFrame, new: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """One row per log group: a new row replaces the group's old one (its
    pattern and domain). With ``domains``, rows of unknown domains are
    rejected first."""
    if domains is not None:
        new = new.join(domains.select(F.col("name").alias("domain")), "domain", "left_semi")
    new = new.select(*conns.columns)
    kept = conns.join(new.select("log_group"), "log_group", "left_anti").select(*conns.columns)
    return unique_connections(kept.unionByName(new))


def remove_connections(conns: DataFrame, to_remove: DataFrame) -> DataFrame:
    """Remove only where both the group and the domain match."""
    return conns.join(to_remove.select("log_group", "domain"), ["log_group", "domain"], "left_anti")


def filter_names(conns: DataFrame, prefix: str = "loglake-") -> DataFrame:
    return conns.select("log_group", "domain",
                        _filter_name(F.col("log_group"), F.col("domain"), prefix).alias("filter_name"))


def unmatched_removals(conns: DataFrame, to_remove: DataFrame) -> DataFrame:
    """(log_group, domain) pairs asked for removal that match no connection,
    e.g. the right group with the wrong domain."""
    return to_remove.select("log_group", "domain").join(
        conns.select("log_group", "domain"), ["log_group", "domain"], "left_anti")


# ---- mapping history ---------------------------------------------------------------

_CONNECTION = ["filter_pattern", "domain"]


def connection_history(conns: DataFrame, at=None) -> DataFrame:
    """Connections as versions that hold from ``at`` on; always, without it."""
    return as_history(conns, ["log_group", *_CONNECTION], at)


def changed_connections(history: DataFrame, new: DataFrame, at, domains: DataFrame | None = None) -> DataFrame:
    """The history with groups connected, or mapped anew, from ``at`` on; with ``domains``, to known ones only."""
    if domains is not None:
        new = new.join(domains.select(F.col("name").alias("domain")), "domain", "left_semi")
    return history.unionByName(connection_history(unique_connections(new.select("log_group", *_CONNECTION)), at))


def removed_connections(history: DataFrame, to_remove: DataFrame, at) -> DataFrame:
    """The history with groups disconnected from ``at`` on, where the domain they have then matches."""
    gone = connections_at(history, at).join(to_remove.select("log_group", "domain"), ["log_group", "domain"], "left_semi")
    return history.unionByName(removals(history, gone, "log_group", at))


def connections_at(history: DataFrame, as_of) -> DataFrame:
    """The connections that hold at a time."""
    return held_at(history, "log_group", _CONNECTION, as_of)


def mapping_lifetimes(history: DataFrame) -> DataFrame:
    """log_group, domain, r_from, r_to of every mapping."""
    return lifetimes(history, "log_group", ["domain"])
