"""Threshold alerts: every rule counted in one scan of the logs.

The plan: prune the logs to the oldest window start (partition + row-group
pruning), then one equi-join on ``(domain, level)`` with the per-rule keyword
and window predicate as the residual, then a count per rule (partial aggregation before the
shuffle, so only one row per rule and task crosses the network). A rule without
a level meets a second copy of each row, whose level is empty. Spark chooses
the join from the sizes it knows; there is one plan for any number of rules.

Where one (domain, level) has more than GRAM_RULES rules with a keyword, these are not tested one by one:
each is found by its rarest piece of GRAM characters, which joins the equi-join's keys, and only
the rows and rules that meet there are compared. A keyword with shorter literal
stretches only is found by one of these. Keywords of wildcards alone have none and stay a residual.
Rules with no match report 0; invalid rules report status ERROR and leave the
others alone.

A rule history keeps every version of a rule with the time from which it holds.
"""

from __future__ import annotations

import datetime as _dt

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.functions.text import grams, keyword_match, needed_grams
from loglake.functions.time import date_bound, parse_as_of, ts_literal
from loglake.operators.versions import as_history, held_at, lifetimes, micros_of, removals
from loglake.session import saved

OK_STATUS, EXCEEDED, ERROR = "OK", "EXCEEDED", "ERROR"
#: Longest period a rule may have: ten years.
MAX_PERIOD_MINUTES = 5_256_000.0
#: Rules named in one notification.
PAYLOAD_LINES = 1000
#: Level of the copy of a row that meets rules without a level; no rule can name it.
ANY_LEVEL = ""
#: Keyword rules of one (domain, level) that are tested one by one, the length of the pieces
#: the others are found by, rules of these that are broadcast at a time, and log rows
#: looked at to tell how frequent a piece is (this only orders the choice).
GRAM_RULES = 64
GRAM = 3
BLOCK_RULES = 100_000
SAMPLE_ROWS = 2_000
_RULE = ("domain", "level", "keyword", "threshold", "period_minutes")


def _blank_to_null(c: str):
    return F.when(F.trim(F.col(c)) == "", F.lit(None)).otherwise(F.col(c))


def unique_rules(rules: DataFrame) -> DataFrame:
    """One row per name: of rules that share a name, the smallest row."""
    return (rules.groupBy("name").agg(F.min(F.struct(*_RULE)).alias("_r"))
            .select("name", *[F.col("_r")[c].alias(c) for c in _RULE]).select(*rules.columns))


def validate_rules(rules: DataFrame) -> DataFrame:
    """Add ``error``: why a rule cannot run, or null."""
    period = F.col("period_minutes")
    err = (F.when(F.col("name").isNull() | (F.col("name") == ""), F.lit("name is required"))
           .when(F.col("domain").isNull() | (F.col("domain") == ""), F.lit("domain is required"))
           .when(F.col("threshold").isNull() | F.isnan("threshold") | (F.col("threshold") < 0),
                 F.lit("threshold must be a number >= 0"))
           .when(period.isNull() | F.isnan(period) | (period * 60_000 < 1), F.lit("period_minutes must be a number > 0"))
           .when(period > MAX_PERIOD_MINUTES, F.lit("period_minutes must be at most ten years")))
    return rules.withColumn("error", err)


def invalid_rules(rules: DataFrame) -> DataFrame:
    return validate_rules(rules).where(F.col("error").isNotNull()).select("name", "error")


def _side(rules: DataFrame, *more: str) -> DataFrame:
    """Valid rules as the join needs them, one row each."""
    return validate_rules(rules).where(F.col("error").isNull()).select(
        "name", F.col("domain").alias("r_domain"), F.coalesce(_blank_to_null("level"), F.lit(ANY_LEVEL)).alias("r_level"),
        _blank_to_null("keyword").alias("r_keyword"), "threshold", "period_minutes", *more)


def rule_side(rules: DataFrame) -> DataFrame:
    """Valid rules as the join needs them; the level of a rule without one is empty."""
    return _side(unique_rules(rules))


class Profile(NamedTuple):
    """What a plan has to know about the rules it joins."""

    longest: float  # period, minutes
    any_level: bool
    keywords: int
    crowd: int  # keyword rules of one (domain, level)


def rule_profile(side: DataFrame) -> Profile:
    each = side.groupBy("r_domain", "r_level").agg(
        F.max("period_minutes").alias("longest"), F.count("r_keyword").alias("keywords"))
    row = each.agg(F.max("longest"), F.max(F.col("r_level") == ANY_LEVEL), F.sum("keywords"), F.max("keywords")).first()
    return Profile(*(x or 0 for x in row))


def with_gram(side: DataFrame, logs: DataFrame, keyword_mode: str) -> DataFrame:
    """The rules with ``r_gram``, the piece of the keyword that is rarest: in how many rules of
    the same (domain, level) it is, times how often it was seen in some log rows. Null without any."""
    pieces = side.select("name", "r_domain", "r_level", F.explode(needed_grams(F.col("r_keyword"), keyword_mode, GRAM)).alias("r_gram"))
    shared = pieces.groupBy("r_domain", "r_level", "r_gram").agg(F.count(F.lit(1)).alias("_rules"))
    seen = (logs.select("message").limit(SAMPLE_ROWS).select(F.explode(grams(F.col("message"), GRAM)).alias("r_gram"))
            .groupBy("r_gram").agg(F.count(F.lit(1)).alias("_seen")))
    cost = F.col("_rules") * (F.coalesce(F.col("_seen"), F.lit(0)) + 1)
    best = (pieces.join(shared, ["r_domain", "r_level", "r_gram"]).join(seen, "r_gram", "left")
            .groupBy("name").agg(F.min(F.struct(cost.alias("cost"), "r_gram")).alias("_best")))
    return (side.alias("s").join(best.alias("b"), F.expr("s.name <=> b.name"), "left")
            .select("s.*", F.col("_best")["r_gram"].alias("r_gram")))


def match_rules(logs: DataFrame, side: DataFrame, keyword_mode: str, residual: Column | None = None,
                about: Profile | None = None) -> DataFrame:
    """The timestamp of each row of logs with each rule it matches (columns of ``side``).

    The message column (the widest) is read only if some rule has a keyword.
    """
    about = about or rule_profile(side)
    if about.crowd <= GRAM_RULES:
        return _joined(logs, side, keyword_mode, residual, about.any_level, about.keywords > 0)
    keyed = side.where(F.col("r_keyword").isNotNull())
    columns = [c for c in side.columns if c != "name"]
    # Versions of one rule share its name: each is found by a piece of its own.
    keyed = keyed.withColumn("_id", F.xxhash64(*side.columns))
    keyed = saved(with_gram(keyed.withColumn("_name", F.col("name")).withColumn("name", F.col("_id")), logs, keyword_mode)
                  .select(F.col("_name").alias("name"), *columns, "r_gram"), "rule-grams")
    lengths, found = keyed.where(F.col("r_gram").isNotNull()).agg(F.collect_set(F.length("r_gram")), F.count(F.lit(1))).first()
    rest = side.where(F.col("r_keyword").isNull()).unionByName(keyed.where(F.col("r_gram").isNull()).select(*side.columns))
    out = _joined(logs, rest, keyword_mode, residual, about.any_level, True)
    blocks = -(-found // BLOCK_RULES)
    for i in range(blocks):
        # At most about BLOCK_RULES rows, each broadcast; more rules are more scans.
        block = F.broadcast(keyed.where(F.col("r_gram").isNotNull() & (F.pmod(F.xxhash64("r_gram"), F.lit(blocks)) == i)))
        rows = _levels(logs.join(F.broadcast(keyed.select(F.col("r_domain").alias("domain")).distinct()), "domain", "left_semi"),
                       about.any_level, True)
        pieces = F.concat(*[grams(F.col("message"), n) for n in sorted(lengths)])
        on = ((F.col("domain") == F.col("r_domain")) & (F.col("_level") == F.col("r_level")) & (F.col("_gram") == F.col("r_gram"))
              & keyword_match(F.col("message"), F.col("r_keyword"), keyword_mode))
        rows = rows.select("*", F.explode(pieces).alias("_gram")).join(block, on if residual is None else on & residual)
        out = out.unionByName(rows.select("timestamp", *side.columns))
    return out


def _levels(logs: DataFrame, any_level: bool, keywords: bool) -> DataFrame:
    """The rows as rules look for them: by their level and, if some rule has none, once more by the empty one."""
    level = F.explode(F.array_distinct(F.array(F.lit(ANY_LEVEL), "level"))) if any_level else F.col("level")
    return logs.select("timestamp", "domain", level.alias("_level"), *(["message"] if keywords else []))


def _joined(logs: DataFrame, side: DataFrame, keyword_mode: str, residual: Column | None, any_level: bool, keywords: bool) -> DataFrame:
    on = (F.col("domain") == F.col("r_domain")) & (F.col("_level") == F.col("r_level"))
    if keywords:
        on = on & (F.col("r_keyword").isNull() | keyword_match(F.col("message"), F.col("r_keyword"), keyword_mode))
    if residual is not None:
        on = on & residual
    return _levels(logs, any_level, keywords).join(side, on).select("timestamp", *side.columns)


def rule_counts(logs: DataFrame, rules: DataFrame, as_of, keyword_mode: str = "contains") -> DataFrame:
    """(name, cnt): events per rule with ``timestamp >= as_of - period``.

    A blank level or keyword means "any". ``keyword_mode="like"`` gives the
    wildcard behaviour of a raw LIKE pattern. Rules that share a name count as one.
    """
    side = rule_side(rules).withColumn("r_lower", F.timestamp_micros(
        F.lit(micros_of(as_of)) - (F.col("period_minutes") * 60_000_000).cast("long")))
    about = rule_profile(side)
    lower = parse_as_of(as_of) - _dt.timedelta(minutes=about.longest)
    scoped = logs.where(date_bound(lower) & (F.col("timestamp") >= ts_literal(lower)))
    hits = match_rules(scoped, side, keyword_mode, F.col("timestamp") >= F.col("r_lower"), about).groupBy("name").agg(
        F.count(F.lit(1)).alias("cnt"))
    names = unique_rules(rules).select("name").alias("n")
    return (names.join(hits.alias("h"), F.expr("n.name <=> h.name"), "left")
            .select("n.name", F.coalesce(F.col("cnt"), F.lit(0)).cast("long").alias("cnt")))


def alert_status(logs: DataFrame, rules: DataFrame, as_of,
                 keyword_mode: str = "contains") -> DataFrame:
    """Per rule: count, threshold and status (EXCEEDED when count is
    strictly above the threshold; ERROR for an invalid rule)."""
    counts = rule_counts(logs, rules, as_of, keyword_mode)
    checked = validate_rules(unique_rules(rules))
    j = checked.alias("r").join(counts.alias("c"), F.expr("r.name <=> c.name"), "left")
    status = (F.when(F.col("error").isNotNull(), F.lit(ERROR))
              .when(F.col("cnt") > F.col("threshold"), F.lit(EXCEEDED))
              .otherwise(F.lit(OK_STATUS)))
    return j.select("r.name", "domain", "level", "keyword", "threshold", "period_minutes",
                    F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"),
                    status.alias("status"), "error")


def alert_summary(status: DataFrame) -> DataFrame:
    return status.agg(F.count(F.lit(1)).alias("total"),
                      F.count_if(F.col("status") == EXCEEDED).alias("exceeded"),
                      F.count_if(F.col("status") == ERROR).alias("errors"))


def _num_text(c):
    return F.when(F.col(c) == F.floor(c), F.col(c).cast("long").cast("string")) \
            .otherwise(F.col(c).cast("string"))


def alert_payload(status: DataFrame, max_lines: int = PAYLOAD_LINES) -> DataFrame:
    """No row without a breached rule, else one row: the notification text, one
    line per rule ``[name] domain / level: count events (threshold: t)``,
    ``ALL`` when the rule has no level; lines sorted. Above ``max_lines`` breached
    rules there are several rows, each with about that many of the rules. The status is
    computed once: its breached rules are kept in the shared folder."""
    line = F.format_string("[%s] %s / %s: %s events (threshold: %s)", F.col("name"),
                           F.col("domain"), F.coalesce(_blank_to_null("level"), F.lit("ALL")),
                           F.col("cnt").cast("string"), _num_text("threshold"))
    breached = saved(status.where(F.col("status") == EXCEEDED).select("name", line.alias("line")), "breached")
    total = breached.count()
    pages = max(1, -(-total // max_lines))
    agg = (breached.groupBy(F.pmod(F.xxhash64("name"), F.lit(pages)).alias("page"))
           .agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines")))
    return agg.select(
        F.lit(total).cast("long").alias("exceeded"),
        F.concat(F.lit(f"Alert: {total} rule(s) exceeded\n"), F.col("lines")).alias("text"))


def list_rules(rules: DataFrame) -> DataFrame:
    """The rules in use, one row per name, with why a rule cannot run."""
    return validate_rules(unique_rules(rules))


def upsert_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Replace rules by name, append the rest; one row per name in the result."""
    new = new.select(*rules.columns)
    kept = rules.alias("r").join(new.select("name").alias("n"), F.expr("r.name <=> n.name"), "left_anti").select(*rules.columns)
    return unique_rules(kept.unionByName(new))


def remove_rules(rules: DataFrame, names: DataFrame) -> DataFrame:
    return rules.join(names.select("name"), "name", "left_anti")


def missing_rules(rules: DataFrame, names: DataFrame) -> DataFrame:
    """Names asked for removal that match no rule (reported, not an error)."""
    return names.select("name").join(rules.select("name"), "name", "left_anti")


# ---- rule history ------------------------------------------------------------------


def rule_history(rules: DataFrame, at=None) -> DataFrame:
    """Rules as versions that hold from ``at`` on; always, without it."""
    return as_history(rules, ["name", *_RULE], at)


def changed_rules(history: DataFrame, new: DataFrame, at) -> DataFrame:
    """The history with rules set, or replaced by name, from ``at`` on. Nothing earlier changes."""
    return history.unionByName(rule_history(unique_rules(new), at))


def removed_rules(history: DataFrame, names: DataFrame, at) -> DataFrame:
    """The history with the named rules removed from ``at`` on."""
    return history.unionByName(removals(history, names, "name", at))


def rules_at(history: DataFrame, as_of) -> DataFrame:
    """The rules that hold at a time."""
    return held_at(history, "name", list(_RULE), as_of)


def version_side(history: DataFrame) -> DataFrame:
    """Valid versions as the join needs them, with the times between which they hold. Plain rules hold always."""
    return _side(lifetimes(history, "name", list(_RULE)), "r_from", "r_to")
