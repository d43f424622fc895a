"""Quality rules as a bitmask ledger (operator 4).

Every rule is evaluated once per document; the ledger keeps the measurements
and one ``failures`` bit per failed rule. A policy is a named, versioned mask of
rules that reject, so a new policy or an ablation never reads a text again:
``apply_policy`` is one bitwise AND, and ``ablations`` counts on the at most
2**rules distinct failure masks.

Defined cases: null or empty text has no words (and fails ``few_words``);
repeated rows are judged row by row; ties do not occur. No shuffle but in
``ablations``, whose groups are pre-aggregated counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglake.llm.common import table, tidy

SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals"]
MAX_EXACT_KEY = 2_000_000
ENTRY = "_ledger_entry"

#: Rules in bit order, as conditions on the measurements (SQL; integers only).
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "100 * n_symbols > 25 * n_words",
    "many_capitals": "100 * n_capitals > 30 * n_letters",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "odd_word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
}
BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base-1": BASE,
    "keep-1": (*BASE, "many_symbols", "many_capitals", "repeated_lines", "odd_word_length"),
}
CURRENT = "keep-1"


def mask(rules: tuple[str, ...]) -> int:
    order = list(RULES)
    return sum(1 << order.index(r) for r in rules)


def failure_bits(prefix: str = "") -> str:
    """SQL of the failure mask over measurements named with ``prefix``."""
    bits = (f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(RULES.values()))
    return re.sub(f"\\b({'|'.join(MEASURES)})\\b", lambda m: prefix + m[1], f"CAST({' + '.join(bits)} AS int)")


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows whose words occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    size = len(seen)
    if size < MAX_EXACT_KEY:
        keys = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:  # number the pairs first, so that keys stay exact
        pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
        keys = pairs[:-1] * size + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    again = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    for k in range(3):
        twice[again + k] = True
    return int(twice.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode()
    words = raw.split()
    chars = len(text) - (len(raw) - sum(map(len, words)))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    small = len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return (len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
            len(lines), capitals + small, capitals)


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and MEASURES, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t) for t in b.column(1).to_pylist()]
            columns = zip(*rows) if rows else ((),) * len(MEASURES)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *MEASURES])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        tidy(run), ", ".join(["doc_id long", *(f"{m} long" for m in MEASURES)]))


def ledger(docs: DataFrame) -> DataFrame:
    """measurements plus ``failures``: bit i is set if rule i fails."""
    return measurements(docs).withColumn("failures", F.expr(failure_bits()))


def rejected_by(failures: Column, rules: tuple[str, ...]) -> Column:
    return failures.bitwiseAND(F.lit(mask(rules))) != 0


def apply_policy(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds base_failed, kept and the policy's name to ledger rows."""
    failures = F.col("failures")
    return (entries.withColumn("base_failed", rejected_by(failures, BASE))
            .withColumn("kept", ~rejected_by(failures, tuple(dict.fromkeys((*BASE, *POLICIES[policy])))))
            .withColumn("policy", F.lit(policy)))


def filter_documents(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of docs that the policy keeps, with the same columns.

    The rules are evaluated beside the row itself, so nothing is joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            columns = zip(*rows) if rows else ((),) * len(MEASURES)
            entry = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], MEASURES)
            yield pa.RecordBatch.from_arrays([*b.columns, entry], [*b.schema.names, ENTRY])

    schema = T.StructType([*docs.schema.fields, T.StructField(ENTRY, T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))])
    entries = docs.mapInArrow(tidy(run), schema)
    failures = F.expr(failure_bits(f"{ENTRY}."))
    return entries.where(~rejected_by(failures, tuple(dict.fromkeys((*BASE, *POLICIES[policy]))))).drop(ENTRY)


def ablations(entries: DataFrame) -> DataFrame:
    """Per policy and rule: documents the rule fails, and those it alone rejects."""
    masks = entries.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    rows = [F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask((r,))).alias("bit"), F.lit(mask(rs)).alias("mask"))
            for p, rs in POLICIES.items() for r in rs]
    each = masks.withColumn("x", F.explode(F.array(*rows))).select("n", "failures", "x.*")
    hit = F.col("failures").bitwiseAND(F.col("mask"))
    return (each.groupBy("policy", "rule").agg(
        F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
        F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("n_rejected")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failures", "base_failed", "kept")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
p AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT rid, i, word, lead(word, 1) OVER s AS b, lead(word, 2) OVER s AS c FROM p WINDOW s AS (PARTITION BY rid ORDER BY i)),
t AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, word, b, c) AS n FROM g WHERE c IS NOT NULL),
r AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM t, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
             length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS n_letters,
             length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals
      FROM w LEFT JOIN r USING (rid)),
f AS (SELECT *, {failure_bits()} AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures,
       (failures & {mask(BASE)}) <> 0 AS base_failed, (failures & {mask(POLICIES[CURRENT]) | mask(BASE)}) = 0 AS kept
FROM f
"""
