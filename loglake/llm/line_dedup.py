"""Line dedup by a log-template tree, in DataFrame operations only (operator 5).

Each line descends a tree of fixed depth: token count, then its LEAD leading
tokens; tokens with a digit count as a variable field ``<*>``. At the leaf the
remaining tokens are cut into SEGMENTS equal segments. A segment found under
the same leaf in two or more documents is constant there; one that is not is
generalised to ``<*>`` too. The line's template is its leaf with the constant
segments. A template found in two or more documents recurs, and its lines are
dropped everywhere but at its first occurrence (smallest doc_id and place), so
no content is lost altogether.

A line follows a template if all segments are constant, or if one is
generalised and at least MIN_CONSTANT tokens are constant.

Short lines, of fewer than MIN_TOKENS tokens without a digit, coincide more
easily, so they need more evidence: their whole line is the template, with no
segment generalised, and it recurs in SHORT_DOCUMENTS documents, or in
VARIABLE_DOCUMENTS if it has a variable field. Rows of numbers would be all
alike once masked: a line of variable fields only is compared as it stands.

The tree's nodes are 64-bit hashes, so only hashes are shuffled; counts are
pre-aggregated (the smallest and largest document of a node), and the joins of
hot nodes are split by adaptive execution. Texts are joined once, by row key.

Defined cases: null text stays null with no lines; an empty text has one empty
line; blank lines are kept; repeated rows (same doc_id and text) are one
document and get equal results; ties on doc_id go to the smaller text hash;
other columns are ignored by ``dedup_lines`` and kept by ``clean_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.common import save, table

LEAD = 2
SEGMENTS = 3
MIN_TOKENS = 5
MIN_CONSTANT = 8
SHORT_DOCUMENTS = 3
VARIABLE_DOCUMENTS = 10

SPACE = r"\x20\x09-\x0D"
#: A token with a digit, matched from its start so that long tokens stay linear.
VARIABLE = rf"(?<![^{SPACE}])[^{SPACE}0-9]*+[0-9][^{SPACE}]*+"


def row_key(copies: bool):
    """What makes a document: its doc_id and text; or, with ``copies``, the text alone."""
    return (F.xxhash64("text") if copies else F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("text"))).alias("key")


def tree_lines(docs: DataFrame, copies: bool) -> DataFrame:
    """One row per line that is not blank: doc_id, key, pos, nodes (hash and length of each segment).

    A short line has one node, its template; the length is the documents it must recur in.
    """
    # Few lines have a digit: the pattern that masks variable fields runs on those only.
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", VARIABLE, "<*>")).otherwise(F.col("line"))
    tokens = lambda c: F.split(F.btrim(c, F.lit(" \t\x0b\f\r")), f"[{SPACE}]+")
    lines = (docs.select("doc_id", row_key(copies), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
             .select("doc_id", "key", "pos", "line", tokens(masked).alias("t")))
    rest = F.size("t") - LEAD
    nodes = []
    for i in range(SEGMENTS):
        start, end = F.floor(rest * i / SEGMENTS).cast("int"), F.floor(rest * (i + 1) / SEGMENTS).cast("int")
        part = F.slice("t", start + LEAD + 1, end - start)
        nodes.append(F.struct(F.xxhash64(F.size("t"), F.slice("t", 1, LEAD), F.lit(i), part).alias("node"),
                              (end - start).alias("size")))
    plain = F.size(F.array_remove("t", "<*>"))
    short = F.struct(F.xxhash64(F.lit("short"), F.when(plain > 0, F.col("t")).otherwise(tokens(F.col("line")))).alias("node"),
                     F.when(plain == F.size("t"), SHORT_DOCUMENTS).otherwise(VARIABLE_DOCUMENTS).alias("size"))
    # A generator of no or one row instead of a filter, which would be pushed
    # below the projection and cut every line twice.
    return lines.select("doc_id", "key", "pos", F.explode(
        F.when(plain >= MIN_TOKENS, F.array(F.array(*nodes))).when(F.col("t")[0] != "", F.array(F.array(short)))).alias("nodes"))


def recurring(rows: DataFrame, column: str) -> DataFrame:
    """Values of ``column`` that occur in two or more documents."""
    return (rows.groupBy(column).agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
            .where("lo <> hi").select(column))


def dropped_lines(docs: DataFrame, copies: bool = False) -> DataFrame:
    """key and the positions of the lines to drop, one row per document that loses lines."""
    lines = save(tree_lines(docs, copies), "tree-lines")
    nodes = (lines.where(F.size("nodes") == SEGMENTS).select("doc_id", "key", "pos", F.explode("nodes").alias("n"))
             .select("doc_id", "key", "pos", "n.*"))
    short = (lines.where(F.size("nodes") == 1)
             .select("doc_id", "key", "pos", F.col("nodes")[0]["node"].alias("template"), F.col("nodes")[0]["size"].alias("least")))
    # Written first: a join of two exchanges, whose hot keys Spark can split.
    fixed = nodes.join(save(recurring(nodes, "node"), "recurring-nodes"), "node")
    # A repeated row repeats its lines; xor needs each node once.
    templates = (fixed.groupBy("key", "pos", "doc_id", "node").agg(F.first("size").alias("size"))
                 .groupBy("key", "pos", "doc_id")
                 .agg(F.bit_xor("node").alias("template"), F.count(F.lit(1)).alias("n_fixed"), F.sum("size").alias("constant"))
                 .where((F.col("n_fixed") == SEGMENTS)
                        | (F.col("n_fixed") == SEGMENTS - 1) & (F.col("constant") + LEAD >= MIN_CONSTANT)))
    templates = save(templates.select("doc_id", "key", "pos", "template"), "templates")
    first = F.min(F.struct("doc_id", "key", "pos")).alias("first")
    again = (templates.groupBy("template").agg(first, F.min("key").alias("lo"), F.max("key").alias("hi"))
             .where("lo <> hi").select("template", "first"))
    often = (short.groupBy("template", "least", "key").agg(F.min(F.struct("doc_id", "pos")).alias("x"))
             .select("template", "least", "x.doc_id", "key", "x.pos").groupBy("template", "least").agg(first, F.count(F.lit(1)).alias("n")).where("n >= least").select("template", "first"))
    again = save(again.unionByName(often), "recurring-templates")
    return (templates.unionByName(short.drop("least")).join(again, "template")
            .where((F.col("key") != F.col("first.key")) | (F.col("pos") != F.col("first.pos")))
            .groupBy("key").agg(F.collect_set("pos").alias("gone")))


def cleaned(docs: DataFrame, copies: bool = False) -> DataFrame:
    """docs with n_lines, n_dropped and new_text."""
    # The smaller side is hashed, so that the texts need no sorting.
    gone_lines = dropped_lines(docs.select("doc_id", "text"), copies).hint("shuffle_hash")
    none = F.array().cast("array<int>")
    marked = docs.withColumn("key", row_key(copies)).join(gone_lines, "key", "left").withColumn("gone", F.coalesce("gone", none))
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: lines[i]), "\n"))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return (marked.withColumn("new_text", text).withColumn("n_lines", F.coalesce(n_lines, F.lit(0)).cast("long"))
            .withColumn("n_dropped", F.size("gone").cast("long")))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (without the dropped lines) per row."""
    return cleaned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select(
        "doc_id", "n_lines", "n_dropped", F.col("new_text").alias("text"))


def clean_documents(docs: DataFrame) -> DataFrame:
    """docs with the same columns, the text cleaned and n_chars following it.

    Documents of the very same text count as one: they lose the same lines and stay
    copies, which a near-duplicate stage removes. All other documents lose every dropped line.
    """
    slim = cleaned(docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns if c not in ("doc_id", "text")}), copies=True)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("new_text").alias("text"))
        elif c == "n_chars":
            columns.append(F.length("new_text").cast(docs.schema[c].dataType).alias("n_chars"))
        else:
            columns.append(F.col(c if c == "doc_id" else f"in_{c}").alias(c))
    return slim.select(columns)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (SELECT doc_id, text, md5(text) AS h FROM documents),
u AS (SELECT DISTINCT doc_id, h, text FROM d WHERE text IS NOT NULL),
s AS (SELECT doc_id, h, string_split(text, chr(10)) AS ls FROM u),
l AS (SELECT doc_id, h, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM s),
raw AS (SELECT doc_id, h, pos, regexp_extract_all(line, '[^{SPACE}]+') AS raw FROM l),
t AS (SELECT *, list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t,
             len(list_filter(raw, lambda x: NOT regexp_matches(x, '[0-9]'))) AS plain FROM raw WHERE len(raw) > 0),
n AS (SELECT doc_id, h, pos, i, len(t) AS n, t[1:{LEAD}] AS head,
             t[{LEAD} + 1 + ((len(t) - {LEAD}) * i) // {SEGMENTS}:{LEAD} + ((len(t) - {LEAD}) * (i + 1)) // {SEGMENTS}] AS part
      FROM t, (SELECT unnest(range({SEGMENTS})) AS i) WHERE plain >= {MIN_TOKENS}),
f AS (SELECT * FROM n WINDOW w AS (PARTITION BY n, head, i, part)
      QUALIFY min(doc_id || '/' || h) OVER w <> max(doc_id || '/' || h) OVER w),
m AS (SELECT doc_id, h, pos, (any_value(n), any_value(head), list((i, part) ORDER BY i)) AS template
      FROM f GROUP BY doc_id, h, pos
      HAVING count(*) = {SEGMENTS} OR (count(*) = {SEGMENTS - 1} AND sum(len(part)) + {LEAD} >= {MIN_CONSTANT})),
g AS (SELECT doc_id, h, pos FROM m WINDOW w AS (PARTITION BY template)
      QUALIFY min(doc_id || '/' || h) OVER w <> max(doc_id || '/' || h) OVER w
              AND row_number() OVER (PARTITION BY template ORDER BY doc_id, h, pos) > 1),
o AS (SELECT doc_id, h, pos, CASE WHEN plain > 0 THEN t ELSE raw END AS template,
             CASE WHEN plain = len(t) THEN {SHORT_DOCUMENTS} ELSE {VARIABLE_DOCUMENTS} END AS least FROM t WHERE plain < {MIN_TOKENS}),
a AS (SELECT doc_id, h, pos FROM g UNION ALL
      SELECT doc_id, h, pos FROM o WINDOW w AS (PARTITION BY template, least)
      QUALIFY count(DISTINCT doc_id || '/' || h) OVER w >= least AND row_number() OVER (PARTITION BY template, least ORDER BY doc_id, h, pos) > 1),
x AS (SELECT doc_id, h, count(*) AS n_dropped, list(pos) AS gone FROM a GROUP BY doc_id, h)
SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
       CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(
           list_filter(string_split(text, chr(10)), lambda y, k: NOT list_contains(gone, k - 1)), chr(10)), '') END AS text
FROM d LEFT JOIN x ON d.doc_id = x.doc_id AND d.h = x.h
"""
