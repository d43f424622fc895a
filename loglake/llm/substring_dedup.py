"""Substring dedup by MinHash banding of paragraphs (operator 3).

A text is cut into small paragraphs that do not depend on where a passage
stands: at sentence ends, of which those within NEAR words of another give way to the one of
the smallest hash of the words around it; sentences of over CUT_ABOVE words also where such
a hash is the smallest within NEAR words; what is over CUT_MOST even then (runs of one word) every
CUT_STEP words. So no paragraph is of fewer than MIN_PARAGRAPH words, but at a text's end, and
the same words are cut alike in any surroundings. A paragraph is its set of 5-word shingles; BANDS
MinHash values are its bands, tuned so that paragraphs of Jaccard similarity
THRESHOLD collide with a probability of at least RECALL. Colliding paragraphs
of different documents are compared on their whole sets; equal ones are one
class, links make components, and a component that occurs in two or more
documents repeats. Runs of repeating paragraphs of at least MIN_WORDS words
are passages, with the components of all their paragraphs; all but the first occurrence (doc_id,
place) are removed.

Skew: bands are pre-aggregated (smallest and largest document); paragraphs
whose bands no other document has are dropped where they are made, by a
fixed-size filter; a band's classes are compared with its smallest class
first, then, across components only, in trees that are dealt out in parts: a few of each, then all.

Defined cases: null and empty texts, and texts without a paragraph of
MIN_PARAGRAPH words, have no passage; repeated rows (same doc_id and text)
are one document; ties on the first occurrence go to the smaller text hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.common import (
    SPACES,
    distinct_sorted,
    filter_bits,
    flag_rows,
    gram_hashes,
    hash_words,
    in_filter,
    mix64,
    save,
    slices,
    table,
)
from loglake.llm.components import connected_components, merge_components
from loglake.llm.ngram_join import FEW, can_link, coarse_counts, pack, tree_pairs, unpack

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.99
NEAR = 5  # words: cuts are farther apart
CUT_ABOVE = 20  # words: longer sentences are cut
CUT_MOST = 40
CUT_STEP = 16
MIN_PARAGRAPH = NEAR + 1
#: Flags of the filter of shared bands (16 MB), four times those of other filters, since nearly each paragraph is looked up.
FLAGS = 1 << 27
SECOND = 27  # bits that the second flag of a band leaves out
MIN_WORDS = 16
GAP = 6

#: A key that no place has.
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)

#: A-Z to a-z, sentence ends to line ends, other ASCII marks to spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 10 if c in b".!?\n" else 32 for c in range(256))


def tune_bands(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Bands of one MinHash value that collide with at least this probability.

    One value a band is enough: unrelated texts share no 5-word shingle.
    """
    bands = 1
    while 1 - (1 - threshold) ** bands < recall:
        bands += 1
    return bands


BANDS = tune_bands()


def smallest_near(keys: np.ndarray) -> np.ndarray:
    """Places whose key is the smallest within NEAR places, the first of equal ones."""
    before, after = (np.full(len(keys), LAST) for _ in range(2))
    for r in range(1, min(NEAR, len(keys) - 1) + 1):
        before[r:] = np.minimum(before[r:], keys[:-r])
        after[:-r] = np.minimum(after[:-r], keys[r:])
    return (keys < before) & (keys <= after)


def cut_places(words: np.ndarray, sentence: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words that begin a paragraph. ``sentence``: whether a word begins a sentence; ``first``: those that begin a text."""
    around = np.zeros(len(words), np.uint64)
    around[1:-1] = gram_hashes(words, 3) >> np.uint64(1) if len(words) > 2 else 0
    keys = np.where(sentence, around, LAST)
    keys[first] = 0
    cut = smallest_near(keys)
    cut[first] = True
    # Long sentences, away from their ends.
    at = np.flatnonzero(cut)
    size = np.diff(np.append(at, len(words)))
    inside = np.arange(len(words)) - np.repeat(at, size)
    size = np.repeat(size, size)
    keys = np.where((size > CUT_ABOVE) & (inside > NEAR) & (size - inside > NEAR), mix64(around) >> np.uint64(1), LAST)
    cut |= smallest_near(keys)
    at = np.flatnonzero(cut)
    size = np.diff(np.append(at, len(words)))
    for s, n in zip(at[size > CUT_MOST].tolist(), size[size > CUT_MOST].tolist()):
        cut[s + CUT_STEP:s + n - NEAR:CUT_STEP] = True
    return np.flatnonzero(cut)


def paragraphs(texts: list[str | None]) -> dict[str, np.ndarray]:
    """Arrays over the paragraphs of all texts: owner (which text), start, end (words of the
    text), class, bands, at (the first shingle) and last; and the shingles of all texts."""
    raws = [t.encode().translate(FOLD) if t else b"" for t in texts]
    words, counts = hash_words(raws)
    raw = np.frombuffer(b"\n".join(raws), np.uint8)
    begins = np.flatnonzero(np.diff(SPACES[raw].astype(np.int8), prepend=1) == -1)
    sentence = np.diff(np.cumsum(raw == 10, dtype=np.int64)[begins], prepend=-1) > 0
    first = np.cumsum(counts) - counts
    starts = cut_places(words, sentence, first[counts > 0]) if len(words) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(words))[:len(starts)]
    big = ends - starts >= MIN_PARAGRAPH
    starts, ends = starts[big], ends[big]
    owner = np.searchsorted(first + counts, starts, "right")
    if not len(starts):
        return {"owner": owner, "start": starts, "end": ends, "class": starts, "bands": np.empty((0, BANDS), np.int64), "at": starts, "last": starts, "grams": words}
    grams = gram_hashes(words, WIDTH)
    # Ranges of shingles wholly inside a paragraph: [start, end - WIDTH + 1).
    edges = np.column_stack((starts, ends - WIDTH + 1)).ravel()
    edges = edges[:-1] if edges[-1] >= len(grams) else edges
    bands = [np.minimum.reduceat(mix64(grams ^ np.uint64(0x5851F42D4C957F2D * (k + 1) & 0xFFFFFFFFFFFFFFFF)), edges)[::2] ^ np.uint64(k)
             for k in range(BANDS)]
    kind = np.add.reduceat(mix64(grams + np.uint64(1)), edges)[::2] + (ends - starts).astype(np.uint64)
    return {"owner": owner, "start": starts - first[owner], "end": ends - first[owner], "class": kind.astype(np.int64),
            "bands": np.column_stack(bands).astype(np.int64), "at": starts, "last": ends - WIDTH + 1, "grams": grams}


def shared_bands(docs: DataFrame) -> DataFrame:
    """band of every band value found in two or more documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            p = paragraphs(b.column(1).to_pylist())
            keys = np.repeat(b.column(0).to_numpy()[p["owner"]], BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(p["bands"].ravel()), pa.array(keys)], ["band", "key"])

    rows = docs.select("key", "text").mapInArrow(run, "band long, key long")
    return rows.groupBy("band").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("band")


def candidates(docs: DataFrame, bands: DataFrame) -> DataFrame:
    """Paragraphs with a band that (nearly surely) another document has."""
    # Two flags a band: of 3 million shared bands one paragraph in 200 comes without need.
    flags = F.explode(F.array(F.pmod("band", F.lit(FLAGS)), F.pmod(F.shiftright("band", SECOND), F.lit(FLAGS))))
    shared = docs.sparkSession.sparkContext.broadcast(filter_bits(bands.select(flags.alias("at")), FLAGS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            p = paragraphs(b.column(3).to_pylist())
            hit = (in_filter(shared.value, p["bands"] % FLAGS) & in_filter(shared.value, (p["bands"] >> SECOND) % FLAGS)).any(axis=1)
            doc_ids, row_keys, keys = (b.column(c).to_pylist() for c in range(3))
            rows = []
            for i in np.flatnonzero(hit).tolist():
                o = int(p["owner"][i])
                rows.append((doc_ids[o], row_keys[o], keys[o], int(p["start"][i]), int(p["end"][i]), int(p["class"][i]), p["bands"][i],
                             pack(distinct_sorted(p["grams"][p["at"][i]:p["last"][i]]))))
            kinds = (pa.int64(),) * 6 + (pa.list_(pa.int64()), pa.binary())
            columns = zip(*rows) if rows else ((),) * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                             ["doc_id", "row", "key", "start", "end", "class", "bands", "hashes"])

    return docs.select("doc_id", "row", "key", "text").mapInArrow(
        run, "doc_id long, row long, key long, start long, end long, class long, bands array<long>, hashes binary")


def described(sets: DataFrame) -> DataFrame:
    """class, hashes, first (its bands in order), n, counts of classes that must be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [unpack(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(list(map(len, found)), pa.int64()), pa.array([coarse_counts(x << np.uint64(16)) for x in found], pa.binary())],
                ["class", "hashes", "first", "n", "counts"])

    return sets.select("class", "hashes", F.array_sort("bands").alias("first")).mapInArrow(
        run, "class long, hashes binary, first array<long>, n long, counts binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose shingle sets reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = unpack(x), unpack(y)
                keep.append(can_link(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    whole = pairs
    for side in "ab":
        whole = whole.join(sets.select(F.col("class").alias(side), F.col("hashes").alias(f"set_{side}")), side)
    return whole.select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long")


def repeating(docs: DataFrame) -> DataFrame:
    """doc_id, row, start, end, component, first: repeating paragraphs (places in words)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"),
                       F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "text").alias("key"), "text")
    bands = save(shared_bands(docs), "dedup-bands")
    found = save(candidates(docs, bands), "dedup-paragraphs")
    cells = found.select(F.explode("bands").alias("cell"), "class")
    hubs = cells.groupBy("cell").agg(F.min("class").alias("a"), F.max("class").alias("top")).where("a <> top").select("cell", "a")
    hubs = save(hubs, "dedup-hubs")  # a join of two exchanges, whose hot keys Spark can split
    # Most bands are of one class, of exact repeats: they have no hub, and are not shuffled.
    cells = flag_rows(cells, hubs, ["cell"], "_several").where("_several").select("cell", "class").distinct()
    cells = save(cells.join(hubs, "cell"), "dedup-cells")
    # Only bands of several classes have anything to compare; most have one, of exact repeats.
    compared = cells.select("class").distinct()
    sets = flag_rows(found.select("class", "hashes", "bands"), compared, ["class"], "_compared").where("_compared").drop("_compared")
    sets = save(described(sets.dropDuplicates(["class"])), "dedup-sets")
    pairs = cells.where("class <> a").select("a", F.col("class").alias("b")).distinct()
    cells = cells.select("cell", "class")
    labels = connected_components(save(verified(pairs, sets.select("class", "hashes")), "dedup-links"))
    # First some pairs of each, then all that lie in different components still. The only pair of two classes has been compared.
    for few in (FEW, None):
        across = save(tree_pairs(cells, labels, sets.select("class", "n", "counts", "first"), few, least=3), "dedup-across")
        more = save(verified(across, sets.select("class", "hashes")), "dedup-links")
        if not more.isEmpty():
            labels = merge_components(labels, more)
    # Classes without a link pass by the join: most have none.
    placed = found.select("doc_id", "row", "key", "start", "end", "class")
    placed = flag_rows(placed, labels.select(F.col("node").alias("class")), ["class"], "_linked")
    linked = placed.where("_linked").join(labels, F.col("class") == F.col("node"), "left")
    placed = (linked.select("doc_id", "row", "key", "start", "end", F.coalesce("component", "class").alias("component"))
              .unionByName(placed.where("NOT _linked").select("doc_id", "row", "key", "start", "end", F.col("class").alias("component"))))
    groups = (placed.groupBy("component")
              .agg(F.min("key").alias("lo"), F.max("key").alias("hi"),
                   F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "start")).alias("first"))
              .where("lo <> hi").select("component", "first"))
    groups = save(groups, "dedup-groups")
    return placed.join(groups, "component").select(
        "doc_id", "row", "start", "end", "component",
        (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.row") == F.col("row")) & (F.col("first.start") == F.col("start"))).alias("first"))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, row, start, end (words), component, components, removed: one row per repeated passage.

    A passage is a run of repeating paragraphs that are all first occurrences
    or all later ones; ``components`` are those of all its paragraphs, in order, and ``component`` is the
    smallest. Two passages repeat one another if they share a component.
    """
    runs = (repeating(docs).groupBy("doc_id", "row")
            .agg(F.array_sort(F.collect_set(F.struct("start", "end", "component", "first"))).alias("p")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, row, found in zip(*(c.to_pylist() for c in b.columns)):
                merged: list[list] = []
                for p in found:
                    if merged and p["start"] - merged[-1][1] <= GAP and p["first"] != merged[-1][3]:
                        merged[-1][1] = p["end"]
                        merged[-1][2].add(p["component"])
                    else:
                        merged.append([p["start"], p["end"], {p["component"]}, not p["first"]])
                rows += [(doc_id, row, s, e, min(c), sorted(c), removed) for s, e, c, removed in merged if e - s >= min_words]
            kinds = (*(pa.int64(),) * 5, pa.list_(pa.int64()), pa.bool_())
            columns = zip(*rows) if rows else ((),) * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                             ["doc_id", "row", "start", "end", "component", "components", "removed"])

    return runs.mapInArrow(run, "doc_id long, row long, start long, end long, component long, components array<long>, removed boolean")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text without removed passages, n_removed_words: one row per row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    spans = save(repeated_passages(docs, min_words).where("removed").groupBy("doc_id", "row")
                 .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")), "dedup-spans")
    marked = flag_rows(docs, spans, ["doc_id", "row"], "_hit")
    hit = (marked.where("_hit").alias("d").join(spans.alias("s"), F.expr("d.doc_id <=> s.doc_id AND d.row = s.row"), "left")
           .select("d.doc_id", "text", "spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, gone = [], []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                gone.append(sum(s["end"] - s["start"] for s in found or ()))
                texts.append(remove_words(text, [(s["start"], s["end"]) for s in found]) if found else text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(gone, pa.int64())],
                                             ["doc_id", "text", "n_removed_words"])

    return (marked.where("NOT _hit").select("doc_id", "text", F.lit(0).cast("long").alias("n_removed_words"))
            .unionByName(hit.mapInArrow(run, "doc_id long, text string, n_removed_words long")))


def remove_words(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode()
    at = [m.span() for m in re.finditer(rb"[^ \n]+", raw.translate(FOLD))]
    kept, end = [], 0
    for s, e in spans:
        kept.append(raw[end:at[s][0]])
        end = at[e - 1][1]
    return b"".join([*kept, raw[end:]]).decode()


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per repeated passage; documents without one have no row."""
    return repeated_passages(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"),
        (F.col("end") - F.col("start")).alias("n_words"), "component", "components", "removed")
