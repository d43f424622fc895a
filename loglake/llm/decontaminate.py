"""Benchmark decontamination by a generalised suffix automaton (operator 8).

The words of the benchmark items form one automaton. Each document streams its
words through it, tracking the longest match that ends at every word: a match
of a whole window (13 words, or a whole shorter item) marks its words as hit.
Words unknown to the benchmark reset the match, so only runs of known words of
at least the shortest window are walked. Spans as long as a window are cut out;
a document whose covered share reaches the coverage limit goes altogether.

Benchmarks are cut into blocks of at most ``block_words`` words by a hash of
the item (over-long items into overlapping pieces), so one automaton is bounded;
several blocks are passes over the documents, each adding its hits to the last.

Defined cases: null or empty texts have no words and are never contaminated;
items without words have no window; repeated items count once by item_id;
items with a null id mark words but are not counted; an empty benchmark hits
nothing; repeated documents are judged row by row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.common import save, table, tidy

WINDOW = 13
BLOCK_WORDS = 200_000
PIECE_WORDS = 50_000

#: A-Z to a-z; every ASCII byte that is no digit or letter to a space.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))


def item_words(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class SuffixAutomaton:
    """Generalised over word sequences; ``items`` are known per window state."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.sequences: list[tuple[str | None, list[int], bool]] = []
        self.shortest = window

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
        cur = self._state(self.len[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return cur

    def add(self, item: str | None, words: list[bytes], whole: bool) -> None:
        """whole: the sequence is a complete item (else a piece of a long one)."""
        seq = [self.ids.setdefault(w, len(self.ids)) for w in words]
        last = 0
        for c in seq:
            last = self._extend(last, c)
        self.sequences.append((item, seq, whole))
        if whole:
            self.shortest = min(self.shortest, len(seq))

    def finish(self) -> SuffixAutomaton:
        """Mark which items own each window state and each whole short item."""
        n, w = len(self.len), self.window
        self.owners: list[set | None] = [None] * n
        self.short = [0] * n  # nearest suffix state that is a whole short item
        whole: set[int] = set()
        for item, seq, complete in self.sequences:
            v = 0
            for c in seq:
                v = self.next[v][c]
                u = v
                while self.len[u] >= w:
                    owners = self.owners[u]
                    if owners is None:
                        owners = self.owners[u] = set()
                    if item in owners:
                        break
                    owners.add(item)
                    u = self.link[u]
            if complete and len(seq) < w:
                whole.add(v)
                owners = self.owners[v] = self.owners[v] or set()
                owners.add(item)
        self.base = list(range(n))  # the state of a match's last `window` words
        for v in sorted(range(1, n), key=self.len.__getitem__):
            up = self.link[v]
            if self.len[v] >= w and self.len[up] >= w:
                self.base[v] = self.base[up]
            self.short[v] = up if up in whole else self.short[up]
        self.whole = whole
        self.sequences = []
        return self

    def walk(self, ids: list[int], start: int, stop: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        """Adds to spans the hits within ids[start:stop], to found their states."""
        nxt, link, length, w = self.next, self.link, self.len, self.window
        v = matched = 0
        for i in range(start, stop):
            c = ids[i]
            while v and c not in nxt[v]:
                v = link[v]
                matched = length[v]
            u = nxt[v].get(c)
            if u is None:
                v = matched = 0
                continue
            v = u
            matched += 1
            if matched >= w:
                spans.append((i - w + 1, i + 1))
                found.add(self.base[v])
            if self.whole:
                s = v if matched == length[v] and v in self.whole else self.short[v]
                while s:
                    spans.append((i - length[s] + 1, i + 1))
                    found.add(s)
                    s = self.short[s]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged hit spans (word positions) and the items whose windows occur."""
        if len(words) < self.shortest or not self.ids:
            return [], set()
        ids = list(map(self.ids.get, words, (-1,) * len(words)))
        known = np.fromiter(ids, np.int64, len(ids)) >= 0
        edge = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        starts, stops = edge[::2], edge[1::2]
        for k in np.flatnonzero(stops - starts >= self.shortest):
            self.walk(ids, int(starts[k]), int(stops[k]), spans, found)
        return merge_spans(spans), set().union(*(self.owners[s] for s in found))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (and what stands between them)."""
    raw = text.encode()
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(FOLD))]
    kept, end = [], 0
    for s, e in spans:
        kept.append(raw[end:at[s][0]])
        end = at[e - 1][1]
    return b"".join([*kept, raw[end:]]).decode()


def benchmark_pieces(items: DataFrame, window: int) -> DataFrame:
    """Items as word sequences; long ones as pieces that share window-1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = item_words(text)
                step = PIECE_WORDS - window + 1
                for k in range(0, max(1, len(words) - window + 1), step):
                    if piece := words[k:k + PIECE_WORDS]:
                        rows.append((item, b" ".join(piece), len(piece), len(words) <= PIECE_WORDS))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 4, (pa.string(), pa.binary(), pa.int64(), pa.bool_()))],
                ["item", "words", "n", "whole"])

    return (items.select(F.col("item_id").cast("string").alias("item"), "text")
            .mapInArrow(tidy(run), "item string, words binary, n long, whole boolean").distinct())


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                       block_words: int = BLOCK_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, n_words, spans (word positions [start, end)), items, and the columns of ``carry``."""
    sc = docs.sparkSession.sparkContext
    pieces = save(benchmark_pieces(benchmark, window), "benchmark-pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // block_words)
    out = docs.selectExpr(
        "CAST(doc_id AS long) AS doc_id", "text", "CAST(NULL AS long) AS n_words",
        "CAST(array() AS array<struct<s:long,e:long>>) AS spans", "CAST(array() AS array<string>) AS items", *carry)
    schema = out.schema
    for k in range(max(1, blocks)):
        automaton = SuffixAutomaton(window)
        block = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(max(1, blocks))) == k)
        for r in block.collect():  # at most about block_words words
            automaton.add(r["item"], bytes(r["words"]).split(), r["whole"])
        shared = sc.broadcast(vars(automaton.finish()))  # plain containers, bounded by the block

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = SuffixAutomaton(window)
            vars(automaton).update(shared.value)
            for b in batches:
                n, spans, items = [], [], []
                for text, before, had in zip(*(b.column(c).to_pylist() for c in (1, 3, 4))):
                    words = item_words(text)
                    got, found = automaton.match(words)
                    n.append(len(words))
                    spans.append(merge_spans([*((x["s"], x["e"]) for x in before), *got]))
                    items.append(sorted({*had, *(x for x in found if x is not None)}))
                span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(n, pa.int64()),
                     pa.array([[{"s": s, "e": e} for s, e in x] for x in spans], span),
                     pa.array(items, pa.list_(pa.string())), *b.columns[5:]],
                    ["doc_id", "text", "n_words", "spans", "items", *carry])

        out = out.mapInArrow(tidy(run), schema)
        if k + 1 < blocks:
            out = save(out, f"contamination-{k}")
    return out


def judge(found: DataFrame, coverage: float = 0.05) -> DataFrame:
    """Adds n_hit and contaminated (covered share of at least ``coverage``)."""
    share = round(1 / coverage)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return (found.withColumn("n_hit", n_hit)
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.05) -> DataFrame:
    """docs with the same columns, without what exceeds a limit.

    Documents at or over the coverage limit go; of the others, spans as long as
    a window are cut out of the text, and n_chars follows.
    """
    names = docs.columns
    others = [c for c in names if c not in ("doc_id", "text", "n_chars")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *others).alias("in_row"))
    judged = judge(find_contamination(packed, benchmark, window, carry=("in_row",)), coverage).where("NOT contaminated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [cut_spans(t, [(x["s"], x["e"]) for x in s]) if s else t
                     for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), b.column(3)], ["doc_id", "text", "in_row"])

    cut = judged.select("doc_id", "text", "spans", "in_row").mapInArrow(tidy(run), judged.select("doc_id", "text", "in_row").schema)
    values = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text")}
    return cut.select([values[c].cast(docs.schema[c].dataType).alias(c) if c in values else F.col("in_row")[c].alias(c) for c in names])


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")
