"""Ranked lexical search on K2-treaps (operator 11).

The term-document grid is cut into shards of consecutive documents. A shard is a
compressed quadtree over its grid (rows: its terms, frequent ones first; columns: its documents by
doc_id): a cell is split into four while it holds two postings or more, and keeps
the largest impact below it. The index is a table with one row a shard, independent of any query.

A search follows, for each item, the rows of its terms down all at once over ranges
of documents. What is open is a document range with the cell of each term that is left; its
bound is the sum of the terms' weights times the cells' largest impacts. The best ranges of
each item are opened first and halved; a range whose bound cannot pass the
item's k-th score so far is dropped. The k best of every task are merged.

An impact is (10**9 * tf) div (1000 * tf + 8 * m), where m follows the document's length
against the mean; a term's weight is floor(1000 * ln((2N + 2) / (2 df + 1))), and
the df of a term is the sum of the postings in its rows.

Items are taken in blocks of about BLOCK_TERMS terms, which are broadcast; a task holds one
shard of SHARD_TERMS terms (or one longer document) and the open ranges
of ITEMS items at a time.

Defined cases: null and empty texts have no terms and are never found; items without
terms, or whose terms occur nowhere, have no rows; rows of one item_id are one
item; equal scores go by doc_id, rows without one last; repeated documents
are ranked one by one; further columns are ignored. Terms are known by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loglake.llm.common import hash_words, save, slices, table

K = 10
SHARD_DOCS = 4_096
SHARD_TERMS = 300_000
BLOCK_TERMS = 200_000
ITEMS = 64
#: Ranges of one item that are opened at a time.
WIDE = 64
NO_ID = (1 << 63) - 1

#: Letters of terms as they are compared; every other ASCII character parts terms.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))

INDEX = ("n_docs int, doc_ids binary, terms binary, term_rows binary, term_counts binary, "
         "cells binary, tops binary, leaf_rows binary, leaf_columns binary")


def term_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms in order, repeats included, and the number of terms of each text."""
    return hash_words([t.encode().translate(TERM_BYTES) if t else b"" for t in texts])


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in slices(batches):
            counts = term_hashes(b.column(0).to_pylist())[1]
            n += int((counts > 0).sum())
            total += int(counts.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    row = docs.select("text").mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def spread(x: np.ndarray) -> np.ndarray:
    """The bits of x (under 2**32) at the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


def depth(n_rows: int, n_columns: int) -> int:
    return max(1, (n_rows - 1).bit_length(), (n_columns - 1).bit_length())


def build_treap(rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, levels: int) -> dict[str, np.ndarray]:
    """The quadtree of distinct postings, cells in breadth-first order.

    ``cells``: which of a cell's four quarters exist (0: one posting, a leaf); ``tops``:
    the largest impact; the rows and columns of leaves, in the same order.
    """
    code = (spread(rows) << np.uint64(1) | spread(columns)).astype(np.int64)
    order = np.argsort(code, kind="stable")
    code, rows, columns, impacts = code[order], rows[order], columns[order], impacts[order]
    cells, tops, leaves = [], [], []
    at = np.arange(len(code))  # postings in cells that are split so far
    starts = np.zeros(1, np.int64)
    for level in range(levels + 1):
        sizes = np.diff(np.append(starts, len(at)))
        tops.append(np.maximum.reduceat(impacts[at], starts))
        single = sizes == 1
        bitmap = np.zeros(len(starts), np.uint8)
        leaves.append(at[starts[single]])
        inside = np.repeat(~single, sizes)
        owner = np.repeat(np.cumsum(~single) - 1, sizes)[inside]
        at = at[inside]
        if len(at):
            quarter = code[at] >> 2 * (levels - level - 1) & 3
            part = owner * 4 + quarter
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            found = np.zeros(int((~single).sum()), np.uint8)
            np.bitwise_or.at(found, part[starts] >> 2, (1 << (part[starts] & 3)).astype(np.uint8))
            bitmap[~single] = found
        cells.append(bitmap)
        if not len(at):
            break
    leaf = np.concatenate(leaves)
    return {"cells": np.concatenate(cells), "tops": np.concatenate(tops).astype(np.uint32),
            "leaf_rows": rows[leaf].astype(np.uint32), "leaf_columns": columns[leaf].astype(np.uint32)}


def build_shard(ids: list[int], terms: np.ndarray, counts: np.ndarray, n: int, total: int) -> tuple | None:
    """One row of the index; None if no document has a term."""
    ids, order = np.unique(np.array(ids, np.int64), return_inverse=True) if len(set(ids)) == len(ids) else (
        np.sort(np.array(ids, np.int64)), np.argsort(np.argsort(np.array(ids, np.int64), kind="stable")))
    if not len(terms):
        return None
    column = np.repeat(order, counts)
    names, row = np.unique(terms, return_inverse=True)
    cell, tf = np.unique(row * len(ids) + column, return_counts=True)
    row, column = np.divmod(cell, len(ids))
    df = np.bincount(row)
    place = np.empty(len(names), np.int64)
    place[np.argsort(-df, kind="stable")] = np.arange(len(names))
    m = np.zeros(len(ids), np.int64)
    for i, c in zip(order.tolist(), counts.tolist()):
        m[i] = 10 + 90 * c * n // total
    impacts = 10**9 * tf // (1000 * tf + 8 * m[column])
    treap = build_treap(place[row], column, impacts, depth(len(names), len(ids)))
    parts = (ids, names, place.astype(np.uint32), df.astype(np.uint32), *treap.values())
    return (len(ids), *(x.tobytes() for x in parts))


def build_index(docs: DataFrame, n: int, total: int) -> DataFrame:
    """The index of all documents: INDEX, one row a shard. ``n``, ``total``: :func:`corpus_size`."""

    def shard(ids, terms, counts) -> Iterator[pa.RecordBatch]:
        row = build_shard(ids, np.concatenate(terms), np.concatenate(counts), n, total)
        if row is not None:
            schema = pa.schema([("n_docs", pa.int32()), *((c.split()[0], pa.binary()) for c in INDEX.split(", ")[1:])])
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, counts, size = [], [], [], 0
        for b in slices(batches, 100):
            found, n_terms = term_hashes(b.column(1).to_pylist())
            if ids and (size + len(found) > SHARD_TERMS or len(ids) + b.num_rows > SHARD_DOCS):
                yield from shard(ids, terms, counts)
                ids, terms, counts, size = [], [], [], 0
            ids += b.column(0).to_pylist()
            terms.append(found)
            counts.append(n_terms)
            size += len(found)
        if ids:
            yield from shard(ids, terms, counts)

    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc_id"), "text").mapInArrow(run, INDEX)


class Treap:
    """A row of the index, ready to be searched."""

    def __init__(self, n_docs, doc_ids, terms, term_rows, term_counts, cells, tops, leaf_rows, leaf_columns):
        self.ids = np.frombuffer(doc_ids, np.int64)
        self.terms, self.places = np.frombuffer(terms, np.uint64), np.frombuffer(term_rows, np.uint32)
        self.counts = np.frombuffer(term_counts, np.uint32)
        self.cells, self.tops = np.frombuffer(cells, np.uint8), np.frombuffer(tops, np.uint32)
        self.leaf_rows, self.leaf_columns = (np.frombuffer(x, np.uint32) for x in (leaf_rows, leaf_columns))
        quarters = np.bitwise_count(self.cells)
        self.first = np.cumsum(quarters, dtype=np.uint32) - quarters + np.uint32(1)
        self.leaf = np.cumsum(self.cells == 0, dtype=np.int32) - 1
        self.leaf[self.cells != 0] = -1
        self.levels = depth(len(self.terms), n_docs)

    def rows_of(self, names: np.ndarray) -> np.ndarray:
        """Row of each term, or -1."""
        at = np.minimum(np.searchsorted(self.terms, names), len(self.terms) - 1)
        return np.where(self.terms[at] == names, self.places[at].astype(np.int64), -1)

    def quarter(self, cell: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a quarter of each cell exists, and where it is."""
        bits = self.cells[cell].astype(np.int64)
        return bits >> which & 1 == 1, self.first[cell].astype(np.int64) + np.bitwise_count(bits & ((1 << which) - 1))


class Best:
    """The k best (score, doc_id) of each of some items."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.item, self.score, self.doc = (np.empty(0, np.int64),) * 3
        self.least = np.zeros(n_items, np.int64)  # score and doc_id of the k-th
        self.last = np.full(n_items, NO_ID)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.k
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]
        full = rank == self.k - 1
        self.least[item[full]], self.last[item[full]] = score[full], doc[full]

    def may_enter(self, item: np.ndarray, bound: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether something of this score and doc_id, at best, can be among the k best."""
        return (bound > self.least[item]) | (bound == self.least[item]) & (bound > 0) & (doc <= self.last[item])


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All positions of the given stretches, one behind the other."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


def search_shard(treap: Treap, item: np.ndarray, names: np.ndarray, weights: np.ndarray, best: Best) -> None:
    """Enter the documents of a shard among the best. ``item``, ``names``, ``weights``: one row a term, by item."""
    rows = treap.rows_of(names)
    found = np.flatnonzero((rows >= 0) & (weights > 0))
    if not len(found):
        return
    item, rows, weights = item[found], rows[found], weights[found]
    # Open ranges of documents (item, level, first document, bound) and, stretch by
    # stretch, the entries (term, cell) of each. At first the whole shard for every item.
    starts = np.flatnonzero(np.diff(item, prepend=-1))
    n_entries = np.diff(np.append(starts, len(item)))
    terms, cells = np.arange(len(item)), np.zeros(len(item), np.int64)
    if treap.cells[0] == 0:  # a grid of one posting
        ok = rows == treap.leaf_rows[0]
        best.add(item[ok], weights[ok] * int(treap.tops[0]), np.full(int(ok.sum()), treap.ids[treap.leaf_columns[0]]))
        return
    owner, level, first = item[starts], np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    bound = np.add.reduceat(weights * int(treap.tops[0]), starts)
    while len(owner):
        ok = best.may_enter(owner, bound, treap.ids[np.minimum(first, len(treap.ids) - 1)])
        order = np.lexsort((-bound[ok], owner[ok]))
        live = np.flatnonzero(ok)[order]
        place = np.arange(len(live)) - np.searchsorted(owner[live], owner[live])
        now, later = live[place < WIDE], live[place >= WIDE]

        # Open the best ranges: every term goes to its quarters of both halves.
        spot = gather(starts[now], n_entries[now])
        range_of = np.repeat(np.arange(len(now)), n_entries[now])
        t, c = terms[spot], cells[spot]
        below = treap.levels - level[now][range_of] - 1  # bits of rows and columns under this level
        leaf = treap.leaf[c]
        is_leaf = leaf >= 0
        halves = []
        for half in (0, 1):
            exists, child = treap.quarter(c, (rows[t] >> below & 1) * 2 + half)
            exists &= ~is_leaf
            exists[is_leaf] = (treap.leaf_columns[leaf[is_leaf]] >> below[is_leaf] & 1) == half
            child[is_leaf] = c[is_leaf]
            # A cell with one posting counts for that posting's term only.
            one = np.flatnonzero(exists)
            one = one[treap.leaf[child[one]] >= 0]
            exists[one] = treap.leaf_rows[treap.leaf[child[one]]] == rows[t[one]]
            halves.append((range_of[exists] + half * len(now), t[exists], child[exists]))
        part, t, c = (np.concatenate(x) for x in zip(*halves))
        new = np.flatnonzero(np.diff(part, prepend=-1))
        parent, half = part[new] % max(1, len(now)), part[new] // max(1, len(now))
        new_owner, new_level = owner[now][parent], level[now][parent] + 1
        new_first = first[now][parent] + (half << np.maximum(treap.levels - new_level, 0))
        new_bound = np.add.reduceat(weights[t] * treap.tops[c], new) if len(new) else np.empty(0, np.int64)
        new_entries = np.diff(np.append(new, len(t)))

        # A range is done if it is one document, or only one document has postings left in it.
        column = np.where(treap.leaf[c] >= 0, treap.leaf_columns[treap.leaf[c]].astype(np.int64), -1)
        if len(new):
            low, high = np.minimum.reduceat(column, new), np.maximum.reduceat(column, new)
            done = (low == high) & (low >= 0)
            best.add(new_owner[done], new_bound[done], treap.ids[low[done]])
            rest = np.flatnonzero(~done)
        else:
            rest = new
        stay = gather(starts[later], n_entries[later])
        more = gather(new[rest], new_entries[rest])
        terms, cells = np.concatenate((terms[stay], t[more])), np.concatenate((cells[stay], c[more]))
        n_entries = np.concatenate((n_entries[later], new_entries[rest]))
        starts = np.cumsum(n_entries) - n_entries
        owner, level = np.concatenate((owner[later], new_owner[rest])), np.concatenate((level[later], new_level[rest]))
        first, bound = np.concatenate((first[later], new_first[rest])), np.concatenate((bound[later], new_bound[rest]))


def read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in b.columns)


def document_counts(index: DataFrame, names: np.ndarray) -> dict[int, int]:
    """df of each of the named terms that occurs."""
    shared = index.sparkSession.sparkContext.broadcast(np.sort(names).tobytes())  # a block's terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.frombuffer(shared.value, np.uint64)
        total = np.zeros(len(asked), np.int64)
        for terms, counts in read_shards(batches):
            terms, counts = np.frombuffer(terms, np.uint64), np.frombuffer(counts, np.uint32)
            at = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
            total += np.where(terms[at] == asked, counts[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(asked[some].view(np.int64)), pa.array(total[some])], ["term", "df"])

    rows = index.select("terms", "term_counts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"] % (1 << 64): r["df"] for r in rows.collect()}  # at most a block's terms


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term: the distinct terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found, counts = term_hashes(b.column(1).to_pylist())
            at = np.repeat(np.arange(b.num_rows), counts)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(found.view(np.int64))], ["item_id", "term"])

    return (items.select(items[id_col].cast("string").alias("item_id"), items[text_col].alias("text"))
            .mapInArrow(run, "item_id string, term long").distinct())


def search_block(index: DataFrame, entries: list, n: int, k: int) -> DataFrame:
    """item_id, doc_id, score: the k best of every task for a block of items (rows item_id, term)."""
    ids = sorted({r["item_id"] for r in entries}, key=lambda x: (x is None, x or ""))
    place = {x: i for i, x in enumerate(ids)}
    item = np.array([place[r["item_id"]] for r in entries], np.int64)
    names = np.array([r["term"] for r in entries], np.int64).view(np.uint64)
    counts = document_counts(index, np.unique(names))
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, df in counts.items()}
    weights = np.array([weight.get(t, 0) for t in names.tolist()], np.int64)
    order = np.lexsort((names, item))
    shared = index.sparkSession.sparkContext.broadcast((ids, item[order], names[order], weights[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, item, names, weights = shared.value
        best = [Best(min(ITEMS, len(ids) - i), k) for i in range(0, len(ids), ITEMS)]
        cuts = np.searchsorted(item, np.arange(0, len(ids) + ITEMS, ITEMS))
        for row in read_shards(batches):
            treap = Treap(*row)
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                search_shard(treap, item[a:b] - i * ITEMS, names[a:b], weights[a:b], best[i])
        for i, x in enumerate(best):
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[j + i * ITEMS] for j in x.item], pa.string()), pa.array(x.doc, pa.int64(), mask=x.doc == NO_ID), pa.array(x.score)],
                ["item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item_id string, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, n: int, k: int = K) -> DataFrame:
    """item_id (string), rank, doc_id, score: the k best documents of each item."""
    terms = save(item_terms(items), "search-terms")
    blocks = max(1, -(-terms.count() // BLOCK_TERMS))
    found = None
    for i in range(blocks):
        entries = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect()  # about BLOCK_TERMS
        part = search_block(index, entries, n, k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    n, total = corpus_size(docs)
    index = save(build_index(docs, n, total), "search-index", maxRecordsPerFile=8)
    return search(index, items, n).withColumn("item_id", F.col("item_id").cast(items.schema["item_id"].dataType))


ORACLE = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS n_docs, sum(n)::HUGEINT AS n_terms FROM d),
m AS (SELECT doc_id, (10 + (90 * n::HUGEINT * n_docs) // n_terms)::BIGINT AS m FROM d, s),
p AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 10
"""
