"""N-gram Jaccard join by count-vector trees (operator 2).

A document is the set of its 5-word shingles; two link if their Jaccard
similarity is 0.8 or more. Equal sets are one class. Shingles are hashed into
groups, and a class is the point of its group counts, at two resolutions:

* fine (2**44 groups): sum(min(a, b)) over the groups bounds the overlap, so
  once the counts of a point's first groups, in one global order, leave too
  little for the threshold, a partner must share one of these groups. A point
  enters one tree for each of its first groups (its cells); every linked pair
  meets in a tree. The order puts groups last that a count over all shingles
  (a fixed-size sketch) finds hot, so that passages shared by many documents
  do not draw them into one tree;
* coarse (a group for two shingles or so): inside a tree, nodes hold the
  largest count in each group and the range of set sizes; pairs of nodes, then
  of points, are dropped when their summed coordinate minima cannot reach the
  overlap the threshold asks for. Survivors are verified on whole sets.

Links only need to span components, so four rounds look for them, each among
pairs that no earlier round has connected: each point against the smallest point
of its cells with which it shares most of them; then against those of all its cells;
then in one of FEW_CELLS trees of three points or more each point against its FEW most
promising partners; last, all these trees are joined in full. Trees of more than CELL_ROWS
points are dealt out as pairs of sub-trees, so no task holds an unbounded cell. A pair
that meets in several trees is handed on by the first only, as far as the FIRST smallest
cells of both points tell.

Sets to verify are computed from the texts a second time, for documents that pass a
fixed-size Bloom filter of the needed ones; so sets of all documents are never
stored or shuffled.

Defined cases: null and empty texts have no shingles and link with nothing;
texts under five words are one shingle; repeated rows are copies; the component
of documents without doc_id is the smallest known doc_id of their component.
Shingles and classes are known by 64-bit hashes, of which sets are compared by 48 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.common import (
    FILTER_BITS,
    distinct_sorted,
    filter_bits,
    filter_place,
    flag_rows,
    free_names,
    in_filter,
    save,
    shingle_hashes,
    slices,
    table,
    tidy,
)
from loglake.llm.components import across, connected_components, merge_components

WIDTH = 5
PERCENT = 80
FINE_SHIFT = 20
SKETCH = 1 << 20
SKETCH_SLICE = 1 << 16
FAN = 64
FIRST = 4
FEW = 4
FEW_CELLS = 8
HOT_MIN = 16
COARSE_MIN, COARSE_MAX = 64, 16384
CELL_ROWS = 4096
LEAF = 16
WIDE = 256

#: A-Z to a-z.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(texts: list[str | None]) -> list[np.ndarray]:
    """64-bit shingle hashes of whole texts, repeats included."""
    return shingle_hashes([t.encode().translate(LOWER) if t else b"" for t in texts], WIDTH)


def least_overlap(n: int) -> int:
    """Smallest overlap of a set of n with any partner: ceil(0.8 n)."""
    return -(-PERCENT * n // 100)


def first_groups(hashes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Fine groups that every partner shares one of: the first n - overlap + 1 in the global order."""
    n = len(hashes)
    take = n - least_overlap(n) + 1
    late = hot[(hashes & np.uint64(SKETCH - 1)).astype(np.int64)]
    if late.any():
        hashes = np.concatenate((hashes[~late], hashes[late]))
    return distinct_sorted(hashes[:take] >> np.uint64(FINE_SHIFT)).astype(np.int64)


def coarse_counts(hashes: np.ndarray) -> bytes:
    """Counts in 2**k groups of three shingles at most. Two groups share a byte, unless a
    count is too large for that: the first byte is the bits of a count."""
    size = COARSE_MIN
    while size * 3 < len(hashes) and size < COARSE_MAX:
        size *= 2
    counts = np.bincount(((hashes >> np.uint64(40)) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    most = counts.max(initial=0)
    if most < 16:
        return b"\x04" + (counts[0::2] << 4 | counts[1::2]).astype(np.uint8).tobytes()
    width = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32
    return bytes([np.dtype(width).itemsize * 8]) + counts.astype(width).tobytes()


def read_counts(raw: bytes) -> np.ndarray:
    if raw[0] == 4:
        both = np.frombuffer(raw, np.uint8, offset=1)
        counts = np.empty(2 * len(both), np.int32)
        counts[0::2], counts[1::2] = both >> 4, both & 15
        return counts
    return np.frombuffer(raw, {8: np.uint8, 16: np.uint16, 32: np.uint32}[raw[0]], offset=1).astype(np.int32)


def fold(counts: np.ndarray, size: int) -> np.ndarray:
    """The same point in fewer groups (sizes are powers of two); rows fold alike."""
    return counts if counts.shape[-1] == size else counts.reshape(*counts.shape[:-1], -1, size).sum(-2, dtype=np.int32)


def pack(hashes: np.ndarray) -> bytes:
    """The upper 48 bits of each hash: enough to compare two sets, a quarter less to move."""
    return (hashes >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def can_link(n_a: int, n_b: int, overlap: int) -> bool:
    """Whether overlap / (n_a + n_b - overlap) can reach the threshold."""
    return 100 * overlap >= PERCENT * (n_a + n_b - overlap)


class Node:
    """Box over points sorted by size: largest counts, size range, component if there is but one."""

    __slots__ = ("top", "low", "high", "start", "stop", "children", "component")

    def __init__(self, start: int, stop: int, top: np.ndarray, low: int, high: int, component, children=()):
        self.start, self.stop, self.top, self.low, self.high = start, stop, top, low, high
        self.component, self.children = component, children


class CountTree:
    """Bulk-loaded R-tree over count vectors."""

    def __init__(self, sizes: np.ndarray, vectors: list[np.ndarray], components: np.ndarray):
        self.sizes, self.vectors, self.components = sizes, vectors, components
        level = []
        for s in range(0, len(sizes), LEAF):
            e = min(s + LEAF, len(sizes))
            dims = min(len(v) for v in vectors[s:e])
            top = np.max([fold(v, dims) for v in vectors[s:e]], axis=0)
            level.append(self._node(s, e, top, int(sizes[s:e].min()), int(sizes[s:e].max()), components[s:e], ()))
        while len(level) > 1:
            level = [self._parent(level[i:i + LEAF]) for i in range(0, len(level), LEAF)]
        self.root = level[0]

    def _node(self, s, e, top, low, high, components, children) -> Node:
        same = components[0] if (components == components[0]).all() else None
        return Node(s, e, top, low, high, same, children)

    def _parent(self, nodes: list[Node]) -> Node:
        dims = min(len(n.top) for n in nodes)
        top = np.max([fold(n.top, dims) for n in nodes], axis=0)
        s, e = nodes[0].start, nodes[-1].stop
        return self._node(s, e, top, min(n.low for n in nodes), max(n.high for n in nodes), self.components[s:e], nodes)

    @staticmethod
    def _may_meet(a: Node, b: Node) -> bool:
        if a.component is not None and a.component == b.component:
            return False
        if 100 * a.high < PERCENT * b.low or 100 * b.high < PERCENT * a.low:
            return False
        dims = min(len(a.top), len(b.top))
        shared = int(np.minimum(fold(a.top, dims), fold(b.top, dims)).sum())
        return can_link(a.low, b.low, min(shared, a.high, b.high))

    def pairs(self, apart: np.ndarray | None = None) -> Iterator[tuple[int, int, float]]:
        """Positions (i < j) that may link, and the similarity that the bound leaves possible;
        ``apart``: only of points marked differently."""
        stack = [(self.root, self.root)]
        while stack:
            a, b = stack.pop()
            if not self._may_meet(a, b):
                continue
            if a.children:
                for i, x in enumerate(a.children):
                    for y in (a.children[i:] if a is b else b.children or (b,)):
                        stack.append((x, y))
            elif b.children:
                stack.extend((a, y) for y in b.children)
            else:
                yield from self._leaf_pairs(a, b, apart)

    def _leaf_pairs(self, a: Node, b: Node, apart: np.ndarray | None) -> Iterator[tuple[int, int, float]]:
        dims = min(len(self.vectors[i]) for n in (a, b) for i in range(n.start, n.stop))
        left, right = (np.stack([fold(self.vectors[i], dims) for i in range(n.start, n.stop)]) for n in (a, b))
        of_a, of_b = slice(a.start, a.stop), slice(b.start, b.stop)
        n_a, n_b = self.sizes[of_a, None], self.sizes[of_b]
        if dims <= WIDE:  # all pairs at once, which stay in a core's cache
            shared = np.minimum(left[:, None], right).sum(2)
        else:
            shared = np.stack([np.minimum(right, x).sum(1) for x in left])
        shared = np.minimum(np.minimum(shared, n_b), n_a)
        ok = 100 * shared >= PERCENT * (n_a + n_b - shared)
        ok &= self.components[of_a, None] != self.components[of_b]
        if apart is not None:
            ok &= apart[of_a, None] != apart[of_b]
        if a is b:
            ok = np.triu(ok, 1)
        for i, j in zip(*(x.tolist() for x in np.nonzero(ok))):
            n = int(shared[i, j])
            i, j = i + a.start, j + b.start
            yield i, j, n / (self.sizes[i] + self.sizes[j] - n)


def hot_groups(docs: DataFrame) -> np.ndarray:
    """Sketch positions whose count over all documents stands out.

    Every task counts into SKETCH counters, which are summed slice by slice,
    in a few levels, so that no task gets more than some slices of FAN tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(SKETCH, np.int64)
        for b in slices(batches):
            found = np.concatenate(shingles(b.column(0).to_pylist()))
            counts += np.bincount((found & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        for k, part in enumerate(np.split(counts, SKETCH // SKETCH_SLICE)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                ["slice", "part", "counts"])

    def add(pdf):
        total = sum(np.frombuffer(x, np.int64) for x in pdf["counts"])
        return pdf.iloc[:1].assign(counts=[total.tobytes()], part=[int(pdf["part"].iloc[0]) // FAN])

    schema = "slice int, part int, counts binary"
    sums = docs.select("text").mapInArrow(tidy(run), schema)
    for level in range(3):
        keys = ["slice"] if level == 2 else ["slice", F.floor(F.col("part") / FAN)]
        sums = sums.groupBy(*keys).applyInPandas(add, schema)
    counts = np.zeros(SKETCH, np.int64)
    for r in sums.collect():  # SKETCH counters in all
        counts[r["slice"] * SKETCH_SLICE:(r["slice"] + 1) * SKETCH_SLICE] += np.frombuffer(r["counts"], np.int64)
    mean = counts.mean()
    return counts > mean + 8 * mean ** 0.5 + HOT_MIN


def points(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text), n, class; cells and counts where the class is new to the task."""
    hot = docs.sparkSession.sparkContext.broadcast(np.packbits(hot_groups(docs)).tobytes())  # SKETCH bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen = set()
        late = np.unpackbits(np.frombuffer(hot.value, np.uint8)).astype(bool)
        for b in slices(batches):
            rows = []
            for h in map(distinct_sorted, shingles(b.column(2).to_pylist())):
                if not len(h):
                    rows.append((0, None, None, None))
                    continue
                kind = xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)
                if kind in seen:
                    rows.append((len(h), kind, None, None))
                else:
                    seen.add(kind)
                    rows.append((len(h), kind, first_groups(h, late), coarse_counts(h)))
            n, kind, cells, counts = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(kind, pa.int64()), pa.array(cells, pa.list_(pa.int64())),
                 pa.array(counts, pa.binary())], ["doc_id", "row", "n", "class", "cells", "counts"])

    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(tidy(run), "doc_id long, row long, n long, class long, cells array<long>, counts binary")


def may_link(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) whose coarse counts allow a link."""
    for side in "ab":
        pairs = pairs.join(known.select(F.col("class").alias(side), F.col("n").alias(f"n_{side}"), F.col("counts").alias(f"counts_{side}")), side)
        if side == "b":
            pairs = pairs.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n_a, n_b, x, y in zip(*(b.column(c).to_pylist() for c in ("n_a", "n_b", "counts_a", "counts_b"))):
                x, y = read_counts(x), read_counts(y)
                dims = min(len(x), len(y))
                shared = int(np.minimum(fold(x, dims), fold(y, dims)).sum())
                keep.append(can_link(n_a, n_b, min(shared, n_a, n_b)))
            yield b.select(["a", "b", "shared"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "shared", "n_a", "n_b", "counts_a", "counts_b").mapInArrow(tidy(run), "a long, b long, shared long")


def verified(pairs: DataFrame, docs: DataFrame, first_docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose sets link, checked on the whole sets."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    needed = first_docs.join(ends, "class").select(filter_place(["doc_id"]).alias("at"))
    bits = docs.sparkSession.sparkContext.broadcast(filter_bits(needed))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in slices(b.filter(pa.array(in_filter(bits.value, b.column(0).to_numpy()), pa.bool_())) for b in batches):
            sets = [h for h in map(distinct_sorted, shingles(b.column(1).to_pylist())) if len(h)]
            kinds = [xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63) for h in sets]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(list(map(pack, sets)), pa.binary())],
                                             ["class", "hashes"])

    # What the filter lets through without need finds no pair; both joins read one exchange.
    sets = docs.select(filter_place(["doc_id"]).alias("at"), "text").mapInArrow(tidy(compute), "class long, hashes binary").repartition("class")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = unpack(x), unpack(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(can_link(len(x), len(y), both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    whole = pairs.select("a", "b")
    for side in "ba":
        whole = whole.join(sets.select(F.col("class").alias(side), F.col("hashes").alias(f"set_{side}")), side)
    return whole.select("a", "b", "set_a", "set_b").mapInArrow(tidy(check), "a long, b long").distinct()


def shared_cells(every: DataFrame) -> DataFrame:
    """cell, class, hub (the smallest class), k (classes) of the cells of two or more classes.

    Most cells are of one class: only their count is shuffled. Cells that occur
    again are marked in a fixed-size filter, and only what it lets through is joined.
    """
    dealt = every.where("cells IS NOT NULL").select("class", "cells")
    again = save(dealt.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cell"),
                 "join-again")
    bits = every.sparkSession.sparkContext.broadcast(filter_bits(again.select((F.col("cell") % FILTER_BITS).alias("at"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b.column(1)
            flat = cells.flatten().to_numpy()
            owners = np.repeat(b.column(0).to_numpy(), cells.value_lengths().to_numpy())
            keep = in_filter(bits.value, flat % FILTER_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(flat[keep]), pa.array(owners[keep])], ["cell", "class"])

    shared = save(dealt.mapInArrow(tidy(run), "cell long, class long").join(again, "cell", "left_semi").distinct(), "join-shared")
    # Written first, here and below: a join of two exchanges, whose hot keys Spark can split.
    hubs = save(shared.groupBy("cell").agg(F.min("class").alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1"), "join-hubs")
    return save(shared.join(hubs, "cell"), "join-cells")


def most_promising(pairs: Iterator[tuple[int, int, float]], few: int) -> Iterator[tuple[int, int, float]]:
    """Of each point the pairs of the greatest possible similarity."""
    best: dict[int, list] = {}
    for i, j, similarity in pairs:
        for x, y in ((i, j), (j, i)):
            heap = best.setdefault(x, [])
            if len(heap) < few:
                heapq.heappush(heap, (similarity, y))
            elif heap[0][0] < similarity:
                heapq.heapreplace(heap, (similarity, y))
    return ((x, y, similarity) for x, heap in best.items() for similarity, y in heap)


def tree_pairs(shared: DataFrame, labels: DataFrame, known: DataFrame, few: int | None = None, least: int = 2) -> DataFrame:
    """Pairs (a, b) across components that meet in a tree and pass its bounds.

    ``few``: only the most promising so many of each point in each tree, for a round before the full one.
    ``least``: classes that a cell must have.
    """
    rows = (shared.join(labels, shared["class"] == labels["node"], "left")
            .select("cell", "class", F.coalesce("component", "class").alias("component")))
    open_cells = (rows.groupBy("cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("k"))
                  .where((F.col("lo") != F.col("hi")) & (F.col("k") >= least)).select("cell", F.ceil(F.col("k") / CELL_ROWS).cast("int").alias("parts")))
    open_cells = save(open_cells, "join-open")
    rows = rows.join(open_cells, "cell").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    rows = (rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .join(known.select("class", "n", "counts", "first"), "class")
            .select("cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "class", "component",
                    "n", "counts", "first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: list[tuple] = []
        key, found = None, set()

        def flush():
            if len(tree) > 1:
                tree.sort(key=lambda r: (r[2], r[0]))
                ids, components, sizes, raw, parts, first = zip(*tree)
                apart = np.array(parts) if key[1] != key[2] else None
                index = CountTree(np.array(sizes), [read_counts(x) for x in raw], np.array(components))
                pairs = index.pairs(apart)
                if few is not None:
                    pairs = most_promising(pairs, few)
                else:  # A smaller common cell has the pair as well.
                    pairs = (p for p in pairs if not any(c < key[0] for c in first[p[0]] if c in first[p[1]]))
                for i, j, _ in pairs:
                    found.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
            tree.clear()

        def batch():
            a, b = zip(*found) if found else ((), ())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for b in batches:
            for cell, i, j, part, kind, component, n, counts, first in zip(*(c.to_pylist() for c in b.columns)):
                if (cell, i, j) != key:
                    flush()
                    key = (cell, i, j)
                    if len(found) > 10_000:
                        yield batch()
                if not tree or tree[-1][0] != kind:
                    tree.append((kind, component, n, counts, part, first))
        flush()
        yield batch()

    dealt = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "class")
    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_shingles, class, component (of classes), component_id for every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = save(points(docs), "join-points")
    first_docs = save(every.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "join-classes")
    known = save(every.where("counts IS NOT NULL").select("class", "n", "counts", F.slice("cells", 1, FIRST).alias("first"))
                 .dropDuplicates(["class"]), "join-counts")
    shared = shared_cells(every)

    to_hub = shared.where("class <> hub").groupBy(F.col("hub").alias("a"), F.col("class").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    to_hub = save(may_link(to_hub, known), "join-hub-pairs")
    best = to_hub.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    labels = connected_components(save(verified(save(best, "join-best"), docs, first_docs), "join-links"))
    crowded = shared.where("k > 2").select("cell", "class")
    some = crowded.where(F.col("cell") % FEW_CELLS == 0)
    for pairs in (lambda: across(to_hub, labels), lambda: tree_pairs(some, labels, known, FEW), lambda: tree_pairs(crowded, labels, known)):
        found = save(pairs().select("a", "b"), "join-pairs")
        if not found.isEmpty():
            more = save(verified(found, docs, first_docs), "join-links")
            if not more.isEmpty():
                labels = merge_components(labels, more)

    grouped = first_docs.join(labels, first_docs["class"] == labels["node"], "left").select(
        "class", "doc_id", "copies", F.coalesce("component", "class").alias("component"))
    ids = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.sum("copies").alias("n_group"))
    ids = grouped.join(save(ids.where("n_group > 1"), "join-ids"), "component").select("class", "component", "component_id", "n_group")
    return every.select("doc_id", "row", "n", "class").join(ids, "class", "left").select(
        "doc_id", "row", F.col("n").alias("n_shingles"), "class", "component",
        F.when(F.col("n_group").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: the smallest doc_id, then text hash.

    Rows that a fixed-size filter shows to be in no group pass by; only the
    others are joined (and shuffled). Equal repeated rows leave one.
    """
    grouped = save(link_components(docs).where("component IS NOT NULL").select("component", "doc_id", "row"), "join-grouped")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("x")
    chosen = grouped.groupBy("component").agg(first).select("x.doc_id", "x.row")
    i, row, mark = free_names(docs, "_id", "_row", "_grouped")
    keyed = docs.withColumn(row, F.xxhash64("text")).withColumn(i, F.col("doc_id").cast("long"))
    marked = flag_rows(keyed, grouped.select(F.col("doc_id").alias(i), F.col("row").alias(row)), [i, row], mark)
    lost = (grouped.alias("g").join(chosen.alias("c"), F.expr("g.doc_id <=> c.doc_id AND g.row = c.row"), "left_anti")
            .select(F.col("doc_id").alias(i), F.col("row").alias(row)).distinct())
    kept = (marked.where(F.col(mark)).alias("n").join(lost.alias("l"), F.col(f"n.{i}").eqNullSafe(F.col(f"l.{i}")) & (F.col(f"n.{row}") == F.col(f"l.{row}")), "left_anti")
            .dropDuplicates([i, row]))
    return marked.where(~F.col(mark)).unionByName(kept).drop(i, row, mark)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
