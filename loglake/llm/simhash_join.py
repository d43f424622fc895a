"""SimHash near-dedup with vantage-point trees (operator 12).

A text's fingerprint has a bit set if more than half of its shingles' 64-bit hashes
have it. Fingerprints within RADIUS differing bits link.

Distinct fingerprints are dealt to shards by vantage-point trees. A node has a
vantage fingerprint and a distance: what is nearer goes to one side, what is
farther to the other. By the triangle inequality two linked fingerprints differ by RADIUS at
most in their distance to the vantage, so only a near one that close to the
border has partners on the far side; there it comes along as a visitor, which is
compared with the residents and dealt on in the same way. Every linked pair thus meets
in a shard in which one of the two is resident.

Inside a shard a tree of its own is descended by all residents and visitors
together, branches being pruned by the same bounds, down to leaves that are compared
whole. A shard hands on only the links that span its components, so a crowd of
near copies gives as many links as it has members.

Trees for dealing are built from small samples: one for all fingerprints, then one
for each shard that still has CROWDED times CELL rows. What has that after the second is a crowd
that no vantage parts, because most of it lies within RADIUS of every border.
Its links are found without a tree: two fingerprints within 2 bits
share a centre that is within 1 bit of both, and a centre has 65 members at most.

Defined cases: null, empty and blank texts have the fingerprint zero, which
links like any other; texts of fewer words than a shingle are one shingle;
repeated rows are copies; rows without doc_id get the smallest known doc_id of
their component; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.common import save, slices, table
from loglake.llm.components import connected_components

WIDTH = 3
SEED = 42
RADIUS = 2
#: Fingerprints a shard should have, how many times that with visitors is too much, and
#: fingerprints sampled for each shard of a tree.
CELL = 32_768
CROWDED = 4
PER_SHARD = 64
#: Shards of one tree: a second round of trees makes this squared.
MOST_SHARDS = 1_024
LEAF = 1_024
COMPARE = 1 << 20
#: Borders in a row that part hardly anything, after which a crowd is not parted further.
VAIN = 3

#: A-Z to a-z.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64-bit fingerprint of a whole text."""
    import xxhash

    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(list(map(len, words))) + np.arange(1, len(words) + 1)
    starts = [0, *ends[:-1].tolist()]
    stops = (ends[min(width, len(words)) - 1:] - 1).tolist()
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops))
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(h), COMPARE // 64):
        set_bits += np.unpackbits(h[i:i + COMPARE // 64].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print (the fingerprint as a signed integer): one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            prints = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints)], ["doc_id", "print"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, print long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def split(prints: np.ndarray, tries: np.ndarray) -> tuple[np.uint64, int] | None:
    """Vantage and distance that part the prints best: evenly, with few at the border."""
    best, chosen = None, None
    for v in tries:
        d = distance(prints, v).astype(np.int64)
        counts = np.cumsum(np.bincount(d, minlength=65))
        mu = int(np.searchsorted(counts, (len(d) + 1) // 2))
        for at in {max(0, mu - 1), mu}:
            near = int(counts[at])
            if 0 < near < len(d):
                border = int(counts[min(64, at + RADIUS)] - (counts[at - RADIUS] if at >= RADIUS else 0))
                cost = max(near, len(d) - near) + border
                if best is None or cost < best:
                    best, chosen = cost, (v, at)
    return chosen


def build_tree(sample: np.ndarray, shards: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, distance, near child, far child) of a dealing tree; children
    under zero are shards, -1 - number. Shards split evenly while the sample allows."""
    nodes: list[tuple[int, int, int, int]] = []
    count = 0

    def grow(prints: np.ndarray, share: int) -> int:
        nonlocal count
        cut = split(prints, prints[::max(1, len(prints) // 8)][:8]) if share > 1 and len(prints) > 1 else None
        if cut is None:
            count += 1
            return -count
        at = len(nodes)
        nodes.append((0, 0, 0, 0))
        near = distance(prints, cut[0]) <= cut[1]
        nodes[at] = (int(cut[0]), cut[1], grow(prints[near], share // 2), grow(prints[~near], share - share // 2))
        return at

    grow(np.unique(sample.astype(np.uint64)), shards)
    return nodes


def deal(nodes: list[tuple[int, int, int, int]], prints: np.ndarray, resident: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, rows, resident flags): residents go to one shard, visitors to all
    that may hold a partner."""
    stack = [(0 if nodes else -1, np.arange(len(prints)), resident)]
    while stack:
        at, rows, here = stack.pop()
        if not len(rows):
            continue
        if at < 0:
            yield -1 - at, rows, here
            continue
        vantage, mu, near, far = nodes[at]
        for child, (r, h) in zip((near, far), sides(distance(prints[rows], np.uint64(vantage)), mu, rows, here)):
            stack.append((child, r, h))


def sides(d: np.ndarray, mu: int, rows: np.ndarray, here: np.ndarray):
    """Rows and resident flags of the near and the far side of a border."""
    d = d.astype(np.int64)
    close = d <= mu
    to_near = np.where(here, close, d <= mu + RADIUS)
    to_far = ~close | (d > mu - RADIUS)
    yield rows[to_near], here[to_near]
    yield rows[to_far], (here & ~close)[to_far]


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest position of each group) after links (a, b) between positions."""
    while True:
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            return label
        for side in (a, b):
            np.minimum.at(label, label[side], low)
        while (label != label[label]).any():
            label = label[label]


#: No bit and each of the 64 bits.
FLIPS = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)))


def crowd_pairs(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) that connect what links among all prints, by common centres."""
    centres = (prints[:, None] ^ FLIPS).ravel()
    order = np.argsort(centres, kind="stable")
    same = np.flatnonzero(np.diff(centres[order]) == 0)
    return order[same] // len(FLIPS), order[same + 1] // len(FLIPS)


def shard_links(prints: np.ndarray, resident: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) that span the components of one shard: residents against all."""
    label = np.arange(len(prints))
    found = [(label[:0], label[:0])]
    stack = [(label, resident, 0)]
    while stack:
        rows, here, vain = stack.pop()
        home = rows[here]
        if not len(home) or len(rows) < 2:
            continue
        if len(rows) > LEAF and vain < VAIN:
            cut = split(prints[home], prints[home[::max(1, len(home) // 4)][:4]]) if len(home) > 1 else None
            if cut is not None:
                parts = list(sides(distance(prints[rows], cut[0]), cut[1], rows, here))
                vain = vain + 1 if max(len(r) for r, _ in parts) > 0.9 * len(rows) else 0
                stack.extend((r, h, vain) for r, h in parts)
                continue
        if len(home) * len(rows) > COMPARE:  # a crowd that no border parts
            a, b = crowd_pairs(prints[rows])
            found.append((rows[a], rows[b]))
        else:
            a, b = np.nonzero(distance(prints[home][:, None], prints[rows][None, :]) <= RADIUS)
            found.append((home[a], rows[b]))
    label = joined(label, *(np.concatenate(x) for x in zip(*found)))
    apart = np.flatnonzero(label != np.arange(len(label)))
    return apart, label[apart]


def dealt(prints: DataFrame, shards: DataFrame) -> DataFrame:
    """shard, print, resident after one round of trees.

    ``prints``: shard, print, resident; ``shards``: shard and ``parts``, the number of
    shards to make of it. The trees are built in tasks from PER_SHARD sampled
    residents for each part; at most MOST_SHARDS trees of at most MOST_SHARDS nodes reach the driver.
    """
    many = prints.where("resident").join(F.broadcast(shards), "shard")  # MOST_SHARDS rows
    sampled = many.where(F.pmod(F.xxhash64("print"), F.lit(1 << 30)) < F.col("parts") * PER_SHARD * F.lit(float(1 << 30)) / F.col("rows"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = build_tree(np.sort(pdf["print"].to_numpy().view(np.uint64)), int(pdf["parts"].iloc[0]))
        raw = np.array(nodes, dtype=[("v", "<u8"), ("mu", "<i4"), ("near", "<i4"), ("far", "<i4")]).tobytes()
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "nodes": [raw]})

    found = sampled.select("shard", "print", "parts").groupBy("shard").applyInPandas(grow, "shard long, nodes binary").collect()
    trees = prints.sparkSession.sparkContext.broadcast(
        {r["shard"]: bytes(r["nodes"]) for r in found})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = {s: [tuple(x) for x in np.frombuffer(raw, [("v", "<u8"), ("mu", "<i4"), ("near", "<i4"), ("far", "<i4")]).tolist()]
                for s, raw in trees.value.items()}
        for b in batches:
            shard, keys = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            resident = b.column(2).to_numpy(zero_copy_only=False)
            for s in np.unique(shard):
                rows = np.flatnonzero(shard == s)
                for part, at, here in deal(read.get(int(s), []), keys[rows], resident[rows]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), s * MOST_SHARDS * 2 + part)), pa.array(keys[rows[at]].view(np.int64)), pa.array(here)],
                        ["shard", "print", "resident"])

    return prints.mapInArrow(run, "shard long, print long, resident boolean")


def crowd_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) among prints of the same shard by their centres: the print itself or
    one with a bit flipped. A group is the 65 members of a centre at most."""
    centres = F.concat(F.array("print"), *[F.array(*[F.col("print").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), i)) for i in range(k, k + 16)])
                                           for k in range(0, 64, 16)])
    members = (prints.select("shard", "print").distinct().select("shard", "print", F.explode(centres).alias("centre"))
               .groupBy("shard", "centre").agg(F.array_sort(F.collect_set("print")).alias("m")).where(F.size("m") > 1))
    return members.select(F.col("m")[0].alias("a"), F.explode(F.slice("m", 2, 64)).alias("b")).distinct()


def near_links(kinds: DataFrame, cell: int = CELL, most: int = MOST_SHARDS) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints (column print)."""
    rows = kinds.select(F.lit(0).cast("long").alias("shard"), "print", F.lit(True).alias("resident"))
    counted = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    ready = []
    for _ in range(2):
        counted = save(counted, "simhash-shards")
        over = counted.where(F.col("rows") > CROWDED * cell).select(
            "shard", "rows", F.least(F.lit(most), F.ceil(F.col("rows") / cell)).cast("int").alias("parts"))
        if over.isEmpty():
            break
        # Shards of a fitting size are ready; the others are dealt once more.
        ready.append(rows.join(F.broadcast(over.select("shard")), "shard", "left_anti"))
        rows = save(dealt(rows.join(F.broadcast(over.select("shard")), "shard", "left_semi"), over), "simhash-dealt")
        counted = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    counted = save(counted, "simhash-shards")
    crowds = counted.where(F.col("rows") > CROWDED * cell).select("shard")
    ready.append(rows.join(crowds, "shard", "left_anti"))
    links = crowd_links(rows.join(crowds, "shard", "left_semi"))
    for part in ready:
        links = links.unionByName(part.groupBy("shard").applyInPandas(_shard, "a long, b long"))
    return links


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    prints = pdf["print"].to_numpy()
    a, b = shard_links(prints.view(np.uint64), pdf["resident"].to_numpy().astype(bool))
    return pd.DataFrame({"a": prints[a], "b": prints[b]})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, print, component_id for every row of docs."""
    every = save(fingerprints(docs), "simhash-prints")
    kinds = save(every.groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "simhash-kinds")
    labels = connected_components(save(near_links(kinds), "simhash-links"))
    grouped = kinds.join(labels, kinds["print"] == labels["node"], "left").select(
        "print", "doc_id", "copies", F.coalesce("component", "print").alias("component"))
    ids = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.sum("copies").alias("n_group"))
    # Written first: a join of two exchanges, whose hot keys Spark can split.
    ids = save(grouped.join(save(ids.where("n_group > 1"), "simhash-ids"), "component").select("print", "component_id"), "simhash-members")
    return every.join(ids, "print", "left").select("doc_id", "print", F.coalesce("component_id", "doc_id").alias("component_id"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
