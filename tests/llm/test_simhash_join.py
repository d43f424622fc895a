import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglake.llm import simhash_join as S


def brute_print(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    n = min(3, len(w))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + n]).encode(), 42) for i in range(len(w) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    """Component label (smallest position) of each print, by all pairs."""
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    arr = np.array(prints, np.uint64)
    for i in range(len(arr)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1:] ^ arr[i]) <= 2):
            a, b = find(i), find(i + 1 + int(j))
            label[max(a, b)] = min(a, b)
    return [find(x) for x in range(len(prints))]


def crowded(r, n, crowd):
    """Random prints, chains of small steps, and a crowd around one centre."""
    out = {0, (1 << 64) - 1}
    while len(out) < n:
        x = r.getrandbits(64)
        for _ in range(r.choice((1, 1, 2, 5))):
            out.add(x)
            for _ in range(r.randrange(1, 5)):
                x ^= 1 << r.randrange(64)
    centre = r.getrandbits(64)
    while len(out) < n + crowd:
        out.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 7))))
    return sorted(out)


def labels_of(prints, links):
    at = {p: i for i, p in enumerate(prints)}
    label = np.arange(len(prints))
    if links:
        a, b = zip(*links)
        label = S.joined(label, np.array([at[x] for x in a]), np.array([at[x] for x in b]))
    return label.tolist()


@pytest.mark.parametrize("leaf,crowd,compare", [(256, 0, 1 << 20), (8, 300, 1 << 20), (4, 800, 1), (256, 3000, 1000)])
def test_shard_links(leaf, crowd, compare, monkeypatch):
    monkeypatch.setattr(S, "LEAF", leaf)
    monkeypatch.setattr(S, "COMPARE", compare)
    prints = crowded(random.Random(leaf), 1500, crowd)
    arr = np.array(prints, np.uint64)
    a, b = S.shard_links(arr, np.ones(len(arr), bool))
    assert (S.distance(arr[a], arr[b]) >= 0).all() and len(a) < len(arr)
    assert labels_of(prints, list(zip(arr[a].tolist(), arr[b].tolist()))) == brute_components(prints)


def test_every_linked_pair_meets_in_a_shard():
    r = random.Random(5)
    prints = np.array(crowded(r, 4000, 500), np.uint64)
    nodes = S.build_tree(prints[::20], 16)
    assert len(nodes) > 8
    met, homes = set(), []
    for shard, rows, here in S.deal(nodes, prints, np.ones(len(prints), bool)):
        home = rows[here]
        homes += home.tolist()
        a, b = np.nonzero(S.distance(prints[home][:, None], prints[rows][None, :]) <= 2)
        met |= {(min(x, y), max(x, y)) for x, y in zip(home[a].tolist(), rows[b].tolist()) if x != y}
    assert sorted(homes) == list(range(len(prints)))
    want = {(i, i + 1 + int(j)) for i in range(len(prints)) for j in np.flatnonzero(S.distance(prints[i + 1:], prints[i]) <= 2)}
    assert met == want and len(want) > 500


@pytest.mark.parametrize("cell,most,crowd", [(100_000, 1024, 0), (300, 1024, 100), (100, 4, 100), (50, 3, 1500)])
def test_near_links(spark, cell, most, crowd):
    prints = crowded(random.Random(cell), 2500, crowd)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    links = S.near_links(spark.createDataFrame([(x,) for x in signed], "print long").repartition(4), cell, most).collect()
    pairs = [(x["a"] % (1 << 64), x["b"] % (1 << 64)) for x in links]
    assert labels_of(prints, pairs) == brute_components(prints)
    assert len(pairs) < 65 * len(prints)


def expected(rows):
    prints = [brute_print(t) for _, t in rows]
    label = brute_components(prints)
    ids = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            ids[c] = min(ids.get(c, i), i)
    return sorted(((i, f"{p:016x}", ids.get(c)) for (i, _), p, c in zip(rows, prints, label)), key=str)


def found(df):
    return sorted((tuple(x) for x in df.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")), "component_id").collect()), key=str)


def test_defined_cases(make_docs, words):
    base = words(300, 1)
    near = [*base[:150], "changed", *base[151:]]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one\ttwo"), (6, " ".join(base)), (7, " ".join(near)), (8, " ".join(base).upper()),
            (None, " ".join(base)), (None, "alone here with nobody"), (9, "É é"), (10, "x " * 200_000), (11, "x x x"), (12, "x x")]
    rows += [(100 + i, " ".join(words(40, 100 + i))) for i in range(30)] + [(4, "One two")]
    got = found(S.near_duplicates(make_docs(rows, extra=("print", "shard", "resident", "component", "node", "copies"))))
    assert got == expected(rows)
    assert S.near_duplicates(make_docs({})).count() == 0


def test_whole_table(spark, sf):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(x) for x in S.op12_simhash(spark, sf).collect()), key=str)
    assert got == expected(rows)
    assert any(c != i for i, _, c in got)
