import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from loglake.llm import lexical_search as L


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n, total = len(counted), sum(x for _, _, x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for item, t in items:
        asked.setdefault(item, set()).update(terms(t))
    out = []
    for item, ts in asked.items():
        scores = []
        for i, c, size in counted:
            m = 10 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(x) for x in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def ranked(docs, items, k=10):
    n, total = L.corpus_size(docs)
    return L.search(L.save(L.build_index(docs, n, total), "t"), items, n, k)


def test_quadtree_holds_every_posting():
    r = np.random.default_rng(1)
    for n_rows, n_columns, size in ((1, 1, 1), (1, 9, 5), (40, 3, 60), (300, 50, 2000), (5, 700, 900)):
        cell = np.unique(r.integers(0, n_rows * n_columns, size))
        row, column = np.divmod(cell, n_columns)
        f = r.integers(1, 1000, len(cell))
        levels = L.depth(n_rows, n_columns)
        t = L.build_treap(row, column, f, levels)
        assert sorted(zip(t["leaf_rows"].tolist(), t["leaf_columns"].tolist())) == sorted(zip(row.tolist(), column.tolist()))
        treap = L.Treap(n_columns, np.arange(n_columns).tobytes(), np.arange(n_rows, dtype=np.uint64).tobytes(),
                        np.arange(n_rows, dtype=np.uint32).tobytes(), np.ones(n_rows, np.uint32).tobytes(), *(x.tobytes() for x in t.values()))
        for a, b, x in zip(row.tolist(), column.tolist(), f.tolist()):
            at = np.zeros(1, np.int64)
            for below in range(levels - 1, -1, -1):
                assert treap.tops[at[0]] >= x
                if treap.leaf[at[0]] >= 0:
                    break
                exists, at = treap.quarter(at, np.array([(a >> below & 1) * 2 + (b >> below & 1)]))
                assert exists[0]
            assert treap.tops[at[0]] == x and treap.leaf_columns[treap.leaf[at[0]]] == b


@pytest.mark.parametrize("shard,wide,items,block", [(8192, 64, 128, 200_000), (40, 2, 3, 60), (7, 1, 1, 20)])
def test_against_brute_force(spark, make_docs, monkeypatch, shard, wide, items, block):
    monkeypatch.setattr(L, "SHARD_TERMS", shard * 4)
    monkeypatch.setattr(L, "SHARD_DOCS", shard)
    monkeypatch.setattr(L, "WIDE", wide)
    monkeypatch.setattr(L, "ITEMS", items)
    monkeypatch.setattr(L, "BLOCK_TERMS", block)
    r = random.Random(shard)
    # A skewed vocabulary: few frequent words, many rare ones; groups of copies and equal scores.
    word = lambda: f"w{int(r.random() ** 3 * 300)}"
    docs = [(i, " ".join(word() for _ in range(r.choice((3, 8, 30, 200))))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(7, docs[7][1])]
    asked = [(i, " ".join(word() for _ in range(r.choice((1, 4, 25))))) for i in range(12)] + [(50, docs[7][1])]
    got = rows(ranked(make_docs(docs), spark.createDataFrame([(str(i), t) for i, t in asked], "item_id string, text string")))
    assert got == brute(docs, [(str(i), t) for i, t in asked])


def test_defined_cases(spark, make_docs):
    docs = [(1, None), (2, ""), (3, " .,!\n"), (4, "Ábc ABC x-ray 42"), (None, "abc"), (None, "abc"), (5, "abc"), (6, "x " * 100_000 + "abc"),
            (7, "it's snake_case"), (9, "abc"), (8, "abc")]
    docs += [(100 + i, f"filler{i} other") for i in range(40)]
    asked = [("a", "ABC"), ("b", None), ("c", "..."), ("d", "nowhere"), ("e", "ábc Ábc X"), ("f", "S"), ("g", "snake"), ("a", "abc ray"), (None, "case")]
    items = lambda x: spark.createDataFrame(x, "item_id string, text string")
    frame = make_docs(docs, extra=("item_id", "rank", "score", "terms", "n_docs", "cells"))
    assert rows(ranked(frame, items(asked))) == brute(docs, asked)
    assert rows(ranked(frame, items(asked), 2)) == brute(docs, asked, 2)
    assert rows(ranked(frame, items([]))) == []
    assert rows(ranked(make_docs({}), items(asked))) == []
    assert rows(ranked(make_docs({1: None, 2: ""}), items(asked))) == []


def test_whole_table(spark, sf):
    read = lambda t, c: [tuple(x) for x in spark.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect()]
    assert rows(L.op11_lexical_search(spark, sf)) == brute(read("documents", "doc_id"), read("benchmark", "item_id"))
