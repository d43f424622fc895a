import itertools
import re

import numpy as np

from loglake.llm import ngram_join as J


def brute(rows):
    """[(n_shingles, component_id)] by comparing all sets."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, set()).add(i)
    near = {p for v in by.values() for p in itertools.combinations(sorted(v), 2)}
    for a, b in near:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * len(sets[a] | sets[b]):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(s), str(least.get(find(i))) if s else str(d)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def collected(df):
    return sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"])) for x in df.collect())


def test_whole_table_against_all_pairs(spark, sf):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert collected(J.op2_ngram_jaccard(spark, sf)) == brute(rows)


def test_edge_cases(make_docs, words):
    base = words(60)
    chain = [base[:], base[:50] + words(10, 5)]  # a chain: neighbours link, the ends need not
    for k in range(1, 9):
        w = base[:]
        w[k * 6] = f"edit{k}"
        chain.append(w)
        chain.append(w[:k * 6 + 3] + ["more"] + w[k * 6 + 3:])
    texts = [(i, " ".join(w)) for i, w in enumerate(chain)]
    texts += [(100, None), (101, ""), (102, " \t\n"), (103, "one two"), (104, "ONE  two"), (105, "one two three four five six"),
              (106, "one two three four five six seven"), (107, " ".join(words(30_000, 9, 10**6))), (107, " ".join(words(30_000, 9, 10**6))),
              (None, texts_of := " ".join(base)), (108, texts_of.upper())]
    assert collected(J.link_components(make_docs(texts)).select("doc_id", "n_shingles", "component_id")) == brute(texts)
    assert J.link_components(make_docs({})).count() == 0


def test_large_near_group_and_common_passage(make_docs, words, monkeypatch):
    monkeypatch.setattr(J, "CELL_ROWS", 16)  # hot cells are dealt out in parts
    base, passage = words(40), words(30, 7)
    texts = []
    for i in range(60):
        w = base[:]
        w[(i * 7) % 40] = f"e{i}"
        texts.append((i, " ".join(w)))
    texts += [(200 + i, " ".join(words(25, 50 + i) + passage)) for i in range(60)]
    assert collected(J.link_components(make_docs(texts)).select("doc_id", "n_shingles", "component_id")) == brute(texts)


def test_bounds_never_drop_a_link():
    r = np.random.default_rng(1)
    for _ in range(200):
        n = int(r.integers(1, 400))
        a = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[r.random(len(a)) > 0.08], r.integers(0, 1 << 62, 3).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        if not J.can_link(len(a), len(b), both):
            continue
        x, y = J.read_counts(J.coarse_counts(a)), J.read_counts(J.coarse_counts(b))
        d = min(len(x), len(y))
        assert np.minimum(J.fold(x, d), J.fold(y, d)).sum() >= both
        hot = r.random(J.SKETCH) < 0.3
        assert np.intersect1d(J.first_groups(a, hot), J.first_groups(b, hot)).size
        tree = J.CountTree(np.array([len(a), len(b)]), [x, y], np.array([1, 2]))
        assert [p[:2] for p in tree.pairs()] == [(0, 1)]


def test_representatives(make_docs, words):
    same = " ".join(words(80))
    near = same.replace(same.split()[40], "changed")
    docs = make_docs([(5, same), (3, near), (3, near), (9, same), (4, "alone"), (7, None), (8, ""), (None, "no id here")])
    kept = J.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (x["doc_id"] for x in kept.collect()))) == ["3", "4", "7", "8", "None"]


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    from loglake.llm import common

    texts = [b" a bc\td\x0be ", b"", b"\n", b"x" * 5000 + b" a", b"bc " * 3000, b"a"]
    whole, counts = common.hash_words(texts)
    assert counts.tolist() == [4, 0, 0, 2, 3000, 1]
    assert whole[0] == whole[5] == whole[-1] and whole[1] == whole[-2] and len(set(whole.tolist())) == 5
    monkeypatch.setattr(common, "BLOCK", 64)
    small, same = common.hash_words(texts)
    assert (small == whole).all() and (same == counts).all()


def test_hashing_keeps_little_in_memory():
    """What hashing makes of texts on the way is small next to some MB of them."""
    import tracemalloc

    from loglake.llm import common

    texts = [b"some words of a text %d " % i * 200 for i in range(1000)]  # 5 MB
    common._POWERS.clear()
    tracemalloc.start()
    try:
        hashes, counts = common.hash_words([*texts, b" ".join(texts)])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        common._POWERS.clear()
    assert (hashes[:counts[:-1].sum()] == hashes[counts[:-1].sum():]).all() and counts[-1] == counts[:-1].sum()
    assert peak < 2 * hashes.nbytes + (8 << 20)
