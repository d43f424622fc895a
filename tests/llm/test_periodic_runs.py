import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from loglake.llm import periodic_runs as P


def brute_runs(w):
    """All runs by their definition: maximal stretches of each period, the smallest period of each."""
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n_, q) for (s, n_), q in found.items())


def brute(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def sequences(r):
    for _ in range(60):
        yield [r.randrange(r.choice((1, 2, 3, 9))) for _ in range(r.randrange(0, 90))]
    for _ in range(40):  # planted powers, neighbouring and nested
        w = []
        for _ in range(r.randrange(1, 5)):
            part = [r.randrange(4) for _ in range(r.randrange(1, 30))]
            w += (part * 9)[:r.randrange(1, 9 * len(part) + 1)]
        yield w
    yield [0] * 3000
    yield ([0, 1] * 9 + [2]) * 30
    a, b = [0], [0, 1]
    while len(b) < 2000:
        a, b = b, b + a
    yield b


def test_runs_against_brute_force():
    texts = list(sequences(random.Random(3)))
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes + 1) - sizes - 1
    ids = np.concatenate([np.array([*t, 100 + i]) for i, t in enumerate(texts)])
    rows = P.find_runs(ids, begins, sizes)
    for i, t in enumerate(texts):
        assert [tuple(x[1:]) for x in rows[rows[:, 0] == i].tolist()] == brute_runs(t), t
    assert len(rows) > 80


@pytest.mark.parametrize("kinds", [1, 2, 40])
def test_extensions_against_comparison(kinds):
    r = np.random.default_rng(kinds)
    ids = r.integers(0, kinds, 700)
    ids[350:650] = ids[:300]
    ids = np.append(ids, kinds)
    words = P.Extensions(ids)
    a, b = r.integers(0, 700, 3000), r.integers(0, 700, 3000)
    a, b = a[a != b], b[a != b]
    got = words.common(a, b)
    for x, y, n in zip(a, b, got):
        assert (ids[x:x + n] == ids[y:y + n]).all() and (max(x, y) + n >= 701 or ids[x + n] != ids[y + n])


def test_no_word_number_is_shared_by_blocks(monkeypatch):
    monkeypatch.setattr(P, "GRID_ROWS", 50)
    t = [[b"a", b"b"] * 20, [], [b"b"] * 9, [b"a", b"b"] * 2, [b"x%d" % i for i in range(200)] * 5]
    sizes, runs, collapsed = P._block(t)
    assert [x.tolist() for x in runs] == [[[0, 40, 2]], [], [[0, 9, 1]], [], [[0, 1000, 200]]]
    assert collapsed[:4] == [b"a b", b"", b"b", b"a b a b"] and sizes.tolist() == [40, 0, 9, 4, 1000]


def test_very_long_text():
    part = [b"w%d" % i for i in range(70_000)]
    sizes, runs, collapsed = P._block([part * 4 + [b"end"]])
    assert runs[0].tolist() == [[0, 280_000, 70_000]] and collapsed[0].split() == [*part, b"end"]


def digest(df):
    return {x["doc_id"]: tuple(x)[1:8] for x in df.collect()}


def run(docs):
    import loglake.llm.periodic_runs as M

    found = {}
    old = M.table
    M.table = lambda *a: docs
    try:
        found = M.op13_periodic_runs(docs.sparkSession, "")
    finally:
        M.table = old
    return found


def test_defined_cases(make_docs, words):
    ten = next(i for i in range(100, 999) if zlib.crc32(str(i).encode()) % 10 == 0)
    plain = next(i for i in range(100, 999) if zlib.crc32(str(i).encode()) % 10)
    texts = {None: "x x x x x x x", 1: None, 2: "", 3: " \n\t ", ten: " ".join(words(400, 1, 9)), plain: " ".join(words(400, 1, 9)),
             5: "é ü é ü " * 9, 6: "la " * 3_000, 7: " ".join(words(4_000, 2, 3)), 8: "a a a a a", 9: "a a a a a a"}
    got = digest(run(make_docs(texts, extra=("g", "a", "p", "words", "runs", "best", "collapsed"))))
    assert got == {i: brute(i, t) for i, t in texts.items()}
    assert run(make_docs({})).count() == 0
    twice = run(make_docs([(6, "a b " * 9), (6, "a b " * 9)])).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_whole_table(spark, sf):
    texts = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = digest(P.op13_periodic_runs(spark, sf))
    assert got == {i: brute(i, t) for i, t in texts.items()}
    assert sum(x[0] > 0 for x in got.values()) > 5
