import numpy as np
import pytest
from pyspark.sql import functions as F

from loglake.llm import substring_dedup as D


def sentences(words, n, seed):
    return " ".join(" ".join(words(9, seed * 1000 + k)).capitalize() + "." for k in range(n))


def test_passages_inside_other_texts(make_docs, words):
    passage = sentences(words, 8, 1)
    near = passage.replace(passage.split()[20], "edited")
    own = [sentences(words, 12, 10 + k) for k in range(8)]
    texts = {1: f"{own[0]} {passage} {own[1]}", 2: f"starts without an end {passage}\n{own[2]}", 3: own[3],
             4: f"{own[4]}\n{passage.lower()}", 5: f"{own[5]} {near} {own[6]}", 6: None, 7: "", 8: "short. one.", 9: own[7]}
    rows = D.repeated_passages(make_docs(texts)).collect()
    assert {x["doc_id"] for x in rows} == {1, 2, 4, 5}
    assert {x["doc_id"] for x in rows if not x["removed"]} == {1}
    cleaned = {x["doc_id"]: x for x in D.remove_repeats(make_docs(texts)).collect()}
    assert set(cleaned) == set(texts)
    for i in (1, 3, 6, 7, 8, 9):
        assert cleaned[i]["text"] == texts[i] and cleaned[i]["n_removed_words"] == 0
    assert cleaned[4]["text"].strip(" .\n") == own[4].strip(".")
    assert own[2] in cleaned[2]["text"] and cleaned[2]["n_removed_words"] >= 60


def test_near_paragraphs_and_hot_groups(make_docs, words, monkeypatch):
    from loglake.llm import ngram_join

    monkeypatch.setattr(ngram_join, "CELL_ROWS", 8)
    long = words(20, 5)  # one changed word at the end leaves 15 of 17 shingles
    texts = {i: " ".join([*long[:-1], f"end{i}"]) + ". " + " ".join(words(20, 300 + i)) for i in range(30)}
    rows = D.repeating(make_docs(texts)).collect()
    assert {x["doc_id"] for x in rows} == set(range(30))
    assert len({x["component"] for x in rows}) == 1
    assert [x["doc_id"] for x in rows if x["first"]] == [0]


def test_copies_repeated_rows_long_and_empty(make_docs, words):
    text = sentences(words, 400, 3)
    rows = D.repeated_passages(make_docs([(2, text), (1, text), (1, text), (5, "w " * 60_000)])).collect()
    assert {(x["doc_id"], x["removed"]) for x in rows} == {(1, False), (2, True)}
    assert D.repeated_passages(make_docs({})).count() == 0
    assert D.remove_repeats(make_docs({})).count() == 0


@pytest.mark.parametrize("length", [1, 3, 5, 9, 20, 30, 45])
def test_recall_by_sentence_length(make_docs, words, length):
    """60-word passages cut out of running text at any word, between other words."""
    import random

    def running(seed, n):
        w = words(n, seed)
        return " ".join(x + "." if (i + 1) % length == 0 else x for i, x in enumerate(w)).split()

    texts, planted, r = {}, set(), random.Random(length)
    for k in range(40):
        start = r.randrange(60)
        passage = running(5000 + k, 180)[start:start + 60]
        for side in range(2):
            i = 2 * k + side
            texts[i] = " ".join([*running(9000 + i, 30 + r.randrange(40)), *passage, *running(20_000 + i, 25 + r.randrange(40))])
            planted.add(i)
    texts |= {1000 + k: " ".join(running(30_000 + k, 200)) for k in range(40)}
    found = {x["doc_id"] for x in D.repeated_passages(make_docs(texts)).collect()}
    assert found <= planted and len(found) >= 0.95 * len(planted)


def test_no_link_is_lost(make_docs, words):
    """A has P and Q side by side, B only Q, C only P: A's passage has the components of both."""
    p, q = (sentences(words, 6, s) for s in (1, 2))
    rows = {x["doc_id"]: set(x["components"]) for x in D.repeated_passages(make_docs({1: f"{p} {q}", 2: q, 3: p})).collect()}
    assert rows[1] & rows[2] and rows[1] & rows[3] and not rows[2] & rows[3]


def test_cuts_are_the_same_in_any_surroundings(words):
    import random

    r = random.Random(3)
    for length in (1, 2, 4, 7, 50):
        body = " ".join(x + "." if r.random() < 1 / length else x for x in words(300, length))
        cuts = []
        for side in range(2):
            before = words(37 + 11 * side, 70 + side)
            p = D.paragraphs([None, " ".join([*before, body, *words(20, 90 + side)]), ""])
            assert set(p["owner"].tolist()) <= {1} and (p["end"] - p["start"] >= D.MIN_PARAGRAPH).all()
            assert (p["end"] - p["start"] <= D.CUT_MOST).all() and (p["start"][1:] >= p["end"][:-1]).all()
            cuts.append({(int(s) - len(before), int(e) - len(before), int(c)) for s, e, c in zip(p["start"], p["end"], p["class"])})
        inside = [{x for x in c if 45 <= x[0] and x[1] <= 250} for c in cuts]
        assert inside[0] == inside[1] and len(inside[0]) > 5


def test_runs_of_one_word():
    p = D.paragraphs(["no " * 500, "yes. " * 500])
    assert (p["end"] - p["start"] <= D.CUT_MOST).all() and (p["end"] - p["start"] >= D.MIN_PARAGRAPH).all()
    covered = sum((p["end"] - p["start"])[p["owner"] == 0])
    assert covered >= 490


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_windows_over_the_table(spark, size):
    """Brute force: 51-word windows that stand in two documents have a word in a passage."""
    import re
    from collections import defaultdict

    texts = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"/root/testdata/{size}/documents.parquet").collect() if x["text"]}
    folded = {i: t.encode().translate(D.FOLD).split() for i, t in texts.items()}
    where = defaultdict(set)
    for i, w in folded.items():
        for k in range(len(w) - 50):
            where[hash(tuple(w[k:k + 51]))].add(i)
    spans = defaultdict(list)
    for x in D.op3_substring_dedup(spark, f"/root/testdata/{size}").collect():
        spans[x["doc_id"]].append((x["start_word"], x["end_word"]))
    total = missed = 0
    for i, w in folded.items():
        marked = bytearray(len(w))
        for s, e in spans[i]:
            marked[s:e] = b"\1" * (e - s)
        for k in range(len(w) - 50):
            if len(where[hash(tuple(w[k:k + 51]))]) > 1:
                total += 1
                missed += not any(marked[k:k + 51])
    assert total > 500 and missed <= total // 1000, (missed, total)


def test_tuning():
    assert D.tune_bands(0.8, 0.99) == 3 and D.tune_bands(0.5, 0.99) == 7


def test_many_shared_bands_let_few_other_paragraphs_through(spark, make_docs, words):
    """Of paragraphs without a shared band a small part is shuffled, with millions of shared bands too."""
    docs = make_docs({i: ". ".join(" ".join(words(12, seed=100 * i + k)) for k in range(20)) for i in range(150)})
    docs = docs.select("doc_id", F.xxhash64("text").alias("row"), F.xxhash64("doc_id", "text").alias("key"), "text")
    bands = spark.range(3_000_000).select(F.xxhash64("id").alias("band"))
    assert D.candidates(docs, bands).count() < 60  # of 3,000 or so
    assert D.candidates(docs, D.shared_bands(docs.unionByName(docs.withColumn("key", F.col("key") + 1)))).count() > 2_500


def test_a_cell_of_two_classes_grows_no_tree(spark):
    """Its only pair has been compared with the smallest class; cells of three give their other pair."""
    from loglake.llm.ngram_join import coarse_counts

    grams = np.arange(1, 41, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    known = spark.createDataFrame([(c, 40, bytearray(coarse_counts(grams)), [7, 9]) for c in (1, 2, 3)], "class long, n long, counts binary, first array<long>")
    cells = spark.createDataFrame([(7, 1), (7, 2), (9, 1), (9, 2), (9, 3)], "cell long, class long")
    labels = spark.createDataFrame([(1, 1)], "node long, component long")
    pairs = {(r["a"], r["b"]) for r in D.tree_pairs(cells.where("cell = 7"), labels, known, 4, least=3).collect()}
    assert pairs == set()
    assert {(r["a"], r["b"]) for r in D.tree_pairs(cells, labels, known, 4, least=3).collect()} == {(1, 2), (1, 3), (2, 3)}
