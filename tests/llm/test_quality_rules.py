from collections import Counter

from loglake.llm import quality_rules as Q


def slow_repeats(words):
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    return len(hit)


def test_repeated_words_against_counting(words):
    for seed in range(40):
        w = [x.encode() for x in words(50 + seed, seed, 4 + seed)]
        assert Q.repeated_words(w) == slow_repeats(w)


def test_edge_cases(spark, make_docs, words):
    good = " ".join(words(300))
    texts = {1: None, 2: "", 3: good, 4: "a b c " * 100, 5: good.upper(), 6: " ".join(f"{w}###" for w in good.split()),
             7: "x" * 200_000, 8: "é é " * 60, 9: "same line here\n" * 50, 10: good + "\n\n \nlast"}
    docs = make_docs(texts)
    got = {x["doc_id"]: x for x in Q.apply_policy(Q.ledger(docs)).collect()}
    assert {i for i, x in got.items() if x["kept"]} == {3, 10}
    assert got[1]["n_words"] == 0 and got[2]["base_failed"]
    assert (got[8]["n_words"], got[8]["word_chars"]) == (60, 180)  # only ASCII white space parts words
    assert got[9]["n_dup_lines"] == 49 and got[6]["n_symbols"] == 900
    kept = Q.filter_documents(docs)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == {3, 10}
    assert Q.filter_documents(make_docs({})).count() == 0
    assert Q.filter_documents(make_docs([(3, good), (3, good)])).count() == 2


def test_ablations_count_each_rule(make_docs, words):
    entries = Q.ledger(make_docs({1: "few", 2: " ".join(words(300)).upper(), 3: "A B C " * 100, 4: " ".join(words(300))}))
    got = {(x["policy"], x["rule"]): x for x in Q.ablations(entries).collect()}
    assert got["keep-1", "few_words"]["n_only_this"] == 1 and got["keep-1", "few_words"]["n_rejected"] == 3
    assert got["keep-1", "many_capitals"]["n_failed"] == 2 and got["keep-1", "many_capitals"]["n_only_this"] == 1
    assert got["base-1", "repeated_words"]["n_rejected"] == 2


def test_labels_agree(spark, sf):
    kept = Q.apply_policy(Q.ledger(spark.read.parquet(f"{sf}/documents.parquet")))
    both = kept.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed")
    assert both.where("kept <> (quality = 1)").count() == 0
