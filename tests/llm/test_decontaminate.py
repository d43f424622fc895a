import hashlib
import re

import pytest

from loglake.llm import decontaminate as D


def brute(text, items):
    w = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    doc, hit, found = w(text), set(), set()
    for item, t in items:
        x = w(t)
        if not x:
            continue
        n = min(13, len(x))
        windows = {tuple(x[i:i + n]) for i in range(len(x) - n + 1)}
        for i in range(len(doc) - n + 1):
            if tuple(doc[i:i + n]) in windows:
                hit |= set(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    return len(doc), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(doc)


def digest(df):
    return {x["doc_id"]: tuple(x)[1:] for x in df.collect()}


@pytest.fixture
def bench(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 40])
def test_against_brute_force(spark, make_docs, bench, words, block_words, monkeypatch):
    monkeypatch.setattr(D, "PIECE_WORDS", 60)
    a, b, c = words(30, 1, 40), words(150, 2, 30), words(25, 3, 9)
    items = [(1, " ".join(a)), (2, " ".join(b)), (11, " ".join(c)), (4, "wbx, WCX"), (5, None), (6, "!!"), (2, " ".join(b)), (None, " ".join(words(20, 8)))]
    texts = {1: " ".join(words(50, 4) + a[3:19] + words(50, 5)), 2: ". ".join(b[90:120]).upper(), 3: None, 4: "", 5: " ".join(words(400, 6, 9)),
             6: " ".join(a + c + b), 7: "wcx wbx wcx é", 8: " ".join(words(20, 8)), 9: " ".join(words(300, 10) + a[:13]), 10: " ".join(words(20_000, 11, 45))}
    found = D.judge(D.find_contamination(make_docs(texts), bench(items), block_words=block_words))
    from pyspark.sql import functions as F

    got = digest(found.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256), "contaminated"))
    for i, t in texts.items():
        assert got[i] == brute(t, items), i


def test_whole_table(spark, sf):
    items = [tuple(x) for x in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    texts = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = digest(D.op8_decontaminate(spark, sf))
    assert got == {i: brute(t, items) for i, t in texts.items()}
    assert any(x[-1] for x in got.values())


def test_clean_documents(make_docs, bench, words):
    item, own = words(20, 1), words(500, 2)
    docs = make_docs({1: " ".join(own), 2: " ".join(own[:300] + item[:13] + own[300:]), 3: " ".join(item), 4: None, 5: ""})
    got = {x["doc_id"]: x for x in D.clean_documents(docs, bench([(1, " ".join(item))])).collect()}
    assert set(got) == {1, 2, 4, 5}
    assert got[1]["text"] == " ".join(own) and got[2]["text"].split() == own and got[2]["n_chars"] == len(got[2]["text"])
    assert D.clean_documents(docs, bench([])).columns == docs.columns
    assert D.clean_documents(docs, bench([])).count() == 5
    assert D.clean_documents(make_docs({}), bench([(1, "x")])).count() == 0
