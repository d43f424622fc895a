import random

import pytest

import public_tokenizers
from loglake.llm import token_counts as T

PATH = public_tokenizers.path(T.TOKENIZER)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(spark, library, make_docs):
    r = random.Random(3)
    letters = "aAbBÀéßİΣσςﬁǅ  \n\t\x85\xa0 ’'sS'lL12²½٣漢字😀<|endoftext|>́_-!.,"
    texts = {i: "".join(r.choice(letters) for _ in range(r.randrange(60))) for i in range(300)}
    texts |= {900: None, 901: "", 902: "ab" * 30_000, 903: "<|endoftext|> x <|startoftext|>", 904: "the " * 2049}
    got = {x["doc_id"]: x for x in T.count_tokens(make_docs(texts), PATH).collect()}
    for i, t in texts.items():
        want = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"]) == (want, len((t or "").encode())), t
        assert got[i]["over_limit"] == (want > 2048)


def test_proof_holds_and_merging_does_the_rest(library):
    known = T.load_tokenizer(PATH)
    assert len(known["proven"]) > 30_000
    for w in random.Random(0).sample(known["proven"], 500):
        symbols = [T.byte_chars()[b] for b in w.encode()]
        symbols[-1] += known["suffix"]
        assert T.merge_count(symbols, known["ranks"]) == 1


def test_whole_table_and_empty_table(spark, sf, library, make_docs):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {x["doc_id"]: x["n_tokens"] for x in T.op1_token_counts(spark, sf).collect()}
    want = {x["doc_id"]: len(e.ids) for x, e in zip(rows, library.encode_batch([x["text"] or "" for x in rows], add_special_tokens=False))}
    assert got == want
    assert T.count_tokens(make_docs({}), PATH).count() == 0
    assert T.count_tokens(make_docs([(1, "a b"), (1, "a b")]), PATH).count() == 2
