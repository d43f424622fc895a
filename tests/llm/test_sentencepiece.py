import random

import pytest

import public_tokenizers
from loglake.llm import sentencepiece_dropout as S

PATH = public_tokenizers.path(S.MODEL)


@pytest.fixture(scope="module")
def model():
    return S.load_model(PATH)


def test_without_dropout_equals_the_library(model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    encoder, r = S.Encoder(model, rate=0.0, variants=1), random.Random(4)
    for _ in range(800):
        text = "".join(r.choice("ab \n\té漢😀<s>\x00 the and") for _ in range(r.randrange(90)))
        assert encoder.encode(text) == library.encode(text)


def test_short_and_long_agendas_agree(model):
    r = random.Random(5)
    for _ in range(300):
        word = "".join(r.choice("theandiong") for _ in range(r.randrange(1, 60)))
        symbols = [model["chars"][c] for c in word]
        for bar in (0, 60):
            draws = [r.randrange(256) for _ in range(500)]
            a = S.merge_short(symbols[:], model["merges"].get, model["merged"], iter(draws).__next__, bar)
            if not bar:
                assert a == S.merge_long(symbols[:], model["merges"].get, model["merged"], iter(draws).__next__, bar)
            assert "".join(model["texts"][i] for i in a) == word


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5])
def test_words_in_step_equal_words_one_by_one(model, rate, monkeypatch):
    """The scalar agenda is the definition; words of many lengths, unknown characters, used-up streams."""
    import hashlib

    r = random.Random(8)
    words = ["".join(r.choice("theandiong▁é漢😀\n") for _ in range(r.randrange(1, 70))) for _ in range(2000)] + ["a", "▁", "😀", "x" * 300, "aaaa" * 12]
    digests = [hashlib.blake2b(w.encode()).digest() for w in words]
    want = [S.segment(w, model, d, rate) for w, d in zip(words, digests)]
    assert S.segment_many(words, model, digests, rate) == want
    monkeypatch.setattr(S, "ROWS", 7)
    assert S.segment_many(words, model, [d[:64] for d in digests], rate) == want
    assert S.segment_many([], model, [], rate) == []


def test_memo_is_bounded_by_bytes_and_changes_nothing(model):
    few = S.Encoder(model)
    for m in few.memo:
        m.memo = 5_000
    r = random.Random(1)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 12))) for _ in range(300)) for _ in range(30)]
    whole = S.Encoder(model)
    assert [few.encode(t, i % 3) for i, t in enumerate(texts)] == whole.encode_all(texts, [i % 3 for i in range(30)])
    assert all(m.size <= 5_000 and len(m.new) + len(m.old) < 60 for m in few.memo)
    for m in few.memo:
        m.memo = 70_000
    assert [few.encode(t, i % 3) for i, t in enumerate(texts)] == whole.encode_all(texts, [i % 3 for i in range(30)])
    assert any(m.old for m in few.memo) and all(m.new for m in few.memo)


def test_round_trip_variation_and_edge_cases(spark, make_docs, words):
    text = " ".join(["international communication understanding"] * 20)
    texts = {i: text for i in range(30)} | {100: None, 101: "", 102: " ▁ x▁", 103: "ab" * 40_000, 104: "  two  spaces \n"}
    docs = make_docs(texts)
    encoded = S.encode(docs, PATH)
    rows = {x["doc_id"]: x for x in encoded.collect()}
    assert all(x["lossless"] for x in rows.values())
    assert rows[100]["ids"] is None and rows[101]["ids"] == [] and rows[101]["n_tokens"] == 0
    assert len({tuple(rows[i]["ids"]) for i in range(30)}) > 1  # segmentations vary
    assert rows == {x["doc_id"]: x for x in S.encode(docs, PATH).collect()}  # and repeat for a seed
    assert rows[0]["ids"] != next(iter(S.encode(docs.where("doc_id = 0"), PATH, seed=1).collect()))["ids"]
    assert {x["doc_id"]: x["text"] for x in S.decode(encoded, PATH).collect()} == texts
    assert S.encode(make_docs({}), PATH).count() == 0


def test_words_have_three_segmentations_at_least(model):
    encoder = S.Encoder(model)
    assert len({encoder.variant_of(i) for i in range(100)}) == encoder.variants >= 3
    words = ["internationalisation", "understanding", "communication", "representation"]
    assert any(len({tuple(encoder.encode(w, v)) for v in range(encoder.variants)}) >= 3 for w in words)


def test_packed_ids_of_a_batch_and_their_decoding(spark, model):
    """Ids stay packed from the memo to the column; a batch is decoded at once, and a changed id is noticed."""
    import numpy as np
    import pyarrow as pa

    texts = ["the understanding", None, "", " ▁ x▁", "▁▁", " ", "a\n\n b 😀漢", "ab" * 300, "x" * 60 + "😀"]
    encoder, decoder = S.Encoder(model), S.Decoder(model)
    variants = [i % 3 for i in range(len(texts))]
    ids = S.id_lists(encoder.packed(texts, variants))
    assert all(isinstance(x, bytes) for m in encoder.memo for x in m.new.values())
    assert ids.to_pylist() == S.Encoder(model).encode_all(texts, variants)
    assert [None if x is None else decoder.decode(x) for x in ids.to_pylist()] == texts
    assert decoder.lossless(pa.array(texts), ids).to_pylist() == [True] * len(texts)
    changed = ids.values.to_numpy().copy()
    changed[ids.offsets[3].as_py()] += 1
    other = pa.ListArray.from_arrays(ids.offsets, pa.array(changed, pa.int32()), mask=ids.is_null())
    assert np.flatnonzero(~decoder.lossless(pa.array(texts), other).to_numpy(zero_copy_only=False)).tolist() == [3]
    assert S.id_lists([]).to_pylist() == []
