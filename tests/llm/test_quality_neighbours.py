import numpy as np

from loglake.llm import quality_neighbours as K


def auc(scores, labels):
    good, bad = scores[labels == 1], scores[labels == 0]
    return np.mean([(good > b).mean() + (good == b).mean() / 2 for b in bad])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = K.op10_quality_neighbours(spark, sf)
    rows = got.where("held_out").join(labels, "doc_id").select("score", "quality", "predicted").toPandas()
    assert auc(rows.score.to_numpy(), rows.quality.to_numpy()) > 0.95
    assert (rows.predicted == rows.quality).mean() > 0.9
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_labels_of_the_held_out_fold_change_nothing(spark, make_docs, words):
    import zlib

    from pyspark.sql import functions as F

    texts = {i: " ".join(words(60, i)) if i % 3 else " ".join(words(60, i)).upper() for i in range(90)}
    docs = make_docs(texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in texts], "doc_id long, quality int, toxic int")
    flipped = labels.withColumn("quality", F.when(K.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({x["doc_id"]: x for x in K.score(docs, t).collect()} for t in (labels, flipped))
    assert a == b
    for i, x in a.items():
        assert x["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and x["predicted"] == int(x["score"] >= 0.3)


def test_votes_equal_brute_force():
    r = np.random.default_rng(0)
    points, known = K.unit_rows(r.normal(size=(40, 8))), K.unit_rows(r.normal(size=(300, 8)))
    labels = r.integers(0, 2, 300).astype(float)
    got = K.vote(points, known, labels, 7)
    for p, s in zip(points, got):
        cosine = known @ p
        near = np.argsort(-cosine, kind="stable")[:7]
        w = np.maximum(cosine[near], 1e-3) ** K.SHARPNESS
        assert abs((w * labels[near]).sum() / w.sum() - s) < 1e-9


def test_edge_cases(spark, make_docs, words):
    texts = {1: None, 2: "", 3: " \n", 4: "x" * 100_000, 5: " ".join(words(50)), 6: "a"}
    docs = make_docs(texts)
    schema = "doc_id long, quality int, toxic int"
    none = {x["doc_id"]: x["score"] for x in K.score(docs, spark.createDataFrame([], schema)).collect()}
    assert set(none.values()) == {0.5} and set(none) == set(texts)
    labels = spark.createDataFrame([(4, 0, 0), (5, 1, 0), (5, 1, 0), (6, 0, 0), (6, 1, 0), (None, 1, 0), (99, 1, 0), (2, None, 0)], schema)
    got = {x["doc_id"]: x["score"] for x in K.score(docs, labels).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[1] == got[2] == got[3]
    assert K.score(make_docs({}), labels).count() == 0
    assert K.score(make_docs([(5, "a b"), (5, "a b"), (None, "a b")]), labels).count() == 3


def test_ties_go_to_the_earlier_position():
    """Many equal known vectors: the neighbours are those of a stable sort by cosine, then position."""
    r = np.random.default_rng(1)
    for _ in range(200):
        kinds = K.unit_rows(r.normal(size=(6, 8)).astype(np.float32))
        known = kinds[r.integers(0, 6, 60)]
        labels = r.integers(0, 2, 60).astype(np.float32)
        points = K.unit_rows(r.normal(size=(5, 8)).astype(np.float32))
        k = int(r.integers(1, 61))
        cosine = points @ known.T
        near = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
        weights = np.maximum(np.take_along_axis(cosine, near, 1), 1e-3) ** K.SHARPNESS
        assert np.allclose(K.vote(points, known, labels, k), (weights * labels[near]).sum(1) / weights.sum(1), rtol=1e-5)
