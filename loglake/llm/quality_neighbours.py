"""Quality scores by nearest-neighbour voting in a latent space (operator 10).

Labelled documents are described by term counts (hashed character 4-grams,
pairs of character classes, and word repetition), reduced by a truncated SVD
(latent semantic analysis) fitted on a bounded sample of labelled rows. The
labelled vectors, at most SAMPLE x DIMENSIONS floats, are broadcast; every
document is projected, its cosine with all of them is computed exactly, block
by block, and the labels of its NEIGHBOURS nearest are weighted by similarity.

Parameters: SAMPLE bounds the labelled rows that are learnt from (the ones with
the smallest keyed hashes); rows whose crc32(doc_id) mod 5 is 0 are never learnt from.
labels, lang, source and doc_id are no input of a score.

Defined cases: null and empty texts are described by no term and get the share of
label 1 in the sample; without any labelled row the score is 0.5; a document
labelled twice with different labels is left out; ties among neighbours go to the earlier one
of the sample's fixed order; repeated documents are scored row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.common import table

SAMPLE = 4000
GRAMS = 1024
CLASSES = 12
DIMENSIONS = 48
NEIGHBOURS = 25
SHARPNESS = 8
THRESHOLD = 0.3
BLOCK = 512
FOLDS = 5


def class_table() -> np.ndarray:
    """A class for every byte: letters by case, digit, space, line end, marks."""
    t = np.full(256, 11, np.uint8)
    groups = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".?", b"!",
              b",;:'\"-", b"#*$%&", b"|<>=@_/\\", b"()[]{}")
    for k, chars in enumerate(groups):
        t[np.frombuffer(chars, np.uint8)] = k
    return t


def n_terms() -> int:
    return GRAMS + CLASSES * CLASSES + 4


def describe(text: str | None, classes: np.ndarray) -> np.ndarray:
    """Damped term counts of one text, scaled so that its length cancels out."""
    out = np.zeros(n_terms(), np.float32)
    raw = (text or "").encode()
    if not raw.strip():
        return out
    b = np.frombuffer(raw, np.uint8)
    n = len(b)
    if n >= 4:
        x = b.astype(np.uint32)
        grams = ((x[:-3] * 0x01000193 ^ x[1:-2]) * 0x01000193 ^ x[2:-1]) * 0x01000193 ^ x[3:]
        out[:GRAMS] = np.bincount((grams ^ grams >> 15) % GRAMS, minlength=GRAMS)
    c = classes[b]
    if n >= 2:
        pairs = np.bincount(c[:-1].astype(np.int64) * CLASSES + c[1:], minlength=CLASSES * CLASSES)
        out[GRAMS:GRAMS + CLASSES * CLASSES] = pairs
    out /= n
    np.sqrt(out, out=out)
    words = raw.split()
    distinct = len(set(words))
    again = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[-4:] = (1 - distinct / len(words), again / len(words), 1 - len(set(lines)) / len(lines), min(1.0, 50 / len(words)))
    return out


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def fit_space(terms: np.ndarray, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading right singular vectors of the sample's term matrix."""
    mean = terms.mean(axis=0)
    centred = (terms - mean).astype(np.float64)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    return mean, np.ascontiguousarray(vectors[:, ::-1][:, :dimensions]).astype(np.float32)


def is_held_out(doc_id) -> object:
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> list:
    """(terms, label) of at most ``sample`` labelled rows outside the held-out fold."""
    known = (labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~is_held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("label")).where("lo = label"))
    # A top-n by a hash of the id: every task keeps at most `sample` rows.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").cast("long").alias("doc_id"), "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = class_table()
        for b in batches:
            rows = [describe(t, classes).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], ["doc_id", "label", "terms"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    described = texts.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, terms binary")
    # A doc_id may come with several texts: keep one, so that the bound holds.
    return described.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("terms").alias("terms")).orderBy("doc_id").collect()


def vote(points: np.ndarray, known: np.ndarray, labels: np.ndarray, neighbours: int) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest of ``known``."""
    cosine = points @ known.T
    k = min(neighbours, len(labels))
    # Those above the k-th cosine, and of those equal to it the first ones by position.
    kth = -np.partition(-cosine, k - 1, axis=1)[:, k - 1:k]
    above, equal = cosine > kth, cosine == kth
    near = above | equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= k - above.sum(axis=1, keepdims=True))
    near = np.nonzero(near)[1].reshape(len(points), k)
    weights = np.maximum(np.take_along_axis(cosine, near, 1), 1e-3) ** SHARPNESS
    return (weights * labels[near]).sum(1) / weights.sum(1)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, neighbours: int = NEIGHBOURS,
          threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    rows = labelled_sample(docs, labels, sample)
    prior = float(np.mean([r["label"] for r in rows])) if rows else 0.5
    model = None
    if rows:
        terms = np.stack([np.frombuffer(r["terms"], np.float32) for r in rows])
        mean, space = fit_space(terms)
        model = (mean, space, unit_rows((terms - mean) @ space), np.array([r["label"] for r in rows], np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most sample x dimensions floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, model = class_table(), shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                b = whole.slice(start, BLOCK)
                terms = np.stack([describe(t, classes) for t in b.column(1).to_pylist()])
                scores = np.full(len(terms), prior)
                filled = terms.any(axis=1)
                if model is not None and filled.any():
                    mean, space, known, known_labels = model
                    scores[filled] = vote(unit_rows((terms[filled] - mean) @ space), known, known_labels, neighbours)
                scores = np.clip(scores, 0.0, 1.0)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())],
                    ["doc_id", "score", "predicted"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op10_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
