"""Helpers shared by the training-data operators: tables, saved steps, words.

Every operator reads only the columns it names (``doc_id``, ``text``, ...), so
extra columns of an input, clashing names included, never reach it.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, name: str, **options) -> DataFrame:
    """Write a step to the shared checkpoint folder and read it back.

    Cuts the lineage with files that outlive any executor. ``options``: of the writer.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The function for mapInArrow, which gives free memory back when its task ends.

    Python workers are used again by later stages; what their allocators keep would count there.
    """

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # of the GNU C library only
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, longer where a column of df has them (in any letter case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (wraps around by design)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Small parts of Arrow batches, so that what is made from their texts stays small."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)


def slices_of_bytes(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch of about ``size`` bytes of text in a column; a longer text is a part by itself."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(lengths) - 1) // size
    starts = np.flatnonzero(np.diff(part, prepend=-2)) if len(part) else np.empty(0, np.int64)
    for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
        yield batch.slice(start, stop - start)


#: ASCII white space, which parts words.
SPACES = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text hashed at once: the arrays made of them, 8 bytes each, stay in a core's cache.
BLOCK = 1 << 17
_SPACE = re.compile(rb"[ \t-\r]")
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n; those of a block are kept."""
    size = max(n, BLOCK)
    if size not in _POWERS:
        bases = (BASE, pow(BASE, -1, 1 << 64))
        both = tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, np.uint64(x))))) for x in bases)
        if size > BLOCK:
            return both
        _POWERS[size] = both
    return _POWERS[size]


def _hash_block(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of a text, all at once: polynomials from prefix sums."""
    a = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], SPACES[a], [True]))))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[:len(a)], out=sums[1:])
    return starts, mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the number of words of each text.

    Texts are hashed a block at a time; one longer than a block is cut between words.
    """
    hashes, counts = [np.empty(0, np.uint64)], np.zeros(len(texts), np.int64)
    block: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if block:
            starts, found = _hash_block(b" ".join(p for _, p in block))
            bounds = np.searchsorted(starts, np.cumsum([0, *(len(p) + 1 for _, p in block)]))
            for (i, _), n in zip(block, np.diff(bounds)):
                counts[i] += n
            hashes.append(found)
            block.clear()
            size = 0

    for i, text in enumerate(texts):
        start = 0
        while start < len(text):
            stop = len(text)
            if stop - start > BLOCK:
                space = _SPACE.search(text, start + BLOCK // 2)
                stop = space.end() if space else stop
            if size + stop - start > BLOCK:
                flush()
            block.append((i, text[start:stop]))
            size += stop - start
            start = stop
    flush()
    return np.concatenate(hashes), counts


def gram_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from every position on."""
    n = len(word_hashes) - width + 1
    h = np.full(n, np.uint64(width), np.uint64)
    for i in range(width):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += word_hashes[i:n + i]
        h ^= h >> np.uint64(29)
    return mix64(h)


def shingle_hashes(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Hashes of the ``width``-word shingles of each text, repeats included.

    A text of fewer words is one shingle. All texts are hashed in one
    go, since calls cost more than the work on a short one.
    """
    words, counts = hash_words(texts)
    grams = gram_hashes(words, width) if len(words) >= width else np.empty(0, np.uint64)
    out, start = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(grams[start:start + n - width + 1])
        else:
            out.append(gram_hashes(words[start:start + n], n) if n else np.empty(0, np.uint64))
        start += n
    return out


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


#: Bits of the row filters: fixed, so that a filter of any table can be broadcast.
FILTER_BITS = 1 << 25
FILTER_SLICE = 1 << 16


def filter_place(columns: list[str]) -> Column:
    """Where a key is flagged in a filter."""
    return F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))


def filter_bits(places: DataFrame, size: int = FILTER_BITS) -> bytes:
    """A filter with the flags at ``at`` (0 to size - 1) set; merged by slices of flags."""
    width = FILTER_SLICE * max(1, size // FILTER_BITS)

    def run(pdf):
        import pandas as pd

        flags = np.zeros(width, bool)
        flags[pdf["at"].to_numpy() % width] = True
        return pd.DataFrame({"slice": [int(pdf["at"].iloc[0]) // width], "bits": [np.packbits(flags).tobytes()]})

    slices = places.select("at").distinct().groupBy(F.floor(F.col("at") / width)).applyInPandas(run, "slice long, bits binary")
    bits = bytearray(size // 8)
    for r in slices.collect():  # so many bits in all
        bits[r["slice"] * width // 8:(r["slice"] + 1) * width // 8] = r["bits"]
    return bytes(bits)


def in_filter(bits: bytes, at: np.ndarray) -> np.ndarray:
    """Whether each place is flagged."""
    return np.frombuffer(bits, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1


def flag_rows(df: DataFrame, keys: DataFrame, columns: list[str], name: str) -> DataFrame:
    """df with a boolean ``name``: false only where the row's key is not in keys.

    Lets rows that certainly need no join pass by it, so that their texts are not shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(filter_bits(keys.select(filter_place(columns).alias("at"))))

    @F.pandas_udf("boolean")
    def flag(at):
        import pandas as pd

        return pd.Series(in_filter(shared.value, at.to_numpy()))

    return df.withColumn(name, flag(filter_place(columns)))
