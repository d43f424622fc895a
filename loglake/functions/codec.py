"""Payload codecs. Spark SQL has no gzip function, so these two are the only
Python steps of the ingest path; both are Arrow UDFs over batches.

An Arrow batch has up to 10,000 records, however long they are. Results go back in
parts of about a MB, so a Python worker holds one batch of input and one part of output.
"""

from __future__ import annotations

import base64
import gzip
import json
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Results of this size are handed back, whatever is left of the batch.
PART_BYTES = 1 << 20


def _parts(batches: Iterator[pa.Array], one: Callable, size: int = PART_BYTES) -> Iterator[list]:
    """``one`` of every value in order, in lists of about ``size`` bytes of results; a longer
    result ends its list."""
    for batch in batches:
        part, held = [], 0
        for value in batch:
            part.append(one(value.as_py()))
            held += len(part[-1] or "")
            if held >= size:
                yield part
                part, held = [], 0
        if part:
            yield part


def _gunzip_one(b):
    if b is None:
        return None
    try:
        # Concatenated members are read in full and zero padding behind the
        # last is skipped, as the gzip container allows.
        return gzip.decompress(b).decode("utf-8")
    except (zlib.error, OSError, UnicodeDecodeError, EOFError):
        return None


def _is_object(text):
    """Whether the text is one strict JSON object and nothing else."""
    if text is None:
        return None
    try:
        return isinstance(json.loads(text), dict)
    except (ValueError, RecursionError):
        return False


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("is_object", T.BooleanType())]))
def gunzip_json(blobs: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """gzip bytes -> UTF-8 text (null when not gzip or not UTF-8), and whether
    it is exactly one JSON object. Spark's parser reads the first value of a text and
    takes more than JSON, so strictness is tested here."""
    for text in _parts(blobs, _gunzip_one):
        yield pa.StructArray.from_arrays([pa.array(text, pa.string()), pa.array(map(_is_object, text), pa.bool_())], ["text", "is_object"])


def _gzip_b64_one(s, padding=b""):
    if s is None:
        return None
    return base64.b64encode(gzip.compress(s.encode("utf-8"), mtime=0) + padding).decode("ascii")


@F.arrow_udf(T.StringType())
def gzip_base64(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """UTF-8 text -> base64(gzip(text)) without line breaks (the delivery
    record encoding). Spark's own base64() wraps lines, so it is not used."""
    for part in _parts(texts, _gzip_b64_one):
        yield pa.array(part, pa.string())


@F.arrow_udf(T.StringType())
def gzip_base64_padded(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The same with zero bytes behind the gzip data, as some writers leave."""
    for part in _parts(texts, lambda s: _gzip_b64_one(s, bytes(8))):
        yield pa.array(part, pa.string())
