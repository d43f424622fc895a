"""Token counts with a whole-token shortcut (operator 1).

A vocabulary string that provably encodes alone as one token needs no merging:
the proof runs the merges once, on the driver, over the (fixed-size)
vocabulary. Texts are then cut into pre-tokens; a proven one counts 1 by a
dictionary look-up, only the rest are merged, each distinct one once while the
bounded memo holds it. No shuffle.

Defined cases: null or empty text has 0 tokens; special strings in a text are
one token each, as the tokenizer's default has it; nothing is truncated;
repeated rows are counted row by row.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loglake.llm.common import table

TOKENIZER = "word_bpe_49k.json"
MAX_TOKENS = 2048
MEMO = 400_000
#: Below this code point NFC is the identity and lower-casing is per character.
PLAIN_LIMIT = 0x250
#: Fixed value: the tokenizer's own pre-token pattern, white space spelled out.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0\p{L}\p{N}]+"


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b if b in plain else next(spare)) for b in range(256)}


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Tokens left after applying merges by rank, leftmost first."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda = [(r, i, s, t) for i, (s, t) in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get((s, t))) is not None]
    heapq.heapify(agenda)
    left = n
    while agenda:
        _, i, s, t = heapq.heappop(agenda)
        j = after[i] if symbols[i] == s else n
        if j >= n or symbols[j] != t:
            continue
        symbols[i], symbols[j] = s + t, ""
        after[i] = k = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(agenda, (r, i, symbols[i], symbols[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(agenda, (r, h, symbols[h], symbols[i]))
    return left


def prove_whole_tokens(vocab: list[str], ranks: dict, suffix: str, byte_of: dict[str, int]) -> list[str]:
    """Texts of the vocabulary entries that encode alone as one token."""
    proven = []
    for entry in vocab:
        body = entry.removesuffix(suffix)
        if body and entry != body and all(c in byte_of for c in body) and merge_count([*body[:-1], body[-1] + suffix], ranks) == 1:
            raw = bytes(byte_of[c] for c in body)
            try:
                proven.append(raw.decode())
            except UnicodeDecodeError:
                continue  # part of a character: never a pre-token by itself
    return proven


class PreTokenCounts(dict):
    """Tokens of a pre-token: 1 where proven, else merged and remembered."""

    def __init__(self, proven: list[str], ranks: dict, suffix: str):
        super().__init__(dict.fromkeys(proven, 1))
        self.proven, self.ranks, self.suffix, self.chars = proven, ranks, suffix, byte_chars()

    def __missing__(self, word: str) -> int:
        if len(self) > len(self.proven) + MEMO:
            self.clear()
            self.update(dict.fromkeys(self.proven, 1))
        symbols = [self.chars[b] for b in word.encode()]
        symbols[-1] += self.suffix
        n = self[word] = merge_count(symbols, self.ranks)
        return n


def load_tokenizer(path: str) -> dict:
    """What the counting needs from the file: merges, proof, special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    suffix = model["end_of_word_suffix"]
    ranks = {tuple(m): r for r, m in enumerate(model["merges"])}
    byte_of = {c: b for b, c in byte_chars().items()}
    return {
        "ranks": ranks, "suffix": suffix, "spec": json.dumps(spec),
        "proven": prove_whole_tokens(list(model["vocab"]), ranks, suffix, byte_of),
        "special": [t["content"] for t in spec["added_tokens"]],
    }


def counter(known: dict):
    """A function from a text to its number of tokens."""
    import re

    import regex
    from tokenizers import Tokenizer

    counts = PreTokenCounts(known["proven"], known["ranks"], known["suffix"])
    pre_tokens = regex.compile(PRE_TOKEN).findall
    unusual = re.compile(f"[^\\x00-{chr(PLAIN_LIMIT - 1)}]").search
    special = re.compile("|".join(map(re.escape, sorted(known["special"], key=len, reverse=True))) or r"(?!)")
    library = Tokenizer.from_str(known["spec"])
    byte_of = {c: b for b, c in byte_chars().items()}

    def of_part(part: str) -> int:
        if not unusual(part):
            return sum(map(counts.__getitem__, pre_tokens(part.lower())))
        # Other scripts: the library's normaliser and splitter, then the same counts.
        pieces = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(part))
        return sum(counts[bytes(byte_of[c] for c in p).decode()] for p, _ in pieces if p)

    def of_text(text: str) -> int:
        parts = special.split(text)
        return len(parts) - 1 + sum(of_part(p) for p in parts if p)

    return of_text


def count_tokens(docs: DataFrame, path: str, limit: int = MAX_TOKENS,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_tokenizer(path))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(shared.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
