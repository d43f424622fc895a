"""SentencePiece encoding with seeded merge-dropout, and decoding (operator 6).

Merge-type (BPE) segmentation from the pieces and scores of a published model.
Candidate merges wait in an agenda, best score first, leftmost first. Each one
taken is skipped for good if its byte of a hash stream keyed by (seed, variant,
word) falls under the dropout rate (in steps of 1/256), so a text has many
segmentations, each reproducible from its seed, and every one decodes to the very same text.

No piece holds white space behind a visible character, so merges never cross
words: a word of a variant has one segmentation, and those of the last texts are
remembered in a memo of bounded bytes. The words of some texts that are new are segmented
together, step by step. A document takes one of ``variants`` variants by a keyed hash of
its id, which keeps the memo effective. No shuffle.

Defined cases: null text has null ids, an empty text none; characters outside
the vocabulary and the piece marker U+2581 itself become byte pieces, so nothing is lost;
control pieces written out in a text are ordinary characters; repeated rows
get equal ids.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from loglake.llm.common import slices_of_bytes, table, tidy

MODEL = "piece_bpe_32k.model"
SEED = 20_240
DROPOUT = 0.1
VARIANTS = 3
#: Bytes that remembered words may take, about, in each of two generations, and those of an entry besides its content.
MEMO = 48 << 20
ENTRY = 200
#: Bytes of text, and rows of words, that are taken at a time.
TEXT = 1 << 20
ROWS = 4_096
MARK = "▁"
NONE = 1 << 29
SHIFT = 15  # keys of pairs stay small integers for up to 2**15 pieces
OUTSIDE = -(1 << 30)  # no symbol: outside of a word
SHORT = 48  # characters up to which a scanned list beats a heap


def load_model(path: str) -> dict:
    """Pieces, byte pieces and the merges (pair of ids -> rank and id) of a BPE model."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, byte_ids, texts, ranks = {}, [0] * 256, [], {}
    for i in range(m.get_piece_size()):
        piece = m.id_to_piece(i)
        texts.append(piece)
        if m.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
        elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
            if MARK in piece.lstrip(MARK) or "\n" in piece:
                raise ValueError("merges of this model may cross words")
            ids[piece], ranks[piece] = i, int(-m.get_score(i))
    if len(texts) > 1 << SHIFT:
        raise ValueError("the model has too many pieces for the keys of pairs")
    if any(c not in ids for p in ids for c in p):
        raise ValueError("a piece of this model has a character that is no piece")
    # Ranks from 0, best first; a pair's key holds two ids.
    order = sorted(ids, key=ranks.__getitem__)
    rank_of = {p: r for r, p in enumerate(order)}
    merges = {ids[p[:k]] << SHIFT | ids[p[k:]]: rank_of[p]
              for p in ids for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
    chars = {p: i for p, i in ids.items() if len(p) == 1}
    symbol_of = np.full(max(map(ord, chars)) + 2, -1, np.int32)
    symbol_of[list(map(ord, chars))] = list(chars.values())
    keys = np.array(sorted(merges), np.int32)
    return {"chars": chars, "merges": merges, "merged": [ids[p] for p in order], "bytes": byte_ids, "texts": texts,
            "symbol_of": symbol_of, "keys": keys, "ranks": np.array([merges[k] for k in keys.tolist()], np.int32),
            "merged_ids": np.array([ids[p] for p in order], np.int32)}


def stream(digest: bytes) -> Iterator[int]:
    """Endless bytes of the keyed hash stream that begins with ``digest``."""
    while True:
        yield from digest
        digest = hashlib.blake2b(digest).digest()


def merge_short(symbols: list[int], merge, merged: list[int], draw, bar: int) -> list[int]:
    """The agenda as a list of the ranks of neighbours; its first minimum is next."""
    agenda = [merge(a << SHIFT | b, NONE) for a, b in zip(symbols, symbols[1:])]
    while agenda and (m := min(agenda)) != NONE:
        i = agenda.index(m)
        if bar and draw() < bar:
            agenda[i] = NONE
            continue
        symbols[i] = a = merged[m]
        del symbols[i + 1], agenda[i]
        if i < len(agenda):
            agenda[i] = merge(a << SHIFT | symbols[i + 1], NONE)
        if i:
            agenda[i - 1] = merge(symbols[i - 1] << SHIFT | a, NONE)
    return symbols


def merge_long(symbols: list[int], merge, merged: list[int], draw, bar: int) -> list[int]:
    """The same agenda as a heap: n log n for very long words."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda = [(m, i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (m := merge(a << SHIFT | b, NONE)) != NONE]
    heapq.heapify(agenda)
    gone = set()
    while agenda:
        m, i = heapq.heappop(agenda)
        j = after[i]
        # Entries about symbols that are merged by now are stale.
        if i in gone or j >= n or merge(symbols[i] << SHIFT | symbols[j], NONE) != m:
            continue
        if bar and draw() < bar:
            continue
        symbols[i] = a = merged[m]
        gone.add(j)
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (m := merge(a << SHIFT | symbols[k], NONE)) != NONE:
                heapq.heappush(agenda, (m, i))
        if (g := before[i]) >= 0 and (m := merge(symbols[g] << SHIFT | a, NONE)) != NONE:
            heapq.heappush(agenda, (m, g))
    return [s for i, s in enumerate(symbols) if i not in gone]


def segment(word: str, model: dict, digest: bytes, rate: float) -> tuple[int, ...]:
    """Piece ids of one word. The t-th merge taken from the agenda is skipped if
    byte t of the keyed hash stream that begins with ``digest`` is under the rate."""
    chars = model["chars"]
    symbols = [chars[c] if c in chars else -1 - ord(c) for c in word]
    merge = merge_short if len(symbols) <= SHORT else merge_long
    symbols = merge(symbols, model["merges"].get, model["merged"], stream(digest).__next__, round(rate * 256))
    if min(symbols) >= 0:
        return tuple(symbols)
    return tuple(x for s in symbols for x in ((s,) if s >= 0 else map(model["bytes"].__getitem__, chr(-1 - s).encode())))


def segment_many(words: list[str], model: dict, digests: list[bytes], rate: float) -> list[tuple[int, ...]]:
    """:func:`segment` of many words, whose agendas are processed in step.

    A row is a word: its symbols and the agenda, the ranks of neighbours. In each step every
    row takes its best, leftmost candidate, which is skipped or merged. Words too long for that, or
    that use up the first bytes of their stream, go one by one.
    """
    return [tuple(np.frombuffer(x, np.int32).tolist()) for x in packed_ids(words, model, digests, rate)]


def packed_ids(words: list[str], model: dict, digests: list[bytes], rate: float) -> list[bytes]:
    """The ids of :func:`segment_many`, those of a word as the bytes of 32-bit integers."""
    out: list = [None] * len(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    short = order[(lengths[order] > 0) & (lengths[order] <= SHORT)]
    for start in range(0, len(short), ROWS):
        rows = short[start:start + ROWS].tolist()
        for i, ids in zip(rows, _segment_rows([words[i] for i in rows], model, [digests[i] for i in rows], round(rate * 256))):
            out[i] = ids
    for i, ids in enumerate(out):
        if ids is None:
            out[i] = np.array(segment(words[i], model, digests[i], rate), np.int32).tobytes()
    return out


def _segment_rows(words: list[str], model: dict, digests: list[bytes], bar: int) -> list[bytes | None]:
    """Columns never move: a merged symbol stays in its first column, and the neighbours of a column are noted."""
    symbol_of, keys, ranks, merged = model["symbol_of"], model["keys"], model["ranks"], model["merged_ids"]
    n, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
    width = int(lengths.max()) + 2  # a column that is never a symbol on either side
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int32)
    known = symbol_of[np.minimum(points, len(symbol_of) - 1)]
    symbols = np.full((n, width), OUTSIDE, np.int32)
    inside = (np.arange(width) > 0) & (np.arange(width) <= lengths[:, None])
    symbols[inside] = np.where((points < len(symbol_of)) & (known >= 0), known, -1 - points)

    def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = np.where((a | b) >= 0, a << SHIFT | b, -1)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, ranks[at], np.int32(NONE))

    agenda = np.full((n, width), NONE, np.int32)
    agenda[:, 1:-1] = rank(symbols[:, 1:-1], symbols[:, 2:])
    draws = np.frombuffer(b"".join(digests), np.uint8).reshape(n, -1)
    # Flat places of all rows; only those still at work are looked at.
    flat, ahead, back = symbols.ravel(), np.arange(1, n * width + 1, dtype=np.int32), np.arange(-1, n * width - 1, dtype=np.int32)
    candidates = agenda.ravel()
    row, open_ = np.arange(n), np.ones(n, bool)
    for drawn in range(draws.shape[1] if bar else n * width):
        best = row * width + agenda[row].argmin(1)
        value = candidates[best]
        todo = value != NONE
        if not todo.all():
            open_[row[~todo]] = False
            row, best, value = row[todo], best[todo], value[todo]
        if not len(row):
            break
        if bar:
            skipped = draws[row, drawn] < bar
            candidates[best[skipped]] = NONE
            best, value = best[~skipped], value[~skipped]
        gone = ahead[best]
        after, before = ahead[gone], back[best]
        flat[best] = new = merged[value]
        flat[gone] = OUTSIDE
        candidates[gone] = NONE
        ahead[best], back[after] = after, best
        candidates[best] = rank(new, flat[after])
        candidates[before] = rank(flat[before], new)
    alive = symbols != OUTSIDE
    raw, ends = symbols[alive].tobytes(), (4 * np.cumsum(alive.sum(1))).tolist()
    out: list = [raw[a:b] for a, b in zip([0, *ends], ends)]
    for i in np.flatnonzero(open_).tolist():
        out[i] = None
    texts = model["bytes"]
    for i in np.flatnonzero((symbols < 0).sum(1) > (~alive).sum(1)).tolist():
        if out[i] is not None:
            ids = np.frombuffer(out[i], np.int32).tolist()
            out[i] = np.array([y for s in ids for y in ((s,) if s >= 0 else map(texts.__getitem__, chr(-1 - s).encode()))], np.int32).tobytes()
    return out


class Segmentations:
    """Words of one variant and their packed ids. Remembers the words of the last texts, in two
    generations of about ``memo`` bytes; a word that is used again moves to the newer."""

    def __init__(self, model: dict, seed: int, variant: int, rate: float, memo: int):
        self.model, self.rate, self.memo, self.new, self.old, self.size = model, rate, memo, {}, {}, 0
        self.keyed = hashlib.blake2b(key=f"{seed}/{variant}".encode())

    def _digests(self, words: list[str]) -> list[bytes]:
        out, copy = [], self.keyed.copy
        for word in words:
            keyed = copy()
            keyed.update(word.encode())
            out.append(keyed.digest())
        return out

    def look_up(self, words: set[str]) -> dict[str, bytes]:
        """The ids of each word."""
        known = words.intersection(self.new)
        here = dict(zip(known, map(self.new.__getitem__, known)))
        rest = words.difference(known)
        again = rest.intersection(self.old)
        fresh = dict(zip(again, map(self.old.__getitem__, again)))
        missing = list(rest.difference(again))
        fresh.update(zip(missing, packed_ids(missing, self.model, self._digests(missing), self.rate)))
        here.update(fresh)
        self._remember(fresh)
        return here

    def _remember(self, fresh: dict[str, bytes]) -> None:
        size = ENTRY * len(fresh) + 2 * sum(map(len, fresh)) + sum(map(len, fresh.values()))
        if self.size + size > self.memo:
            self.old, self.new, self.size = self.new, {}, 0
        if size <= self.memo:
            self.new.update(fresh)
            self.size += size


class Encoder:
    def __init__(self, model: dict, seed: int = SEED, rate: float = DROPOUT, variants: int = VARIANTS):
        self.words = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall
        self.variants = max(1, variants)
        self.seed = str(seed).encode()
        self.memo = [Segmentations(model, seed, v, rate, MEMO // self.variants) for v in range(self.variants)]
        self.mark_ids = np.array([model["bytes"][b] for b in MARK.encode()], np.int32).tobytes()

    def variant_of(self, doc_id: object) -> int:
        h = hashlib.blake2b(str(doc_id).encode(), digest_size=8, key=self.seed).digest()
        return int.from_bytes(h, "big") % self.variants

    def _parts(self, text: str) -> list[list[str]]:
        """The words of a text, between the piece markers that it has itself."""
        parts = text.split(MARK) if text else []
        return [self.words(p.replace(" ", MARK) if k else MARK + p.replace(" ", MARK)) for k, p in enumerate(parts)]

    def packed(self, texts: list[str | None], variants: list[int]) -> list[bytes | None]:
        """Packed ids of each text in its variant; the words of all of them are looked up together."""
        parts = [None if t is None else self._parts(t) for t in texts]
        asked: list[set[str]] = [set() for _ in range(self.variants)]
        for p, v in zip(parts, variants):
            for words in p or ():
                asked[v].update(words)
        ids_of = [memo.look_up(words).__getitem__ for memo, words in zip(self.memo, asked)]
        return [None if p is None else self.mark_ids.join([b"".join(map(ids_of[v], words)) for words in p])
                for p, v in zip(parts, variants)]

    def encode_all(self, texts: list[str | None], variants: list[int]) -> list[list[int] | None]:
        """Ids of each text in its variant."""
        return [None if x is None else np.frombuffer(x, np.int32).tolist() for x in self.packed(texts, variants)]

    def encode(self, text: str, variant: int = 0) -> list[int]:
        return self.encode_all([text], [variant])[0]


class Decoder:
    def __init__(self, model: dict):
        self.byte_of = {i: b for b, i in enumerate(model["bytes"])}
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else t.replace(MARK, " ").encode()
                    for i, t in enumerate(model["texts"])]
        self.pieces = pa.array(self.raw, pa.large_binary())

    def decode(self, ids: list[int]) -> str:
        """The text; the one space put before it is taken off."""
        return b"".join(map(self.raw.__getitem__, ids))[1:].decode()

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each text, with the one space put before it; of no ids none, of null ids null."""
        whole = pa.ListArray.from_arrays(ids.offsets, self.pieces.take(ids.values), mask=ids.is_null())
        return pc.binary_join(whole, pa.scalar(b"", pa.large_binary()))

    def lossless(self, texts: pa.Array, ids: pa.ListArray) -> pa.Array:
        """Whether the ids are decoded to the same text; so it is where both are null."""
        raw, space = texts.cast(pa.large_binary()), pa.scalar(b" ", pa.large_binary())
        put = pc.if_else(pc.equal(pc.binary_length(raw), 0), raw, pc.binary_join_element_wise(space, raw, pa.scalar(b"", pa.large_binary())))
        return pc.fill_null(pc.equal(self.decode_all(ids), put), True)


def id_lists(packed: list[bytes | None]) -> pa.ListArray:
    """Packed ids as an Arrow column."""
    offsets = np.cumsum([0, *(len(x or b"") // 4 for x in packed)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(x or b"" for x in packed), np.int32)),
                                    mask=pa.array([x is None for x in packed], pa.bool_()))


def encode(docs: DataFrame, path: str, seed: int = SEED, rate: float = DROPOUT, variants: int = VARIANTS,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, variant, lossless: one row per input row.

    ``lossless`` says whether the ids were decoded to the same text again.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_model(path))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value, seed, rate, variants), Decoder(shared.value)
        for whole in batches:
            for b in slices_of_bytes(whole, 1, TEXT):  # ids take more room than their text
                keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                chosen = [encoder.variant_of(k) for k in keys]
                ids = id_lists(encoder.packed(texts, chosen))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), ids, pa.array(np.diff(ids.offsets.to_numpy()), pa.int64()), pa.array(chosen, pa.int32()),
                     decoder.lossless(b.column(1), ids)],
                    ["doc_id", "ids", "n_tokens", "variant", "lossless"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        tidy(run), "doc_id long, ids array<int>, n_tokens long, variant int, lossless boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids (null ids: null text)."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for b in batches:
            texts = [None if x is None else decoder.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
