"""Periodic runs of words, found by longest common extensions (operator 13).

A run is a stretch of consecutive words of smallest period q and at least
max(MIN_WORDS, TIMES * q) words that cannot be made longer keeping period q.

Extensions come from a difference cover modulo COVER: only positions whose
remainder is in SAMPLED are sorted as suffixes (windows of COVER words, then ranks
by doubling along the samples). Any two positions are at most COVER - 1 words
before a pair of sampled ones, so an extension compares these few words and
then asks a sparse table for the smallest common prefix between two ranks.

The harmonic grid asks, for each period p, only the positions 0, p, 2p, ...: a
run of period p covers one of them within its first p words. From there the forward extension
gives its end; its start, less than p words before, is searched by halves with
the same extensions. Grid points whose word does not come back p and 2p words
later are dropped first, and only texts with some point left are sorted.

A task takes the texts of BLOCK words at a time, each closed by a word of its own, so no
extension leaves its text. A longer text is a block by itself: memory
follows the longest text. Nothing is shuffled.

Defined cases: null and empty texts have no words, no runs and an empty collapsed
text; a text shorter than MIN_WORDS has no run; repeated rows get equal
results; further columns are ignored. Words are compared as bytes, so
invalid characters do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.common import table

MIN_WORDS = 6
TIMES = 4
COVER = 21
SAMPLED = (0, 1, 4, 14, 16)
BLOCK = 1 << 16
GRID_ROWS = 1 << 20


def _cover_tables() -> tuple[np.ndarray, np.ndarray]:
    """The place of each remainder among the sampled ones (or -1), and for two
    remainders the least step after which both are sampled."""
    place = np.full(COVER, -1, np.int64)
    place[list(SAMPLED)] = np.arange(len(SAMPLED))
    step = np.full((COVER, COVER), COVER, np.int64)
    for d in range(COVER - 1, -1, -1):
        ok = np.roll(place >= 0, -d)  # remainders that d more words bring to a sampled one
        step[np.ix_(ok, ok)] = d
    if (step == COVER).any():
        raise ValueError("SAMPLED is no difference cover")
    return place, step


PLACE, STEP = _cover_tables()


class Extensions:
    """Longest common extensions of positions in a sequence of word numbers.

    Some word after the end of every text must be found nowhere else.
    """

    def __init__(self, ids: np.ndarray):
        n = self.n = len(ids)
        blocks = -(-n // COVER)
        top = int(ids.max(initial=0)) + 1
        self.ids = np.concatenate((ids.astype(np.int64), np.arange(top, top + 2 * COVER)))
        starts = (np.arange(blocks)[:, None] * COVER + np.array(SAMPLED)).ravel()
        starts = starts[starts < n]
        ranks = [self._window_ranks(starts, top + 2 * COVER)]
        m = len(starts)
        reach = COVER
        while int(ranks[-1].max(initial=-1)) + 1 < m:
            after = starts + reach
            known = after < n
            second = np.zeros(m, np.int64)
            second[known] = ranks[-1][self._sample(after[known])] + 1
            ranks.append(np.unique(ranks[-1] * (m + 1) + second, return_inverse=True)[1])
            reach *= 2
        self.rank = ranks[-1]
        order = starts[np.argsort(self.rank)]
        self.table = [self._common_prefixes(order[:-1], order[1:], ranks)]
        width = 1
        while 2 * width < m:
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    @staticmethod
    def _sample(at: np.ndarray) -> np.ndarray:
        return at // COVER * len(SAMPLED) + PLACE[at % COVER]

    def _window_ranks(self, starts: np.ndarray, top: int) -> np.ndarray:
        """Rank of the COVER words from each start on; several words go in one key."""
        each = max(1, 62 // top.bit_length())
        keys = []
        for first in range(0, COVER, each):
            key = np.zeros(len(starts), np.int64)
            for i in range(first, min(first + each, COVER)):
                key = key * top + self.ids[starts + i]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(starts), np.int64)
        for key in keys:
            new[1:] |= np.diff(key[order]) != 0
        ranks = np.empty(len(starts), np.int64)
        ranks[order] = np.cumsum(new)
        return ranks

    def _words_alike(self, a: np.ndarray, b: np.ndarray, most: np.ndarray | int) -> np.ndarray:
        """Equal words from a and b on, up to ``most`` (under COVER)."""
        most = np.broadcast_to(most, a.shape)
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        for t in range(COVER):
            live = live[most[live] > t]
            live = live[self.ids[a[live] + t] == self.ids[b[live] + t]]
            if not len(live):
                break
            out[live] = t + 1
        return out

    def _common_prefixes(self, a: np.ndarray, b: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
        """Common prefixes of pairs of sampled suffixes, by ranks from long to short."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            reach = COVER << k
            inside = np.flatnonzero(np.maximum(a, b) + out < self.n)
            same = inside[ranks[k][self._sample(a[inside] + out[inside])] == ranks[k][self._sample(b[inside] + out[inside])]]
            out[same] += reach
        return out + self._words_alike(a + out, b + out, COVER - 1)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from positions a and b (a != b) on."""
        step = STEP[a % COVER, b % COVER]
        out = self._words_alike(a, b, step)
        far = np.flatnonzero(out == step)
        if len(far):
            x = self.rank[self._sample(a[far] + step[far])]
            y = self.rank[self._sample(b[far] + step[far])]
            low, high = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp(high - low)[1] - 1  # the largest power of two that fits
            smallest = np.empty(len(far), np.int64)
            for k in np.unique(level):
                at = np.flatnonzero(level == k)
                row = self.table[k]
                smallest[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
            out[far] += smallest
        return out


def grid_points(ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, position and period of the grid points whose word comes back p and 2p words later."""
    periods = np.where(sizes >= MIN_WORDS, sizes // TIMES, 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    p = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    count = (sizes[text] - 1 - 2 * p) // p + 1
    ends = np.cumsum(count)
    found = []
    start = 0
    while start < len(p):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + GRID_ROWS, "right")))
        c = count[start:stop]
        which = np.repeat(np.arange(start, stop), c)
        k = np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c)
        step = p[which]
        at = begins[text[which]] + k * step
        here = ids[at]
        hit = np.flatnonzero(here == ids[at + step])
        hit = hit[here[hit] == ids[at[hit] + 2 * step[hit]]]
        found.append((text[which[hit]], at[hit], step[hit]))
        start = stop
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def find_runs(ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period.

    ``ids`` holds the texts one behind the other, each followed by a number of its own.
    """
    none = np.empty((0, 4), np.int64)
    text, at, p = grid_points(ids, begins, sizes)
    if not len(text):
        return none
    # Only texts with a grid point left are sorted; positions move together.
    chosen = np.unique(text)
    lengths = sizes[chosen] + 1
    offsets = np.cumsum(lengths) - lengths
    spots = np.repeat(begins[chosen] - offsets, lengths) + np.arange(int(lengths.sum()))
    words = Extensions(np.unique(ids[spots], return_inverse=True)[1])
    local = np.searchsorted(chosen, text)
    at = at - begins[text] + offsets[local]
    floor = offsets[local]

    ahead = words.common(at, at + p)
    keep = ahead > (TIMES - 2) * p
    local, at, p, floor, ahead = (x[keep] for x in (local, at, p, floor, ahead))
    # The grid point before has the run as well if p words back all match.
    back = at - p >= floor
    earlier = np.zeros(len(at), bool)
    earlier[back] = words.common(at[back] - p[back], at[back]) >= p[back]
    local, at, p, floor, ahead = (x[~earlier] for x in (local, at, p, floor, ahead))
    low, high = np.maximum(at - p, floor), at.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            break
        middle = (low[open_] + high[open_]) // 2
        reaches = words.common(middle, middle + p[open_]) >= at[open_] - middle
        high[open_[reaches]] = middle[reaches]
        low[open_[~reaches]] = middle[~reaches] + 1
    length = at + ahead + p - high
    long_enough = length >= np.maximum(MIN_WORDS, TIMES * p)
    rows = np.stack((local, high - floor, length, p), 1)[long_enough]
    # A multiple of the smallest period has the same bounds.
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
    rows = rows[first]
    rows[:, 0] = chosen[rows[:, 0]]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words outside the repetitions of any run (rows start, length, period), joined by one space."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0)])


def _block(texts: list[list[bytes]]) -> tuple[np.ndarray, list[np.ndarray], list[bytes]]:
    """Word counts, runs and collapsed texts of a block of texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    ids = np.empty(int(sizes.sum()) + len(texts), np.int64)
    is_word = np.ones(len(ids), bool)
    is_word[begins + sizes] = False
    encoded = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    ids[is_word] = encoded.indices.to_numpy()
    ids[~is_word] = len(encoded.dictionary) + np.arange(len(texts))
    rows = find_runs(ids, begins, sizes)
    cuts = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    runs = [rows[a:b, 1:] for a, b in zip(cuts, cuts[1:])]
    return sizes, runs, [collapse(t, r) for t, r in zip(texts, runs)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed: one row per input row."""

    def batch(keys: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        sizes, runs, collapsed = _block(texts)
        offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
        flat = np.concatenate(runs)
        values = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), values),
             pa.array([c.decode() for c in collapsed], pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts, size = [], [], 0
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                if texts and size + len(words) > BLOCK:
                    yield batch(keys, texts)
                    keys, texts, size = [], [], 0
                keys.append(key)
                texts.append(words)
                size += len(words) + 1
            if texts:
                yield batch(keys, texts)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def highest_exponent(runs: str) -> Column:
    """The run of the greatest length / period; of equal ones the first."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.reduce(runs, none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def with_repetitions(docs: DataFrame) -> DataFrame:
    """doc_id and text of the contract's input: in documents whose crc32(doc_id) ends
    in 0, the words from a on repeat with period p."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("words").cast("long")
    a = F.pmod(F.col("g"), n)
    p = F.floor((n - F.col("a")) / (F.pmod(F.col("g"), F.lit(8)) + 3)) + 1
    rest = F.transform(F.sequence(F.col("a"), n - 1), lambda i: F.col("words")[(F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int")])
    repeated = F.array_join(F.concat(F.slice("words", 1, F.col("a").cast("int")), rest), " ")
    return (docs.select("doc_id", "text", F.when(F.pmod(h, F.lit(10)) == 0, words).alias("words"), g.alias("g"))
            .withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p))
            .select("doc_id", F.when(n > 0, repeated).otherwise(F.col("text")).alias("text")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repetitions(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    best = found.withColumn("best", highest_exponent("runs"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"), "n_words")


#: crc32 of a short text of digits, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, 3988292384::BIGINT * (r & 1)))))"""

ORACLE = rf"""
WITH d AS (SELECT doc_id, {_CRC} AS h, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
e AS (SELECT *, len(ws) AS n, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM e),
k AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f),
x AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS ws FROM k),
w AS (SELECT doc_id, n, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM x),
pairs AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
spans AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS m FROM
            (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs)
          GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, s, m, min(q) AS q FROM spans GROUP BY doc_id, s, m),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + m)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY m::DOUBLE / q DESC, s, q) = 1),
r AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id)
SELECT x.doc_id, coalesce(n_runs, 0) AS n_runs, s AS "start", m AS length, q AS period, (1000 * m) // q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256, n AS n_words
FROM x LEFT JOIN r USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
