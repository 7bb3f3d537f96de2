"""Periodic runs of words (operator 13).

A run is a stretch of consecutive words with smallest period q and at least max(6, 4 q) words that no
neighbouring word extends keeping the period. It is found on a harmonic grid: a run of period p has at least
3 p places where a word equals the word p further on (5 places for p = 1), so one of the places 0, s, 2 s, ...
with s = 3 p (5 for p = 1) is among them. All (period, grid place) pairs of a group of texts are laid out at
once, some n log n / 3 for n words; pairs whose two words differ are dropped, and for the rest the longest
common extensions of both places, forwards and backwards, are binary searched simultaneously over prefix
hashes modulo 2^64. A stretch found with several periods keeps the smallest one; a longer one is its multiple.

Hashes only propose. Unequal hashes prove that an extension ends where it does; that the words inside are
equal is compared word by word, and a group whose comparison fails is hashed again on another base. So results
are exact.

Memory. Texts are searched in groups of about GROUP words, a longer text by itself; pairs are laid out PAIRS
at a time, so memory goes with the longest single text.

Defined results. A null or empty text, or one without words, has no runs: n_runs 0, four nulls, and the
digests of the empty text. Rows are independent, so ties and repeated rows need no rule; among runs of equal
length/period the smallest start, then period, counts. A null doc_id has no number to repeat words by, so its
words stay as they are. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import released, table

#: Words of a group of texts that are searched at once.
GROUP = 1 << 16
#: (period, grid place) pairs that are laid out at once.
PAIRS = 1 << 19
LEAST_WORDS, LEAST_PERIODS = 6, 4
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

_powers: dict[int, np.ndarray] = {}


def _base(attempt: int) -> np.uint64:
    return np.uint64((0x9E3779B97F4A7C15 * (2 * attempt + 1) + 0x5851F42D4C957F2C * attempt & 0xFFFFFFFFFFFFFFFF) | 1)


def _power(n: int, attempt: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2^64, kept for the sizes of a group."""
    known = _powers.get(attempt)
    if known is None or len(known) < n:
        known = np.full(max(n, 2 * GROUP), _base(attempt))
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if n <= 4 * GROUP:
            _powers[attempt] = known
    return known


def _scattered(ids: np.ndarray, attempt: int) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(attempt + 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class PrefixHashes:
    """Hashes of every stretch of words: two stretches p apart are compared by one multiplication."""

    def __init__(self, ids: np.ndarray, attempt: int = 0):
        self.power = _power(len(ids) + 1, attempt)
        self.prefix = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(_scattered(ids, attempt) * self.power[: len(ids)], dtype=np.uint64, out=self.prefix[1:])

    def equal(self, at: np.ndarray, period: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the size words from each place at and from at + period have the same hash."""
        h, other = self.prefix, at + period
        return (h[at + size] - h[at]) * self.power[period] == h[other + size] - h[other]


def _grid(first: np.ndarray, words: np.ndarray):
    """(first, end, place, period) of every grid pair of texts with these first words and lengths, in bounded pieces."""
    most = words // LEAST_PERIODS
    most = np.where(words >= LEAST_WORDS, np.maximum(most, 1), 0)
    owner = np.repeat(np.arange(len(first)), most)
    if not len(owner):
        return
    period = np.arange(len(owner)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = np.where(period == 1, LEAST_WORDS - 1, (LEAST_PERIODS - 1) * period)
    places = (words[owner] - 1 - period) // step + 1
    ends = np.cumsum(places)
    at = 0
    while at < len(owner):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        n = places[at:stop]
        own, p = np.repeat(owner[at:stop], n), np.repeat(period[at:stop], n)
        nth = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
        start = first[own]
        yield start, start + words[own], start + nth * np.repeat(step[at:stop], n), p
        at = stop


def _search(hashes: PrefixHashes, low: np.ndarray, high: np.ndarray, holds) -> np.ndarray:
    """For each pair the largest size in low .. high for which holds(size, pairs); it holds at low."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_] + 1) >> 1
        yes = holds(middle, open_)
        low[open_[yes]] = middle[yes]
        high[open_[~yes]] = middle[~yes] - 1
        open_ = open_[low[open_] < high[open_]]
    return low


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Of rows of (start, end, period) the smallest period of each stretch, by start, then end."""
    rows = rows[np.lexsort(rows.T[::-1])]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[first]


def _candidates(ids: np.ndarray, first: np.ndarray, words: np.ndarray, attempt: int) -> np.ndarray:
    """Rows of (start, end, period), the smallest period of each stretch, by hashes alone."""
    hashes, found = PrefixHashes(ids, attempt), []
    for start, end, at, p in _grid(first, words):
        same = ids[at] == ids[at + p]
        start, end, at, p = start[same], end[same], at[same], p[same]
        if not len(at):
            continue
        ahead = _search(hashes, np.ones_like(at), end - at - p, lambda size, i, at=at, p=p: hashes.equal(at[i], p[i], size))
        behind = _search(hashes, np.zeros_like(at), at - start, lambda size, i, at=at, p=p: hashes.equal(at[i] - size, p[i], size))
        left, right = at - behind, at + p + ahead
        whole = right - left >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
        found.append(_smallest(np.stack([left[whole], right[whole], p[whole]], 1)))
    return _smallest(np.concatenate(found)) if found else np.zeros((0, 3), np.int64)


def find_runs(ids: np.ndarray, first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """(start, end, period) of every run of texts laid end to end in ids, by start, then end; places count in ids.

    first and words are each text's first place and its number of words; equal ids are equal words.
    """
    for attempt in count():
        rows = _candidates(ids, first, words, attempt)
        if all(np.array_equal(ids[a : b - p], ids[a + p : b]) for a, b, p in rows.tolist()):
            return rows


def repeated_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that a text is searched as: of one in ten ids, a part is repeated by a rule of the id alone."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * ((n - a) // p + 1))[: n - a]


def _summary(doc_id, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    runs = sorted((a, b - a, p) for a, b, p in runs)
    runs.sort(key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for a, n, p in runs:
            change[a + p] += 1
            change[a + n] -= 1
        words = [w for w, inside in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if not inside]
    milli = 1000 * best[1] // best[2] if best else None
    return doc_id, len(runs), *(best or (None, None, None)), milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def summaries(rows) -> list[tuple]:
    """Result rows of (doc_id, UTF-8 text or None) rows; texts are searched together in groups."""
    out, held, size = [], [], 0

    def flush():
        known: dict[bytes, int] = {}
        ids = np.fromiter((i for _, words in held for i in map(known.setdefault, words, count(len(known)))), np.int64, size)
        lengths = np.array([len(words) for _, words in held], np.int64)
        first = np.cumsum(lengths) - lengths
        of: list[list] = [[] for _ in held]
        found = find_runs(ids, first, lengths)
        for k, (a, b, p) in zip((np.searchsorted(first, found[:, 0], side="right") - 1).tolist(), found.tolist(), strict=True):
            of[k].append((a - int(first[k]), b - int(first[k]), p))
        out.extend(_summary(key, words, runs) for (key, words), runs in zip(held, of, strict=True))

    for key, text in rows:
        words = repeated_words(key, (text or b"").split())
        if held and size + len(words) > GROUP:
            flush()
            held, size = [], 0
        held.append((key, words))
        size += len(words)
    if held:
        flush()
    return out


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, and digests of all runs and of the collapsed text, of every row."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = summaries(zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)
        released()

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(run, RESULT)


_NAMES = [c.split()[0] for c in RESULT.split(", ")]
_TYPES = [pa.string() if c.endswith("string") else pa.int64() for c in RESULT.split(", ")]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))


_CRC = "list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]), lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda b, i: xor(b >> 1, 3988292384 * (b & 1))))"
SQL = rf"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, xor({_CRC}, 4294967295) AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS original FROM documents
), keyed AS (SELECT *, len(original) AS n, h // 10 AS g FROM split
), placed AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM keyed
), repeated AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed
), words AS (SELECT r, doc_id, n, unnest(range(n)) AS i, unnest(CASE WHEN a IS NULL THEN original ELSE [original[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] FOR i IN range(n)] END) AS w FROM repeated
), same AS (SELECT x.r, y.i - x.i AS p, x.i AS i FROM words AS x JOIN words AS y ON x.r = y.r AND x.w = y.w AND y.i > x.i WHERE y.i - x.i <= greatest(1, x.n // 4)
), islands AS (SELECT r, p, min(i) AS s, max(i) + 1 + p AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS k FROM same) GROUP BY r, p, k
), runs AS (SELECT r, s, e - s AS length, min(p) AS p FROM islands WHERE e - s >= greatest(6, 4 * p) GROUP BY r, s, e
), best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length / p DESC, s, p) = 1
), listed AS (SELECT r, count(*) AS n_runs, string_agg(concat(s, ',', length, ',', p, chr(10)), '' ORDER BY s, p) AS runs FROM runs GROUP BY r
), dropped AS (SELECT DISTINCT r, unnest(range(s + p, s + length)) AS i FROM runs
), kept AS (SELECT words.r, string_agg(w, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN dropped USING (r, i) GROUP BY words.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, length, p AS period, 1000 * length // p AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM split LEFT JOIN best USING (r) LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""

QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLES = {"op13_periodic_runs": SQL}
