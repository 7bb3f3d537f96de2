"""Sets of hashed word shingles, computed with numpy over a text's UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20)
_LETTERS = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of a text that are hashed at once.
PIECE = 1 << 22

_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, _BASE)]), dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the offset of each word ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes, A-Z taken as a-z."""
    raw = np.frombuffer(data, np.uint8)
    out, offsets, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and not _IS_SPACE[raw[end]]:
            end += 1
        b = raw[at:end]
        space = _IS_SPACE[b]
        first = ~space
        first[1:] &= space[:-1]
        starts = np.flatnonzero(first)
        if len(starts):
            body = b[starts[0] :]
            place = np.arange(len(body)) - np.repeat(starts - starts[0], np.diff(starts, append=len(b)))
            values = _LETTERS[body]
            values[space[starts[0] :]] = 0
            values *= _power(int(place.max()) + 1)[place]
            out.append(np.add.reduceat(values, starts - starts[0]))
            offsets.append(starts + at)
        at = end
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return mix(np.concatenate(out)), np.concatenate(offsets)


def _runs(words: np.ndarray, span: int) -> np.ndarray:
    n = max(0, len(words) - span + 1)
    h = np.full(n, span, np.uint64)
    for i in range(span):
        h = mix((h + words[i : n + i]) * _BASE + np.uint64(i + 1))
    return h


def shingle_sets(texts: list[str | None], width: int, group: int = 1 << 20):
    """For each text the sorted distinct hashes of all runs of width words; fewer words count as one run, no word as none.

    Texts are hashed together in groups of about so many bytes.
    """
    held: list[bytes] = []
    size = 0

    def flush():
        ends = np.cumsum([len(t) + 1 for t in held])
        words, offsets = word_hashes(b" ".join(held))
        cuts = np.searchsorted(offsets, np.concatenate([[0], ends]))
        runs = _runs(words, width)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a >= width:
                yield np.unique(runs[a : b - width + 1])
            else:
                yield _runs(words[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64)

    for text in texts:
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= group:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()
