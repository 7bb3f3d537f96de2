"""A counting quotient filter over 64-bit fingerprints, built and merged with numpy.

A fingerprint is cut into a quotient (its upper bits, the home slot) and a remainder (the rest). Slots
hold the remainders in order; two bit vectors say which quotients occur and where each quotient's run
ends, so that the sequence of slots can be decoded into exactly the fingerprints that went in, with
their counts. Nothing is lost: the filter is a sorted multiset in compact form.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<BBQQ")


class CountingQuotientFilter:
    """Slots in ascending order of (quotient, remainder), each with a count.

    base is the number of leading bits that all fingerprints share with ``prefix``; q bits after those
    address the home slots.
    """

    def __init__(self, q: int, base: int, prefix: int, occupied, runends, remainders, counts):
        self.q, self.base, self.prefix = q, base, prefix
        self.occupied, self.runends, self.remainders, self.counts = occupied, runends, remainders, counts

    @classmethod
    def build(cls, fingerprints, counts=None, base: int = 0, prefix: int = 0) -> CountingQuotientFilter:
        """fingerprints: unsigned 64-bit numbers in any order, repeats allowed."""
        values = np.asarray(fingerprints, dtype=np.uint64)
        weights = np.ones(len(values), np.uint64) if counts is None else np.asarray(counts, np.uint64)
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
        first = np.ones(len(values), bool)
        first[1:] = values[1:] != values[:-1]
        starts = np.flatnonzero(first)
        sums = np.add.reduceat(weights, starts) if len(starts) else weights
        return cls._of_sorted(values[starts], sums, base, prefix)

    @classmethod
    def _of_sorted(cls, distinct, sums, base: int, prefix: int) -> CountingQuotientFilter:
        q = min(max(1, int(np.ceil(np.log2(max(2, len(distinct)) / 0.75)))), 63 - base)
        rest = 64 - base - q
        local = distinct & np.uint64((1 << (64 - base)) - 1)
        quotients = (local >> np.uint64(rest)).astype(np.int64)
        remainders = local & np.uint64((1 << rest) - 1)
        n = len(distinct)
        # A remainder sits at its home slot or right behind its predecessor, whichever comes later.
        slots = np.maximum.accumulate(quotients - np.arange(n)) + np.arange(n) if n else quotients
        size = max(1 << q, int(slots[-1]) + 1 if n else 0)
        occupied, runends = np.zeros(1 << q, bool), np.zeros(size, bool)
        occupied[quotients] = True
        last = np.ones(n, bool)
        last[:-1] = quotients[1:] != quotients[:-1]
        runends[slots[last]] = True
        used = np.zeros(size, np.uint64)
        used[slots] = remainders
        tally = np.zeros(size, np.uint64)
        tally[slots] = sums
        return cls(q, base, prefix, occupied, runends, used, tally)

    def items(self):
        """(fingerprints in ascending order, counts): the k-th run belongs to the k-th occupied quotient."""
        slots = np.flatnonzero(self.counts)
        if not len(slots):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        run = np.cumsum(self.runends)[slots] - self.runends[slots]
        quotients = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        rest = 64 - self.base - self.q
        local = (quotients << np.uint64(rest)) | self.remainders[slots]
        high = np.uint64((self.prefix << (64 - self.base)) & ((1 << 64) - 1)) if self.base else np.uint64(0)
        return local | high, self.counts[slots]

    def count(self, fingerprint: int) -> int:
        """How often the fingerprint went in."""
        values, counts = self.items()
        at = int(np.searchsorted(values, np.uint64(fingerprint)))
        return int(counts[at]) if at < len(values) and int(values[at]) == fingerprint else 0

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """The filter of all that went into any of them; all must share base and prefix."""
        parts = [f.items() for f in filters]
        base, prefix = filters[0].base, filters[0].prefix
        if any((f.base, f.prefix) != (base, prefix) for f in filters):
            raise ValueError("filters of different prefixes cannot be merged")
        return cls.build(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), base, prefix)

    def split(self, bits: int):
        """(prefix, filter) for each non-empty range of fingerprints that share their first bits."""
        values, counts = self.items()
        if not bits:
            yield 0, self
            return
        tops = (values >> np.uint64(64 - bits)).astype(np.int64)
        edges = np.flatnonzero(np.diff(tops, prepend=-1)) if len(tops) else tops
        for a, b in zip(edges, [*edges[1:], len(values)], strict=False):
            yield int(tops[a]), self._of_sorted(values[a:b], counts[a:b], bits, int(tops[a]))

    def to_bytes(self) -> bytes:
        """Slots with their bit vectors; counts take one byte each, larger ones follow in a list."""
        slots = np.flatnonzero(self.counts)
        counts = self.counts[slots]
        rest = 64 - self.base - self.q
        width = next(w for w in (1, 2, 4, 8) if 8 * w >= rest)
        small = np.minimum(counts, 255).astype(np.uint8)
        return b"".join([
            _HEAD.pack(self.q, self.base, self.prefix, len(self.runends)),
            np.packbits(self.occupied).tobytes(),
            np.packbits(self.runends).tobytes(),
            np.packbits(self.counts > 0).tobytes(),
            self.remainders[slots].astype(f"<u{width}").tobytes(),
            small.tobytes(),
            counts[small == 255].astype("<u8").tobytes(),
        ])

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        q, base, prefix, size = _HEAD.unpack_from(data)
        at = _HEAD.size

        def bits(n):
            nonlocal at
            out = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), count=n).astype(bool)
            at += (n + 7) // 8
            return out

        occupied, runends, used = bits(1 << q), bits(size), bits(size)
        slots = np.flatnonzero(used)
        rest = 64 - base - q
        width = next(w for w in (1, 2, 4, 8) if 8 * w >= rest)
        remainders, counts = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        remainders[slots] = np.frombuffer(data, f"<u{width}", len(slots), at)
        at += width * len(slots)
        small = np.frombuffer(data, np.uint8, len(slots), at).astype(np.uint64)
        at += len(slots)
        large = small == 255
        small[large] = np.frombuffer(data, "<u8", int(large.sum()), at)
        counts[slots] = small
        return cls(q, base, prefix, occupied, runends, remainders, counts)
