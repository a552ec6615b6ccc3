"""An n-gram trie in Elias-Fano levels, mapped from a file.

Level one holds the contexts' fingerprints in order, and monotone pointers to
their successors. Level two holds the successors: a value is the context's place
and the successor's short fingerprint, so the whole level is monotone and a
successor is searched relative to its context. Smoothed probabilities and
back-off weights are quantised to one byte on a logarithmic scale.
"""

from __future__ import annotations

import math
import tempfile

import numpy as np

#: Bits of a successor's fingerprint, which only has to tell the successors of one context apart.
SUCCESSOR_BITS = 32
#: One step of the probability scale, in decades. Code 0 stands for nothing, code 1 for probability 1.
DECADES = 0.04
VALUES = np.concatenate(([0.0], 10.0 ** (-DECADES * np.arange(255))))


def quantised(values: np.ndarray) -> np.ndarray:
    """Codes of probabilities above 0."""
    steps = np.rint(-np.log10(values) / DECADES)
    return (np.clip(steps, 0, 254) + 1).astype(np.uint8)


def pair_discount(once: int, twice: int) -> float:
    """The absolute discount from how many pairs occur once and twice."""
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.75


def packed_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of each value, end to end."""
    out = []
    for i in range(0, len(values), 1 << 16):  # whole bytes, as 2^16 times any width is
        bits = (values[i : i + (1 << 16), None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        out.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint8)


def unpacked_bits(packed: np.ndarray, width: int, count: int) -> np.ndarray:
    out = np.zeros(count, dtype=np.uint64)
    if width:
        for i in range(0, count, 1 << 16):
            n = min(1 << 16, count - i)
            bits = np.unpackbits(packed[i * width // 8 :][: (n * width + 7) // 8], bitorder="little")[: n * width]
            shifted = bits.reshape(n, width).astype(np.uint64) << np.arange(width, dtype=np.uint64)
            out[i : i + n] = shifted.sum(axis=1, dtype=np.uint64)
    return out


class EliasFano:
    """A rising sequence of 64-bit values: low bits as they are, high bits as unary gaps."""

    def __init__(self, count: int, width: int, low: np.ndarray, high: np.ndarray) -> None:
        self.count, self.width, self.low, self.high = count, width, low, high

    @classmethod
    def encoded(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        if not len(values):
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        width = max(0, int(math.log2(max(1.0, (float(values[-1]) + 1) / len(values)))))
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(len(values))
        high = np.zeros(int(places[-1]) + 1, dtype=np.uint8)
        high[places] = 1
        return cls(len(values), width, packed_bits(values, width), np.packbits(high, bitorder="little"))

    def decoded(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        high = (ones - np.arange(len(ones))).astype(np.uint64) << np.uint64(self.width)
        return high | unpacked_bits(self.low, self.width, self.count)


class Trie:
    """Contexts, pointers and successors of one shard, kept in a mapped file."""

    def __init__(self, contexts, pointers, successors, codes, backoffs, totals) -> None:
        self.shapes, parts, at = [], [], 0
        levels = [EliasFano.encoded(x) for x in (contexts, pointers, successors)]
        for level in levels:
            parts += [level.low, level.high]
        parts += [codes, backoffs, totals.astype("<u8").view(np.uint8)]
        self.file = tempfile.TemporaryFile()
        for part in parts:
            self.shapes.append((at, len(part)))
            self.file.write(part.tobytes())
            at += len(part)
        self.file.flush()
        self.mapped = np.memmap(self.file, dtype=np.uint8, mode="r", shape=(at,)) if at else np.zeros(0, np.uint8)
        self.bytes = at
        sized = [(level.count, level.width) for level in levels]
        self.contexts, self.pointers, self.successors = (
            EliasFano(*sized[i], self.part(2 * i), self.part(2 * i + 1)).decoded() for i in range(3)
        )
        self.codes, self.backoffs, self.totals = self.part(6), self.part(7), self.part(8).view("<u8")

    def part(self, number: int) -> np.ndarray:
        at, size = self.shapes[number]
        return self.mapped[at : at + size]

    @classmethod
    def built(cls, contexts: np.ndarray, successors: np.ndarray, counts: np.ndarray, discount: float | None = None) -> Trie:
        """From one entry per seen (context, successor), in any order and with repeats.

        Probabilities are absolutely discounted counts; the corpus gives the discount, or without it these counts of counts.
        """
        known, place = np.unique(contexts, return_inverse=True)
        keys, where = np.unique((place.astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | successors, return_inverse=True)
        counts = np.bincount(where, counts, len(keys))
        owner = (keys >> np.uint64(SUCCESSOR_BITS)).astype(np.int64)
        totals = np.bincount(owner, counts, len(known))
        kinds = np.bincount(owner, minlength=len(known))
        if discount is None:
            discount = pair_discount(int((counts == 1).sum()), int((counts == 2).sum()))
        seen = (counts - discount) / totals[owner]
        pointers = np.concatenate(([0], np.cumsum(kinds)))
        return cls(known, pointers, keys, quantised(seen), quantised(discount * kinds / totals), totals)

    def find_contexts(self, contexts: np.ndarray) -> np.ndarray:
        """Places of contexts, -1 where unknown."""
        if not len(self.contexts):
            return np.full(len(contexts), -1)
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        return np.where(self.contexts[at] == contexts, at, -1)

    def find_successors(self, places: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Codes of successors relative to the places of their contexts, 0 where unseen."""
        codes = np.zeros(len(places), dtype=np.uint8)
        known = np.flatnonzero(places >= 0)
        if len(known):
            value = (places[known].astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | successors[known]
            at = np.searchsorted(self.successors, value)
            inside = at < self.pointers[places[known] + 1].astype(np.int64)
            hit = inside & (self.successors[np.minimum(at, len(self.successors) - 1)] == value)
            codes[known[hit]] = self.codes[at[hit]]
        return codes
