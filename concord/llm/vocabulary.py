"""Vectorised lookups of vocabulary pieces inside many words at once.

A word is a byte string.  Words of one length form a matrix; a piece ending at
column ``i`` is found through rolling polynomial hashes in an open-addressing
table, so one numpy call answers one (position, length) for every word.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


class HashTable:
    """Unsigned 64-bit keys to non-negative ints, by linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, slack: int = 4):
        bits = max(4, int(len(keys) * slack - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        slots = ((keys * _SPREAD) >> self.shift).astype(np.int64)
        self.probes = 1
        for key, value, slot in zip(keys, values.tolist(), slots.tolist(), strict=True):
            steps = 1
            while self.values[slot] >= 0:
                if self.keys[slot] == key:
                    raise ValueError("two pieces share a hash")
                slot, steps = (slot + 1) & self.mask, steps + 1
            self.keys[slot], self.values[slot] = key, value
            self.probes = max(self.probes, steps)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = ((keys * _SPREAD) >> self.shift).astype(np.int64)
        value = self.values[slot]
        hit = self.keys[slot] == keys
        out = np.where(hit, value, -1)
        rest = np.nonzero(~hit & (value >= 0))[0]
        for _ in range(1, self.probes):
            if not len(rest):
                break
            slot[rest] = (slot[rest] + 1) & self.mask
            value, hit = self.values[slot[rest]], self.keys[slot[rest]] == keys[rest]
            out[rest[hit]] = value[hit]
            rest = rest[~hit & (value >= 0)]
        return out


def powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]).cumprod(dtype=np.uint64)


def prefix_hashes(matrix: np.ndarray) -> np.ndarray:
    """Hash of each row's first i bytes, for i = 0 .. width."""
    n, width = matrix.shape
    out = np.zeros((width + 1, n), np.uint64)
    for i in range(width):
        out[i + 1] = out[i] * _BASE + matrix[:, i].astype(np.uint64) + np.uint64(1)
    return out


class PieceTable:
    """Byte-string pieces to their ids."""

    def __init__(self, pieces: Iterable[tuple[bytes, int]]):
        self.ids = dict(pieces)
        self.longest = max(map(len, self.ids))
        self.lengths = sorted({len(p) for p in self.ids})
        hashes = np.zeros(len(self.ids), np.uint64)
        by_length: dict[int, list[tuple[int, bytes]]] = {}
        for at, piece in enumerate(self.ids):
            by_length.setdefault(len(piece), []).append((at, piece))
        for width, group in by_length.items():
            matrix = np.frombuffer(b"".join(p for _, p in group), np.uint8).reshape(-1, width)
            hashes[[at for at, _ in group]] = prefix_hashes(matrix)[width]
        self.table = HashTable(hashes, np.fromiter(self.ids.values(), np.int64))
        self.powers = powers(self.longest)

    def ending(self, hashes: np.ndarray, i: int, width: int, rows: np.ndarray | None = None) -> np.ndarray:
        """Id of each word's bytes ``[i - width, i)``, or -1."""
        late, early = (hashes[i], hashes[i - width]) if rows is None else (hashes[i][rows], hashes[i - width][rows])
        return self.table.get(late - early * self.powers[width])


class PrefixForest:
    """Sorted words of at most ``width`` bytes, with each distinct prefix visited once.

    ``fresh[i]`` are the rows whose first ``i`` bytes no earlier row has, and
    ``node[i]`` maps every row at least that long to its place in ``fresh[i]``.
    """

    def __init__(self, words: list[bytes], width: int):
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        joined = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8)
        self.matrix = joined.reshape(len(words), width)
        self.hashes = prefix_hashes(self.matrix)
        differs = self.matrix[1:] != self.matrix[:-1]
        shared = np.where(differs.any(1), differs.argmax(1), width)
        shared = np.minimum(shared, np.minimum(self.lengths[1:], self.lengths[:-1]))
        self.shared = np.concatenate([[0] if len(words) else [], shared]).astype(np.int64)

    def level(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        new = (self.lengths >= i) & (self.shared < i)
        return np.nonzero(new)[0], new.cumsum() - 1


def forests(words: list[bytes], widths: tuple[int, ...] = (10, 16, 24, 48), chunk: int = 60_000) -> Iterator[tuple[list[bytes], PrefixForest]]:
    """The words of at most the largest width, sorted, some at a time."""
    low = 0
    for width in widths:
        own = sorted(w for w in words if low < len(w) <= width)
        for start in range(0, len(own), chunk):
            part = own[start : start + chunk]
            yield part, PrefixForest(part, width)
        low = width


@functools.cache
def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes.

    Printable Latin-1 characters stand for themselves; the other bytes get the
    code points from 256 on, in order.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.uint64) << np.uint64(20)) | (right.astype(np.uint64) + np.uint64(1))
