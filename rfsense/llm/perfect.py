"""Minimal perfect hashing of 64-bit keys, a small function for each shard of keys.

Levels of bits: at each level a key takes a place, keys alone at theirs set its bit, and the others go to the next level. A key's slot is
the number of bits set before its own, so n keys have the slots 0 .. n - 1. Keys outside the set get any slot or none; whoever may ask
for such keeps the keys by slot and compares.
"""

from __future__ import annotations

import numpy as np

ROOM = 1.7
"""Bits of a level for each of its keys."""

_U = np.uint64


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys + _U((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return ((x ^ (x >> _U(31))) % _U(size)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[int], bytes]:
    """The sizes of the levels and their bits, for distinct keys."""
    keys, sizes, bits = keys.astype(np.int64).view(np.uint64), [], []
    while len(keys):
        size = int(len(keys) * ROOM) + 1
        at = _place(keys, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        keys = keys[~alone[at]]
    return sizes, np.packbits(np.concatenate(bits)).tobytes() if bits else b""


def slots(keys: np.ndarray, sizes: list[int], bits: bytes) -> np.ndarray:
    """The slot of each key, -1 where no level has its bit."""
    keys = keys.astype(np.int64).view(np.uint64)
    total = sum(sizes)
    flags = np.unpackbits(np.frombuffer(bits, np.uint8), count=total).astype(bool)
    before = np.cumsum(flags) - 1
    out, open_, base = np.full(len(keys), -1), np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        at = base + _place(keys[open_], level, size)
        hit = flags[at]
        out[open_[hit]] = before[at[hit]]
        open_, base = open_[~hit], base + size
        if not len(open_):
            break
    return out
