"""Texts as runs of chunks that begin with spaces, and a table of the distinct ones.

A space goes before every text that is not empty, and a chunk begins at each run of spaces; chunks of a text put together give the space and the text.
Where a tokenizer can tell nothing apart across such a border, the tokens of a text are those of its chunks one after another.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rfsense.llm.common import gather

CHUNKS, BYTES = 400_000, 32 << 20
"""Chunks, and bytes of them, that a Python worker keeps. A full table starts anew; results do not depend on it."""

Ragged = tuple[np.ndarray, np.ndarray]
"""Values of all chunks one after another, and how many each chunk has."""


def cut(texts: pa.Array, after_white: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The code of every chunk, the distinct chunks by code, and how many chunks each text has: none if null or empty.

    Without ``after_white`` no chunk begins right after white space of any kind, so that runs of it stay whole.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    full = pc.greater(pc.binary_length(texts), 0)
    spaced = pc.binary_join_element_wise(pc.if_else(full, " ", "").cast(pa.large_string()), texts, pa.scalar("", pa.large_string()))
    if not pc.any(full).as_py():
        return np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(len(texts), np.int64)
    ends = np.frombuffer(spaced.buffers()[1], np.int64, len(spaced) + 1, spaced.offset * 8)
    raw = np.frombuffer(spaced.buffers()[2], np.uint8)
    space = raw == 32
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    if not after_white:
        at = np.flatnonzero(begins)
        one, two, three = (np.where(at >= k, raw[at - k], 0) for k in (1, 2, 3))
        # White space beyond ASCII by the bytes it begins with, and more: a border less is never wrong.
        wide = (two == 0xC2) | (three == 0xE1) & np.isin(two, (0x9A, 0xA0)) | (three == 0xE2) & np.isin(two, (0x80, 0x81)) | (three == 0xE3) & (two == 0x80) | (three == 0xEF) & (two == 0xBB)
        begins[at[(one <= 32) | (one == 127) | (one >= 128) & wide]] = False
    begins[ends[:-1][np.diff(ends) > 0]] = True
    starts = np.flatnonzero(begins)
    bounds = np.append(starts, ends[-1]).astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds.tobytes()), spaced.buffers()[2]])
    coded = whole.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, np.diff(np.searchsorted(starts, ends))


LATIN = r"[!-&(-~À-ÿ]+"
"""Latin letters, digits and signs, without the apostrophe: patterns may join it with letters."""
_KIND = np.full(256, 2, np.uint8)  # signs
_KIND[ord("a"):ord("z") + 1] = _KIND[ord("A"):ord("Z") + 1] = 0
_KIND[ord("0"):ord("9") + 1] = 1


def runs(strings: pa.Array, digits_apart: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Strings of ``LATIN``, perhaps after one space, cut into runs of letters, digits and signs; a space goes with the run after it.

    The code of every run, the distinct runs by code, and how many runs each string has. ``digits_apart``: a digit is a run by itself.
    """
    strings = strings.cast(pa.large_string())
    ends = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, strings.offset * 8)
    raw = np.frombuffer(strings.buffers()[2], np.uint8)[:ends[-1]]
    kind = _KIND[raw]
    wide = np.flatnonzero(raw == 0xC3)  # the first byte of the letters beyond ASCII, and of two signs
    kind[wide] = kind[wide + 1] = np.where((raw[wide + 1] == 0x97) | (raw[wide + 1] == 0xB7), 2, 0)
    begins = np.ones(len(raw), bool)
    begins[1:] = kind[1:] != kind[:-1]
    if digits_apart:
        begins[1:] |= kind[1:] == 1
    begins[1:] &= raw[:-1] != 32
    begins[ends[:-1]] = True
    begins[:ends[0]] = False
    starts = np.flatnonzero(begins)
    bounds = np.append(starts, ends[-1]).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds.tobytes()), strings.buffers()[2]]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, np.diff(np.searchsorted(starts, ends))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over runs of so many values each."""
    upto = np.concatenate(([0], np.cumsum(values)))
    return np.diff(upto[np.concatenate(([0], np.cumsum(counts)))])


class ChunkTable:
    """What ``make`` gives for each distinct chunk: ragged columns, and one string."""

    def __init__(self, make: Callable[[list[str]], tuple[list[Ragged], list[str]]], chunks: int = CHUNKS):
        self.make, self.chunks = make, chunks
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.columns: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # flat, starts, lengths
        self.strings: list[str] = []

    def rows(self, distinct: pa.Array) -> np.ndarray:
        """The rows of distinct chunks; new ones are made, all at once."""
        at = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(self.known) and (len(self.known) + int((at < 0).sum()) > self.chunks or self.known.nbytes > BYTES):
            self.clear()
            at = np.full(len(distinct), -1)
        if len(new := distinct.filter(pa.array(at < 0))):
            at[at < 0] = len(self.known) + np.arange(len(new))
            ragged, strings = self.make(new.to_pylist())
            old = self.columns or [(flat[:0], n[:0], n[:0]) for flat, n in ragged]
            self.columns = [(np.concatenate([f, flat]), np.concatenate([s, len(f) + np.cumsum(n) - n]), np.concatenate([k, n]))
                            for (f, s, k), (flat, n) in zip(old, ragged, strict=True)]
            self.strings += strings
            self.known = pa.concat_arrays([self.known, new])
        return at

    def values(self, rows: np.ndarray, column: int = 0) -> Ragged:
        """A column's values for rows of the table, one after another."""
        flat, starts, lengths = self.columns[column]
        return gather(rows, starts, lengths, flat)


def ragged(lists: list[list[int]], kind: type = np.int64) -> Ragged:
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), kind, int(n.sum())), n


def pack(values: np.ndarray) -> bytes:
    """Small numbers in little room: the four bytes of each apart, compressed."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(values) else b""


def unpack(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(raw, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(n).astype(np.int64)
