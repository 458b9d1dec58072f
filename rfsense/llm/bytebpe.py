"""Byte-level BPE with the tokenizers library: encoding with offsets, and decoding back to bytes.

The rank file is turned into a tokenizers model: bytes become the characters of byte-level files, and every way to put a
token together from two others becomes a merge, in order of the token's rank. Text is cut before each space; these units are
cut by the pattern, and each match is encoded on its own. Distinct units are looked up in a cache.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rfsense.llm.common import arrow_map, gather, slices, texts_of
from rfsense.llm.wordbpe import byte_characters

CACHE_UNITS = 300_000

# A space after other white space: the pattern may then join white space over a cut before a space.
_JOINED = r"[\s\p{Z}\x{85}\x0b\x1c-\x1f] |\x00"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteEncoder:
    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        ranks = load_ranks(path)
        self.characters = dict(enumerate(byte_characters()))
        name = {t: t.decode("latin-1").translate(self.characters) for t in ranks}
        merges = [(name[t[:i]], name[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.model = Tokenizer(BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)).model
        self.bytes: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.bytes[r] = t
        self.decimal = [str(i) for i in range(len(self.bytes))]
        self.pattern = regex.compile(pattern)
        self._clear()

    def _clear(self) -> None:
        self.matches: dict[str, list[int]] = {}
        self.known = pa.array([], pa.string())
        self.starts = self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def match(self, match: str) -> list[int]:
        if (ids := self.matches.get(match)) is None:
            if len(self.matches) >= CACHE_UNITS // 2:
                self.matches.clear()
            mapped = match.encode().decode("latin-1").translate(self.characters)
            ids = [t.id for t in self.model.tokenize(mapped)]
            if len(match) < 64:
                self.matches[match] = ids
        return ids

    def text(self, text: str) -> list[int]:
        return [i for m in self.pattern.findall(text) for i in self.match(m)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has; null counts as empty."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _JOINED).to_numpy(zero_copy_only=False)
        if whole.any():  # these go through the pattern in one piece each
            own = {int(i): np.array(self.text(texts[int(i)].as_py()), np.uint32) for i in np.flatnonzero(whole)}
            texts = pc.if_else(pa.array(whole), "", texts)
        split = pc.split_pattern(pc.replace_substring(texts, " ", "\x00 "), "\x00")
        ends = np.asarray(split.offsets)
        coded = split.flatten().dictionary_encode()
        codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        at = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(self.known) + int((at < 0).sum()) > CACHE_UNITS and len(self.known):
            self._clear()
            at = np.full(len(distinct), -1)
        if len(new := distinct.filter(pa.array(at < 0))):
            at[at < 0] = len(self.known) + np.arange(len(new))
            ids = [self.text(u) for u in new.to_pylist()]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.lengths = np.concatenate([self.lengths, sizes])
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))])
            self.known = pa.concat_arrays([self.known, new.cast(pa.string())])
        flat, n = gather(at[codes], self.starts, self.lengths, self.flat)
        upto = np.concatenate(([0], np.cumsum(n)))[ends - ends[0]]
        if not whole.any():
            return flat, np.diff(upto)
        each = [own[i] if whole[i] else flat[upto[i]:upto[i + 1]] for i in range(len(texts))]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def offsets(self, ids: np.ndarray, text: str) -> list[tuple[int, int]]:
        """For each id the code points that its bytes touch, end exclusive; a split character belongs to all its ids."""
        raw = np.frombuffer(text.encode(), np.uint8)
        point = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum([len(self.bytes[i]) for i in ids])
        return [(int(point[b - len(self.bytes[i])]), int(point[b - 1]) + 1) for i, b in zip(ids, ends.tolist(), strict=True)]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids; characters split over several ids come together again."""
        return b"".join([self.bytes[i] for i in ids])


_encoders: dict[tuple[str, str], ByteEncoder] = {}


def encoder(path: str, pattern: str) -> ByteEncoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = ByteEncoder(path, pattern)
    return _encoders[path, pattern]


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` and for each id the code points it covers (``begins``, ``ends``); a null text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for cut in slices(batches):
            ids, counts = enc.encode(cut.column("text"))
            own = np.split(ids, np.cumsum(counts)[:-1])
            spans = [enc.offsets(x.tolist(), t) for x, t in zip(own, cut.column("text").to_pylist(), strict=True)]
            columns = [cut.column("doc_id"), own, [[a for a, _ in s] for s in spans], [[b for _, b in s] for s in spans]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, IDS, strict=True)], schema=IDS)

    return texts_of(docs).mapInArrow(arrow_map(run, IDS), "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``raw``: the bytes of ``ids``; null or no ids give no bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("raw", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            raw = [enc.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(arrow_map(run, schema), "doc_id long, raw binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every whole text and decode the ids again; digests of both.

    Null and empty texts have no ids and the digests of nothing. Each row stands for itself, so repeated rows and extra columns
    change nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for cut in slices(batches):
            flat, counts = enc.encode(cut.column("text"))
            at, ids_sha, raw_sha = 0, [], []
            for n in counts.tolist():
                ids = flat[at:at + n].tolist()
                at += n
                ids_sha.append(hashlib.sha256(",".join([enc.decimal[i] for i in ids]).encode()).hexdigest())
                raw_sha.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([cut.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                                              pa.array(raw_sha, pa.string())], schema=DIGEST)

    return texts_of(docs).mapInArrow(arrow_map(run, DIGEST), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
