"""SentencePiece encoding and decoding by a table of distinct marked words.

No piece of the model goes on past a marker that begins a run of markers (checked when the model is loaded), and it leaves texts as they are
but for one marker put before them. So a text's pieces are those of its marked words one after another: each distinct
marked word of a slice of documents that a worker's table does not hold yet is segmented by the sentencepiece library, once, and the ids come back by the place of
the word. Nothing is shuffled. Models whose pieces do cross markers, or which rewrite texts, take each whole text as one chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rfsense.llm.chunks import ChunkTable, Ragged, cut, ragged
from rfsense.llm.common import arrow_map, give_back, slices, texts_of

MARK = "▁"
SLICE = 8 << 20
"""Bytes of text whose marked words are looked up together."""


class PieceEncoder:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.begin, self.end = self.model.bos_id(), self.model.eos_id()
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = "a  b\n \u00e9\ufb01 \u3000\x00 "  # comes back as it is only from a model that rewrites nothing
        kept = self.model.decode(self.model.encode(probe)) == probe
        self.by_words = kept and not any(MARK in p.lstrip(MARK) for p in pieces) and self.model.encode("a b") == self.model.encode("a") + self.model.encode("b")
        self.table = ChunkTable(self._segment)

    def _segment(self, chunks: list[str]) -> tuple[list[Ragged], list[str]]:
        ids = self.model.encode([c[1:] for c in chunks], num_threads=1)  # the library puts the first marker before them itself
        for i in (i for i, c in enumerate(chunks) if c == " "):  # but not before nothing
            ids[i] = [self.model.piece_to_id(MARK)]
        return [ragged(ids, np.int32)], []

    def encode(self, texts: pa.Array) -> Ragged:
        """Ids of all texts one after another, without begin and end, and how many each has; null counts as empty."""
        if not self.by_words:
            return ragged(self.model.encode(pc.fill_null(texts, "").to_pylist(), num_threads=1), np.int32)
        # A marker within a text is to the model what a space is.
        codes, distinct, counts = cut(pc.replace_substring(pc.fill_null(texts, ""), MARK, " "))
        flat, n = self.table.values(self.table.rows(distinct)[codes]) if len(codes) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        upto = np.concatenate(([0], np.cumsum(n)))
        ends = np.concatenate(([0], np.cumsum(counts)))
        return flat, np.diff(upto[ends])

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.model.decode(ids, num_threads=1) if ids else []


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One per Python worker: the model is read once."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _framed(enc: PieceEncoder, texts: pa.Array, ends: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids with begin and end, and where each text's end."""
    flat, n = enc.encode(texts)
    if not ends:
        return flat, np.cumsum(n)
    to = np.cumsum(n + 2)
    out = np.empty(len(flat) + 2 * len(n), np.int32)
    out[to - n - 2], out[to - 1] = enc.begin, enc.end
    inner = np.ones(len(out), bool)
    inner[to - n - 2] = inner[to - 1] = False
    out[inner] = flat
    return out, to


IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
TEXT = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(docs: DataFrame, path: str, ends: bool = True) -> DataFrame:
    """``doc_id`` and ``ids`` of every whole text, with begin and end ids unless told otherwise.

    A null text is empty: begin and end alone. Each row stands for itself, so repeated rows, null ids and extra columns change nothing; an empty table gives
    no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for part in slices(batches, size=SLICE):
            flat, to = _framed(enc, part.column("text"), ends)
            bounds = pa.array(np.concatenate(([0], to)), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(bounds, pa.array(flat, pa.int32()))], schema=IDS)

    return texts_of(docs).mapInArrow(arrow_map(run, IDS), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and the ``text`` that the library's decode gives for ``ids``; null or no ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = enc.decode([x or [] for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], schema=TEXT)

    return encoded.select("doc_id", "ids").mapInArrow(arrow_map(run, TEXT), "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode every whole text with begin and end and decode the ids again; the number of ids and digests of both.

    Rows as in ``encode``: null texts are empty, each row stands for itself, extra columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for part in slices(batches, size=SLICE):
            flat, to = _framed(enc, part.column("text"), True)
            starts = np.concatenate(([0], to[:-1]))
            raw = flat.astype("<u4").tobytes()
            ids_sha = [hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(starts.tolist(), to.tolist(), strict=True)]
            text_sha: list[str] = []
            for at in range(0, len(to), 256):  # Python numbers of few texts at a time
                own = [flat[a:b].tolist() for a, b in zip(starts[at:at + 256].tolist(), to[at:at + 256].tolist(), strict=True)]
                text_sha += [hashlib.sha256(t.encode()).hexdigest() for t in enc.decode(own)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(to - starts, pa.int64()), pa.array(ids_sha, pa.string()),
                                              pa.array(text_sha, pa.string())], schema=DIGEST)
        encoder(path).table.clear()
        give_back()

    return texts_of(docs).mapInArrow(arrow_map(run, DIGEST), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
