"""Alignment of two tokenizers' tokens by the bytes they cover, with corpus-wide counts of linked id pairs.

Two tokens of a document are linked when their bytes overlap; where tokens of both end, they are cut into groups. Counts are
kept without a hash table of all pairs:

1. A first pass over the documents gives each slice's distinct id pairs with their number of links. The distinct pairs of all slices are dealt
   into shards of some hundred, and each shard gets a minimal perfect hash function and its keys by slot.
2. Each shard's counts are a dense vector indexed by the hash. Slices are dealt to leaves; every leaf sums its slices into a vector
   of its own, and the leaves' vectors are summed at the root, so no task adds up more than about the square root of all tasks.
3. A second pass aligns the documents again. The distinct pairs of a slice ask their shard, which verifies the key at the slot and answers with the
   count; the answers come back to the slice, where documents add them up by position.

Nothing is broadcast but the highest count of each id of the second vocabulary.

Both tokenizers work on chunks that begin with spaces: neither can tell one chunk from its neighbours there (see ``Aligner``), so tokens of both end at
every chunk's end, and a chunk is aligned once in a slice.
"""

from __future__ import annotations

import hashlib
import math
import os
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rfsense.llm import perfect
from rfsense.llm.chunks import LATIN, ChunkTable, Ragged, cut, pack, ragged, runs, sums, unpack
from rfsense.llm.common import arrow_map, gather, give_back, slices, texts_of
from rfsense.llm.vectors import dealt, groups
from rfsense.llm.wordbpe import byte_characters
from rfsense.session import materialise

MARK = "▁"
SLICE = 4 << 20
"""Bytes of text that are aligned together."""
TOGETHER = 4096
"""Chunks that go to the first tokenizer in one call."""
SHARD = 256
"""Distinct pairs of a shard, about."""

_BYTE = re.compile("<0x([0-9A-F]{2})>")


class Aligner:
    """Tokens of both tokenizers for chunks, and their links.

    The first is a byte-level BPE whose pattern begins a new match at each space after something else than white space; the second a
    SentencePiece model none of whose pieces goes on past a marker that begins a run, and which puts one marker before a text. So chunks that begin at
    such spaces have tokens of their own in both.
    """

    LINKS, TOKENS_A, TOKENS_B, GROUPS, SAME = range(5)

    def __init__(self, byte_path: str, piece_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.bare, self.mapped = Tokenizer(self.a.model), dict(enumerate(byte_characters()))
        own = {ord(c): b for b, c in self.mapped.items()}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[i] = bytes(own[ord(c)] for c in token)
        self.b = SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError(f"{piece_path}: pieces go on past markers")
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(MARK, " ").encode() for p in pieces]
        self.length_a, self.length_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.lone = self.b.piece_to_id(MARK)
        self.table, self.strings = ChunkTable(self._align), True
        # What an id adds to a group's string: another id of its side follows it, or none.
        self.pieces_a = [f"{i}{end}" for i in range(len(self.bytes_a)) for end in ",|"]
        pieces = [*self.pieces_a, *(f"{i}{end}" for i in range(len(self.bytes_b)) for end in ",;")]
        self.pieces, self.piece_lengths = np.array(pieces, object), np.fromiter(map(len, pieces), np.int64, len(pieces))

    def _align(self, chunks: list[str]) -> tuple[list[Ragged], list[str]]:
        """For each chunk its linked pairs in order, how many tokens and groups it has, whether both give its bytes, and its groups as a string."""
        flat_a, n_a = self._first(pa.array(chunks, pa.large_string()))
        ids_b = self.b.encode([c[1:] for c in chunks], num_threads=1)
        for i in (i for i, c in enumerate(chunks) if c == " "):
            ids_b[i] = [self.lone]
        flat_b, n_b = ragged(ids_b)
        raw = "".join(chunks).encode()
        same = np.ones(len(chunks), bool)
        if not raw == b"".join([self.bytes_a[i] for i in flat_a.tolist()]) == b"".join([self.bytes_b[i] for i in flat_b.tolist()]):
            same = np.fromiter((b"".join([self.bytes_a[i] for i in x]) == c.encode() == b"".join([self.bytes_b[i] for i in y])
                                for c, x, y in zip(chunks, np.split(flat_a, np.cumsum(n_a)[:-1]), ids_b, strict=True)), bool, len(chunks))
            # Chunks whose bytes differ have no tokens here; the documents that hold them have none.
            flat_a, flat_b, n_a, n_b = flat_a[np.repeat(same, n_a)], flat_b[np.repeat(same, n_b)], n_a * same, n_b * same
        ends_a, ends_b = np.cumsum(self.length_a[flat_a]), np.cumsum(self.length_b[flat_b])
        total = int(ends_a[-1]) if len(ends_a) else 0
        at_a, at_b = np.zeros(total + 1, np.int64), np.zeros(total + 1, np.int64)
        at_a[ends_a] = at_b[ends_b] = 1
        # Between two ends that follow each other lies one token of each: a link.
        is_link, is_group = at_a | at_b, at_a & at_b
        ends = np.flatnonzero(is_link)
        upto_a, upto_b = np.cumsum(at_a), np.cumsum(at_b)
        pairs = flat_a[upto_a[ends] - at_a[ends]] << 32 | flat_b[upto_b[ends] - at_b[ends]]
        chunk_ends = np.concatenate(([0], ends_a))[np.cumsum(n_a)]
        n_links, n_groups = (np.diff(np.cumsum(x)[chunk_ends], prepend=0) for x in (is_link, is_group))
        strings = self._strings(flat_a, flat_b, is_group[ends_a] == 1, is_group[ends_b] == 1, n_a, n_b) if self.strings else [""] * len(chunks)
        one = np.ones(len(chunks), np.int64)
        return [(pairs, n_links), (n_a, one), (n_b, one), (n_groups, one), (same.astype(np.int64), one)], strings

    def _first(self, chunks: pa.Array) -> Ragged:
        """Ids of the first tokenizer. Its pattern cuts Latin chunks where letters, digits and signs meet: their distinct runs go to the model in one call.
        All others go through the whole pipeline."""
        plain = pc.match_substring_regex(chunks, f"^ {LATIN}$")
        codes, parts, counts = runs(chunks.filter(plain), False)
        ascii_ = pc.string_is_ascii(parts)
        mapped = pc.replace_substring(parts, " ", self.mapped[32]).to_pylist()
        wide = np.flatnonzero(~ascii_.to_numpy(zero_copy_only=False)).tolist()
        for i, p in zip(wide, parts.filter(pc.invert(ascii_)).to_pylist(), strict=True):
            mapped[i] = p.encode().decode("latin-1").translate(self.mapped)
        ids = np.array(self.bare.encode_batch_fast([mapped], is_pretokenized=True, add_special_tokens=False)[0].ids if mapped else [], np.int64)
        n = np.diff(np.searchsorted(np.cumsum(self.length_a[ids]), np.cumsum(pc.binary_length(parts).to_numpy(zero_copy_only=False))) + 1, prepend=0)
        flat, each = gather(codes, np.cumsum(n) - n, n, ids)
        others = chunks.filter(pc.invert(plain)).to_pylist()
        rest: list[list[int]] = []
        for at in range(0, len(others), TOGETHER):
            rest += [e.ids for e in self.a.encode_batch_fast(others[at:at + TOGETHER], add_special_tokens=False)]
        flat_rest, n_rest = ragged(rest)
        own = plain.to_numpy(zero_copy_only=False)
        size, start = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        size[own], size[~own] = sums(each, counts), n_rest
        start[own], start[~own] = np.cumsum(size[own]) - size[own], len(flat) + np.cumsum(n_rest) - n_rest
        return gather(np.arange(len(chunks)), start, size, np.concatenate([flat, flat_rest]))

    def _strings(self, flat_a: np.ndarray, flat_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
        """The groups of each chunk: ids of the first side joined by commas, a bar, ids of the second, a semicolon between groups."""
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before_b, before_a = np.searchsorted(group_b, group_a), np.searchsorted(group_a, group_b, side="right")
        which = np.empty(len(flat_a) + len(flat_b), np.int64)
        which[np.arange(len(flat_a)) + before_b] = flat_a * 2 + last_a
        which[np.arange(len(flat_b)) + before_a] = len(self.pieces_a) + flat_b * 2 + last_b
        whole = "".join(self.pieces[which].tolist())
        ends = np.concatenate(([0], np.cumsum(self.piece_lengths[which])))[np.cumsum(n_a + n_b)].tolist()
        return [whole[a:b - 1] if b > a else "" for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the table for the chunks of all texts one after another; how many each text has; which texts have tokens. Those without
        have no chunks."""
        codes, distinct, counts = cut(texts, after_white=False)
        rows = self.table.rows(distinct)[codes] if len(codes) else codes
        owner = np.repeat(np.arange(len(counts)), counts)
        # A chunk comes back shorter where a marker of its own turns into a space, and so does its document.
        other = np.bincount(owner, self.values(rows, self.SAME) == 0, len(counts)) > 0 if len(rows) else np.zeros(len(counts), bool)
        fine = (counts > 0) & ~other
        return rows[fine[owner]], counts * fine, fine

    def values(self, rows: np.ndarray, column: int) -> np.ndarray:
        return self.table.columns[column][0][rows] if len(rows) else np.zeros(0, np.int64)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(byte_path: str, piece_path: str, strings: bool) -> Aligner:
    """One per Python worker; ``strings``: whether groups are wanted as strings, too."""
    if (byte_path, piece_path) not in _aligners:
        _aligners[byte_path, piece_path] = Aligner(byte_path, piece_path)
    own = _aligners[byte_path, piece_path]
    own.table.clear()  # a task before may have ended early
    own.strings = strings
    return own


_COUNTED = pa.schema([("task", pa.int32()), ("pair", pa.int64()), ("n", pa.int64())])


def _counted(byte_path: str, piece_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, both = TaskContext.get().partitionId(), aligner(byte_path, piece_path, False)
        for part in slices(batches, size=SLICE):
            rows, _, _ = both.documents(part.column("text"))
            if len(rows):
                chunks, times = np.unique(rows, return_counts=True)
                links, n = both.table.values(chunks, both.LINKS)
                pairs, at = np.unique(links, return_inverse=True)
                number = np.bincount(at, np.repeat(times, n), len(pairs)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), task), pa.int32()), pa.array(pairs), pa.array(number)], schema=_COUNTED)
        both.table.clear()
        give_back()

    return arrow_map(run, _COUNTED)


# Arrays of a shard or slice go as bytes: rows beside them are many, and each null array costs time.
_FUNCTION = pa.schema([("shard", pa.int64()), ("function", pa.binary()), ("keys", pa.binary())])


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shard from its keys, which come sorted by shard."""
    held: list[np.ndarray] = []
    last = None

    def close() -> pa.RecordBatch:
        keys = np.concatenate(held)
        sizes, bits = perfect.build(keys)
        by_slot = np.empty(len(keys), np.int64)
        by_slot[perfect.slots(keys, sizes, bits)] = keys
        row = [last], [pickle.dumps((sizes, bits, len(keys)))], [by_slot.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _FUNCTION, strict=True)], schema=_FUNCTION)

    for key, part, new in groups(batches, ["shard"]):
        if new and held:
            yield close()
            held.clear()
        last = int(key[0])
        held.append(part.column("pair").to_numpy())
    if held:
        yield close()


_VECTOR = pa.schema([("shard", pa.int64()), ("counts", pa.binary())])


def _vector(shard: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], schema=_VECTOR)


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The dense vector of each shard and leaf: the function comes first, then pairs with numbers of links."""
    sizes = bits = counts = last = None
    for key, part, new in groups(batches, ["shard", "leaf"]):
        if new:
            if counts is not None:
                yield _vector(last, counts)
            sizes, bits, n = pickle.loads(part.column("function")[0].as_py())
            counts, last, part = np.zeros(n, np.int64), int(key[0]), part.slice(1)
        if part.num_rows:
            np.add.at(counts, perfect.slots(part.column("pair").to_numpy(zero_copy_only=False).astype(np.int64), sizes, bits), part.column("n").to_numpy(zero_copy_only=False).astype(np.int64))
    if counts is not None:
        yield _vector(last, counts)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of all leaves' vectors of a shard."""
    total = last = None
    for key, part, new in groups(batches, ["shard"]):
        if new and total is not None:
            yield _vector(last, total)
            total = None
        for raw in part.column("counts").to_pylist():
            own = np.frombuffer(raw, "<i8")
            total = own if total is None else total + own
        last = int(key[0])
    if total is not None:
        yield _vector(last, total)


_MOST = pa.schema([("second", pa.int64()), ("most", pa.int64())])


def _highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The highest count of each second id in some shards."""
    for batch in batches:
        if batch.num_rows:
            keys, counts = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<i8") for c in ("keys", "counts"))
            second, at = np.unique(keys & 0xFFFFFFFF, return_inverse=True)
            most = np.zeros(len(second), np.int64)
            np.maximum.at(most, at, counts)
            yield pa.RecordBatch.from_arrays([pa.array(second), pa.array(most)], schema=_MOST)


def pair_counts(docs: DataFrame, byte_path: str, piece_path: str, shard: int = SHARD) -> DataFrame:
    """The index of all linked id pairs, one row per ``shard`` of ``shards``: its hash ``function``, and by slot ``keys`` (first id << 32 | second
    id) and ``counts``, as bytes of 64-bit integers. Without tokens it has no row."""
    seen = materialise(texts_of(docs).select("text").mapInArrow(_counted(byte_path, piece_path), "task int, pair long, n long"), "pairs")
    about = seen.agg(F.approx_count_distinct("pair").alias("pairs"), F.countDistinct("task").alias("tasks")).first()
    shards, leaves = max(1, -(-about["pairs"] // shard)), max(1, math.isqrt(about["tasks"]))
    seen = seen.withColumn("shard", F.pmod(F.xxhash64("pair"), F.lit(shards)))
    functions = dealt(seen.select("shard", "pair").distinct(), ["shard"]).mapInArrow(arrow_map(_functions, _FUNCTION), "shard long, function binary, keys binary")
    functions = materialise(functions, "functions")
    nothing = {"pair": F.lit(None).cast("long"), "n": F.lit(None).cast("long")}
    heads = functions.select("shard", F.explode(F.sequence(F.lit(0), F.lit(leaves - 1))).alias("leaf"), F.lit(0).alias("kind"), "function").withColumns(nothing)
    rows = seen.select("shard", F.pmod("task", F.lit(leaves)).cast("int").alias("leaf"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("function"), "pair", "n")
    vectors = dealt(heads.unionByName(rows), ["shard", "leaf"], "kind").mapInArrow(arrow_map(_leaves, _VECTOR), "shard long, counts binary")
    sums = dealt(vectors, ["shard"]).mapInArrow(arrow_map(_roots, _VECTOR), "shard long, counts binary")
    return materialise(functions.join(sums, "shard").withColumn("shards", F.lit(shards)), "index")


_SLICED = pa.schema([("slice", pa.int64()), ("code", pa.int64()), ("pair", pa.int64()), ("docs", pa.binary())])
_SLICED_DDL = "slice long, code long, pair long, docs binary"


def _aligned(byte_path: str, piece_path: str):
    """For each slice of documents one row with all but the counts (``code`` -1), and a row for each distinct pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, number = aligner(byte_path, piece_path, True), TaskContext.get().partitionId() << 32
        for part in slices(batches, size=SLICE):
            rows, counts, fine = both.documents(part.column("text"))
            strings = both.table.strings
            sha, at = [], 0
            for n, some in zip(counts.tolist(), fine.tolist(), strict=True):
                sha.append(hashlib.sha256(";".join([strings[r] for r in rows[at:at + n].tolist()]).encode()).hexdigest() if some else "")
                at += n
            n_a, n_b, n_groups = (sums(both.values(rows, c), counts) for c in (both.TOKENS_A, both.TOKENS_B, both.GROUPS))
            distinct, codes = np.unique(rows, return_inverse=True)
            links, links_of = both.table.values(distinct, both.LINKS) if len(distinct) else (np.zeros(0, np.int64),) * 2
            n_links = sums(links_of[codes] if len(codes) else links_of, counts)
            pairs, link = np.unique(links, return_inverse=True)
            docs = pickle.dumps((part.column("doc_id").to_pylist(), counts, n_a, n_b, n_groups, n_links, sha, pack(codes), len(codes), pack(link), len(link), pack(links_of), len(links_of)))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([-1]), pa.nulls(1, pa.int64()), pa.array([docs], pa.binary())], schema=_SLICED)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), number)), pa.array(np.arange(len(pairs))), pa.array(pairs), pa.nulls(len(pairs), pa.binary())], schema=_SLICED)
            number += 1
        both.table.clear()
        give_back()

    return arrow_map(run, _SLICED)


_ANSWER = pa.schema([("slice", pa.int64()), ("code", pa.int64()), ("count", pa.int64()), ("second", pa.int64())])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts for the pairs that slices ask for; the shard's row comes first."""
    sizes = bits = keys = counts = None
    for _, part, new in groups(batches, ["shard"]):
        if new:
            sizes, bits, _ = pickle.loads(part.column("function")[0].as_py())
            keys, counts = (np.frombuffer(part.column(c)[0].as_py(), "<i8") for c in ("keys", "counts"))
            part = part.slice(1)
        if part.num_rows:
            pairs = part.column("pair").to_numpy(zero_copy_only=False).astype(np.int64)
            slot = perfect.slots(pairs, sizes, bits)
            if (slot < 0).any() or (keys[slot] != pairs).any():
                raise ValueError("the second pass met a pair that the first did not count")
            yield pa.RecordBatch.from_arrays([part.column("slice"), part.column("code"), pa.array(counts[slot]), pa.array(pairs & 0xFFFFFFFF)], schema=_ANSWER)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                    ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])
_RESULT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _together(highest: np.ndarray):
    """Documents of a slice from its row, which comes first, and its answers by code."""

    def close(docs: bytes, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        count, second = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in held]).astype(np.int64) if held else np.zeros(0, np.int64) for c in ("count", "second"))
        ids, n_chunks, n_a, n_b, n_groups, n_links, sha, codes, n_codes, link, n_link, links_of, n_of = pickle.loads(docs)
        codes, link, links_of = unpack(codes, n_codes), unpack(link, n_link), unpack(links_of, n_of)
        best = (count == highest[second]).astype(np.int64)
        n_best, total = (sums(sums(x[link], links_of)[codes] if n_codes else codes, n_chunks) for x in (best, count))
        columns = [ids, n_a, n_b, n_groups, n_links, n_best, total, sha]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RESULT, strict=True)], schema=RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, held = None, []
        for _, part, new in groups(batches, ["slice"]):
            if new:
                if docs is not None:
                    yield close(docs, held)
                docs, held, part = part.column("docs")[0].as_py(), [], part.slice(1)
            if part.num_rows:
                held.append(part.select(["count", "second"]))
        if docs is not None:
            yield close(docs, held)
        give_back()

    return arrow_map(run, RESULT)


def align(docs: DataFrame, byte_path: str, piece_path: str, shard: int = SHARD) -> DataFrame:
    """One row per document: its tokens, groups, links, how many links are their second id's most frequent ones, the sum of its links' counts over the
    corpus, and a digest of its groups.

    Texts that are null or empty, or that hold the marker of the second tokenizer, whose bytes it does not give back, have no tokens: zeros and an empty
    digest. Each row stands for itself: repeated rows count and come back as often, a null id stays null, extra columns are left out. An empty table gives no row.
    """
    index = pair_counts(docs, byte_path, piece_path, shard)
    own = index.select("keys", "counts").mapInArrow(arrow_map(_highest, _MOST), "second long, most long")
    highest = own.groupBy("second").agg(F.max("most").alias("most")).collect()  # a row per id of a vocabulary
    most = np.zeros(1 + max((r["second"] for r in highest), default=0), np.int64)
    for r in highest:
        most[r["second"]] = r["most"]
    shards = index.agg(F.max("shards")).first()[0] or 1
    about = materialise(texts_of(docs).mapInArrow(_aligned(byte_path, piece_path), _SLICED_DDL), "aligned")
    asks = about.where("code >= 0").select(F.pmod(F.xxhash64("pair"), F.lit(shards)).alias("shard"), F.lit(1).alias("kind"), "slice", "code", "pair")
    empty = {c: F.lit(None).cast("binary") for c in ("function", "keys", "counts")}
    tables = index.select("shard", F.lit(0).alias("kind"), "function", "keys", "counts").withColumns({c: F.lit(None).cast("long") for c in ("slice", "code", "pair")})
    answers = dealt(tables.unionByName(asks.withColumns(empty)), ["shard"], "kind").mapInArrow(arrow_map(_answers, _ANSWER), "slice long, code long, count long, second long")
    whole = about.where("code < 0").drop("pair").withColumns({c: F.lit(None).cast("long") for c in ("count", "second")})
    answers = answers.withColumn("docs", F.lit(None).cast("binary"))
    return dealt(whole.unionByName(answers), ["slice"], "code").mapInArrow(_together(most), _RESULT_DDL)
