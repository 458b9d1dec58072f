"""Tokenisation, packing, bit packing and byte BPE against the libraries called on whole texts."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from rfsense.llm import bitpack, bytebpe, packing
from rfsense.llm.queries import BYTE_BPE, QUERIES, WORD_BPE, WORD_IDS
from rfsense.llm.wordbpe import WordEncoder
from rfsense.session import workdir
from tests.conftest import SF
from tests.llm.conftest import ROWS, text_of

ALPHABET = "aAbBzZ .,'’sStTdD09\n\t éÉßẞİıΣσς×÷ÿŸ́e\u0085  中あЖж한ª²½<|>‍🙂\x00\x1c_-"


def library(path=WORD_BPE):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tiktoken_library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.load_ranks(BYTE_BPE), special_tokens={})


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)] + [text_of(r) for r in ROWS]


def test_words_one_by_one_are_the_whole_text(monkeypatch):
    monkeypatch.setattr("rfsense.llm.wordbpe.CACHE_WORDS", 5_000)
    texts, own, lib = random_texts(3000), WordEncoder(WORD_BPE), library()
    for at in range(0, len(texts), 500):
        ids, counts = own.encode(pa.array(texts[at:at + 500]))
        for text, got in zip(texts[at:at + 500], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert got.tolist() == lib.encode(text, add_special_tokens=False).ids


def test_byte_bpe_is_the_rank_library(monkeypatch):
    monkeypatch.setattr(bytebpe, "CACHE_UNITS", 5_000)
    rng = random.Random(2)
    texts = random_texts(3000, 3) + ["".join(rng.choice(x) for _ in range(rng.randint(0, 30))) for x in ("ab", "-=", "aaa ", "...", " \n", "的一") for _ in range(300)]
    own, lib = bytebpe.ByteEncoder(BYTE_BPE, public_tokenizers.PATTERN), tiktoken_library()
    for at in range(0, len(texts), 500):
        ids, counts = own.encode(pa.array(texts[at:at + 500]))
        for text, got in zip(texts[at:at + 500], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert got.tolist() == lib.encode_ordinary(text)
            assert own.decode(got.tolist()) == text.encode()


def test_offsets_cover_split_characters():
    own = bytebpe.ByteEncoder(BYTE_BPE, public_tokenizers.PATTERN)
    text = "aé🙂‍🙂 한ẞ"
    ids = own.text(text)
    spans = own.offsets(ids, text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), i in zip(spans, ids, strict=True):
        assert own.bytes[i] in text[a:b].encode()
    assert any(x[0] < y[1] and y[0] < x[1] for x, y in zip(spans, spans[1:], strict=False))  # a character over two ids


def byte_rows(rows):
    lib = tiktoken_library()
    for r in rows:
        ids = lib.encode_ordinary(text_of(r))
        yield r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text_of(r).encode()).hexdigest()


def test_byte_digests(spark, odd, none, table):
    pattern = public_tokenizers.PATTERN
    got = [tuple(r) for r in bytebpe.digests(odd, BYTE_BPE, pattern).collect()]
    assert sorted(got, key=str) == sorted(byte_rows(ROWS), key=str)
    assert bytebpe.digests(none, BYTE_BPE, pattern).count() == 0
    docs = [(r.doc_id, r.text) for r in table("documents").collect()]
    assert sorted(map(tuple, QUERIES["op4_byte_bpe"](spark, SF).collect())) == sorted(byte_rows(docs))


def test_byte_round_trip(odd):
    pattern = public_tokenizers.PATTERN
    enc = bytebpe.encode(odd, BYTE_BPE, pattern)
    raw = bytebpe.decode(enc, BYTE_BPE, pattern).collect()
    assert sorted(((r.doc_id, bytes(r.raw).decode()) for r in raw), key=str) == sorted(((r[0], text_of(r)) for r in ROWS), key=str)


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 31, 32])
def test_bits(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    packed = bitpack.pack_bits(ids, bits)
    assert len(packed) == -(-1001 * bits // 8)
    for first, n in ((0, 1001), (7, 0), (13, 500), (1000, 1)):
        assert bitpack.unpack_bits(packed, bits, first, n).tolist() == ids[first:first + n].tolist()
    assert bitpack.unpack_bits(bitpack.pack_bits(ids[:0], bits), bits, 0, 0).tolist() == []
    assert [bitpack.width(v) for v in (1, 2, 3, 49_408, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def file_rows(rows):
    lib, at = library(), 0
    for doc, text in sorted(((r[0], text_of(r)) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*lib.encode(text, add_special_tokens=False).ids, 1]
        yield doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_token_files(spark, odd, none, table):
    for vocabulary, block in ((WORD_IDS, 50), (1 << 19, 1 << 18)):
        target = workdir(spark, "blocks")
        bitpack.write(odd, WORD_BPE, vocabulary, 1, target, block)
        assert sorted(map(tuple, bitpack.read_documents(spark, target).collect()), key=str) == sorted(file_rows(ROWS), key=str)
        whole = [i for _, _, ids in sorted((r.start, r.doc_id or -1, r.ids) for r in bitpack.read_documents(spark, target, True).collect()) for i in ids]
        for first, n in ((0, 1), (7, 500), (len(whole) - 3, 10), (len(whole), 5), (0, len(whole))):
            assert [i for _, ids in sorted(map(tuple, bitpack.read_ids(spark, target, first, n).collect())) for i in ids] == whole[first:first + n]
        for doc in (3, 5, 999):
            own = sorted((r.start, r.ids) for r in bitpack.read_documents(spark, target, True).where(f"doc_id = {doc}").collect())
            assert sorted(map(tuple, bitpack.read_document(spark, target, doc).collect())) == own
    target = workdir(spark, "blocks")
    bitpack.write(none, WORD_BPE, WORD_IDS, 1, target)
    assert bitpack.read_documents(spark, target).count() == 0
    docs = [(r.doc_id, r.text) for r in table("documents").collect()]
    assert sorted(map(tuple, QUERIES["op9_bitpack"](spark, SF).collect())) == sorted(file_rows(docs))


def check_plan(counts, capacity):
    rows, made = packing.plan(counts, capacity)
    seq = defaultdict(list)
    ranks = defaultdict(list)
    for length, rank, n, first, each, offset in rows:
        for k in range(n):
            seq[first + k // each].append((offset + k % each * length, length))
        ranks[length] += range(rank, rank + n)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in counts.items() if v}
    assert sorted(seq) == list(range(made))
    for places in seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return made


def best_by_hand(counts, capacity):
    """One piece after another, longest first, into the fullest sequence with room."""
    rooms = []
    for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= length]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= length
        else:
            rooms.append(capacity - length)
    return len(rooms)


def test_plan():
    rng = random.Random(5)
    for _ in range(300):
        capacity = rng.choice([7, 30, 100])
        counts = {k: rng.choice([0, 1, 2, 5, 40]) for k in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
        made = check_plan(counts, capacity)
        assert made >= -(-sum(k * v for k, v in counts.items()) // capacity)
        assert made <= best_by_hand(counts, capacity) * 1.03 + 1
    assert check_plan({10: 1_000_000 // 1000}, 10) == 1000
    assert packing.plan({}, 10) == ([], 0)


def check_packing(got, rows, capacity):
    lib, want = library(), []
    for r in rows:
        ids = [*lib.encode(text_of(r), add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at:at + capacity]
            want.append((r[0], k, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    assert sorted(((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got), key=str) == sorted(want, key=str)
    seq = defaultdict(list)
    for g in got:
        seq[g.sequence_id].append((g.offset, g.length))
    for places in seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seq), -(-sum(w[3] for w in want) // capacity)


def test_packing(spark, odd, none, table):
    check_packing(packing.packed(odd, WORD_BPE, 100).collect(), ROWS, 100)
    assert packing.packed(none, WORD_BPE).count() == 0
    docs = [(r.doc_id, r.text) for r in table("documents").collect()]
    made, least = check_packing(QUERIES["op2_packing"](spark, SF).collect(), docs, 2048)
    assert made <= least + 2


def test_packing_gives_the_ids(odd):
    got = packing.packed(odd, WORD_BPE, 100, with_ids=True).where("doc_id = 0").collect()
    assert got[0].ids == [*library().encode(ROWS[0][1], add_special_tokens=False).ids, 0]
