"""Cross-tokenizer alignment against a walk over both token lists; minimal perfect hashing."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from rfsense.llm import alignment, chunks, perfect
from rfsense.llm.queries import BYTE_BPE_JSON, PIECES, QUERIES
from rfsense.llm.wordbpe import byte_characters
from tests.conftest import SF

ALPHABET = ["a", "b", " ", "  ", "▁", "\n", "\t", "é", "中", "\x00", "　", " ", "🙂", "<s>", "'s", "the", " of", "<|endoftext|>", "​", "x" * 40, "\x1c", "\x85", " 12"]


def by_hand(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTE_BPE_JSON), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    own = {c: i for i, c in enumerate(byte_characters())}
    out, seen = [], Counter()
    for doc, text in rows:
        raw = (" " + (text or "")).encode()
        ids_a, ids_b = a.encode(raw.decode(), add_special_tokens=False).ids, b.encode(text or "")
        bytes_a = [bytes(own[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            out.append((doc, None))
            continue
        ends_a, ends_b = np.cumsum(list(map(len, bytes_a))).tolist(), np.cumsum(list(map(len, bytes_b))).tolist()
        links, groups, i, j, at = [], [], 0, 0, (0, 0)
        while i < len(ids_a):
            links.append((ids_a[i], ids_b[j]))
            x, y = ends_a[i], ends_b[j]
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                groups.append(",".join(map(str, ids_a[at[0]:i])) + "|" + ",".join(map(str, ids_b[at[1]:j])))
                at = i, j
        seen.update(links)
        out.append((doc, (len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    most = Counter()
    for (_, second), n in seen.items():
        most[second] = max(most[second], n)
    return [(d, 0, 0, 0, 0, 0, 0, "") if x is None else (d, *x[:3], len(x[3]), sum(seen[p] == most[p[1]] for p in x[3]), sum(seen[p] for p in x[3]), x[4]) for d, x in out]


def same(got, rows):
    return sorted(map(tuple, got), key=str) == sorted(by_hand(rows), key=str)


def test_random_texts(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(25)))) for i in range(300)] + [(1000, ""), (1001, None), (1002, " "), (1002, " "), (None, "the end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert same(alignment.align(docs, BYTE_BPE_JSON, PIECES, 16).collect(), rows)


def test_odd_documents(odd, none):
    assert same(alignment.align(odd, BYTE_BPE_JSON, PIECES).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert alignment.align(none, BYTE_BPE_JSON, PIECES).count() == 0


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert same(QUERIES["op12_token_alignment"](spark, SF).collect(), rows)


@pytest.mark.parametrize("n", [0, 1, 2, 255, 20_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(-2**62, 2**62, n))
    sizes, bits = perfect.build(keys)
    assert sorted(perfect.slots(keys, sizes, bits).tolist()) == list(range(len(keys)))
    assert (perfect.slots(keys + 1, sizes, bits) < len(keys)).all()  # strangers get any slot or none


def test_packed_numbers():
    x = np.random.default_rng(0).integers(0, 2**31, 1000)
    assert (chunks.unpack(chunks.pack(x), len(x)) == x).all()
