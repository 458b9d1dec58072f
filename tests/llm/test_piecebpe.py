"""SentencePiece encoding by distinct marked words against the library on whole texts."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from rfsense.llm import piecebpe
from rfsense.llm.chunks import ChunkTable
from rfsense.llm.queries import PIECES, QUERIES
from tests.conftest import SF
from tests.llm.test_alignment import ALPHABET


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def digest(library, doc, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_documents(odd, none, library):
    rows = odd.collect()
    assert sorted(map(tuple, piecebpe.digests(odd, PIECES).collect()), key=str) == sorted((digest(library, r.doc_id, r.text) for r in rows), key=str)
    assert piecebpe.digests(none, PIECES).count() == piecebpe.encode(none, PIECES).count() == 0
    back = piecebpe.decode(piecebpe.encode(odd, PIECES), PIECES)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((r.doc_id, r.text or "") for r in rows), key=str)


def test_query(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sorted(map(tuple, QUERIES["op13_piece_bpe"](spark, SF).collect())) == sorted(digest(library, r.doc_id, r.text) for r in rows)


@pytest.mark.parametrize("kept", [400_000, 10])
def test_random_texts(library, kept):
    """Also with a table that starts anew all the time."""
    rng = random.Random(2)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["", None, " "]
    enc = piecebpe.PieceEncoder(PIECES)
    assert enc.by_words
    enc.table = ChunkTable(enc._segment, kept)
    for at in range(0, len(texts), 100):
        flat, n = enc.encode(pa.array(texts[at:at + 100]))
        assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [library.encode(t or "") for t in texts[at:at + 100]]


def test_whole_texts(library):
    """The way for models whose pieces cross markers gives the same for one whose do not."""
    enc = piecebpe.PieceEncoder(PIECES)
    enc.by_words = False
    flat, n = enc.encode(pa.array(["a b  c", None, ""]))
    assert flat.tolist() == library.encode("a b  c") and n.tolist() == [len(flat), 0, 0]
