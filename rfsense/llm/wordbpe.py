"""Token ids of whole texts by a word BPE file of the tokenizers library, one library call per distinct part of a word.

The file's pattern never joins characters over white space, and its normaliser works within words, so the ids of a
text are the ids of its words one after another. Words are found by Arrow, and distinct words are looked up in a cache. New ones of
Latin letters, digits and signs are cut into parts (letters, single digits, signs) all at once, and their distinct parts go to the library's BPE model
in one call. Words with an apostrophe are cut one by one; all others (other alphabets, combining marks, special
tokens) go through the library's whole pipeline.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rfsense.llm.chunks import LATIN, runs, sums
from rfsense.llm.common import gather, words_of

CACHE_WORDS = 100_000
"""Words kept by a Python worker, beside those of the slice at hand. A full cache starts anew; results do not depend on it."""

_PLAIN = re.compile("[!-~À-ÿ]+")
# The file's own pattern over these characters, small letters.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\\[-`{-~×÷]+")


def byte_characters() -> list[str]:
    """The character that byte-level BPE files write for each byte: printable ones stand for themselves, the others follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(others)) for b in range(256)]


class WordEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads of the library would take more
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.mapped = dict(enumerate(byte_characters()))
        self.bare = Tokenizer(self.model)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        """Empty the cache: at the end of a task, since the worker lives on for other work."""
        self.parts: dict[str, list[int]] = {}
        self.known = pa.array([], pa.string())
        self.starts = self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _part(self, part: str) -> list[int]:
        if (ids := self.parts.get(part)) is None:
            if len(self.parts) >= CACHE_WORDS // 2:
                self.parts.clear()
            ids = self.parts[part] = [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.mapped))]
        return ids

    def word(self, word: str) -> list[int]:
        if _PLAIN.fullmatch(word) and "<|" not in word:
            low = word.lower()
            if low.isascii() and low.isalpha():
                return self._part(low)
            return [i for part in _PARTS.findall(low) for i in self._part(part)]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _latin(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain Latin words one after another, and how many each has."""
        codes, parts, counts = runs(pc.utf8_lower(words), True)
        ids, n = self._parts(parts.to_pylist())
        flat, each = gather(codes, np.cumsum(n) - n, n, ids)
        return flat, sums(each, counts)

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts one after another, and how many each has; the last id of a part is one that ends words."""
        mapped = [p if p.isascii() else p.encode().decode("latin-1").translate(self.mapped) for p in parts]
        ids = np.array(self.bare.encode_batch_fast([mapped], is_pretokenized=True, add_special_tokens=False)[0].ids if mapped else [], np.uint32)
        last = np.flatnonzero(self.ends_word[ids])
        if len(last) == len(parts) and (not len(ids) or last[-1] == len(ids) - 1):
            return ids, np.diff(last, prepend=-1)
        each = [[t.id for t in self.model.tokenize(m)] for m in mapped]
        return np.fromiter((i for x in each for i in x), np.uint32), np.fromiter(map(len, each), np.int64, len(each))

    def _new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words in some order, where each word's begin, and how many it has."""
        plain = pc.and_(pc.match_substring_regex(words, f"^{LATIN}$"), pc.invert(pc.match_substring(words, "<|")))
        flat, n = self._latin(words.filter(plain))
        own = plain.to_numpy(zero_copy_only=False)
        ids = [self.word(w) for w in words.filter(pc.invert(plain)).to_pylist()]
        sizes = np.empty(len(words), np.int64)
        sizes[own], sizes[~own] = n, np.fromiter(map(len, ids), np.int64, len(ids))
        starts = np.empty(len(words), np.int64)
        starts[own] = np.cumsum(n) - n
        rest = sizes[~own]
        starts[~own] = len(flat) + np.cumsum(rest) - rest
        return np.concatenate([flat, np.fromiter((i for x in ids for i in x), np.uint32, int(rest.sum()))]), starts, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has; null counts as empty."""
        codes, distinct, counts = words_of(pc.fill_null(texts, ""))
        at = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(self.known) + int((at < 0).sum()) > CACHE_WORDS and len(self.known):
            self.clear()
            at = np.full(len(distinct), -1)
        if len(new := distinct.filter(pa.array(at < 0))):
            at[at < 0] = len(self.known) + np.arange(len(new))
            flat, starts, sizes = self._new(new)
            self.starts = np.concatenate([self.starts, len(self.flat) + starts])
            self.lengths = np.concatenate([self.lengths, sizes])
            self.flat = np.concatenate([self.flat, flat])
            self.known = pa.concat_arrays([self.known, new.cast(pa.string())])
        flat, n = gather(at[codes], self.starts, self.lengths, self.flat)
        ends = np.concatenate(([0], np.cumsum(n)))
        words = np.concatenate(([0], np.cumsum(counts)))
        return flat, np.diff(ends[words])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker: the file is read once."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
