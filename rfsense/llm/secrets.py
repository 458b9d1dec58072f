"""Secret scans: fixed patterns, and character Markov models for random-looking strings.

Two first-order Markov models over characters are compared by log-likelihood ratio: one of random strings, one of ordinary
identifiers. Both are trained here, by counting character pairs over all texts: what the fixed patterns find is labelled random,
every other run of identifier characters is labelled ordinary. A long run with a stretch whose ratio passes the threshold is a span
of kind ``markov``; spans of the fixed patterns are cut out of the runs before, and what remains of a run is a run of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rfsense.llm.common import arrow_map, slices, texts_of

KINDS = ("assign", "access", "hex", "markov")

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of 32 and more: a run starts where the character before is no hex digit
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")

# Which texts can match at all; letter folding beyond ASCII lets through a few more.
_MAY = {
    "assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[a-z0-9+/_.=-]{8}""",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
}

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
N = len(SYMBOLS) + 1  # 0: start of a run
_CLASS = np.zeros(256, np.int64)
_CLASS[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(1, N)

SLICE = 1 << 20
"""Bytes of text whose pairs are counted at a time."""
MIN_RUN = 20
"""Least characters of a ``markov`` span."""
ODDS = 1e6
"""How many ordinary runs stand against one random run before their characters are seen."""


def base_spans(text: str, may: tuple[bool, bool, bool] = (True, True, True)) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then by kind as listed."""
    found = []
    if may[0]:
        found += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if may[1]:
        found += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if may[2]:
        found += [(*m.span(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2]))]


def _pairs(raw: bytes) -> np.ndarray:
    """Counts of the pairs of characters within runs; the first of a run follows the start."""
    at = _CLASS[np.frombuffer(raw, np.uint8)]
    return np.bincount(np.concatenate(([0], at[:-1])) * N + at, minlength=N * N) if len(at) else np.zeros(N * N, np.int64)


def _flags(texts: pa.Array) -> list[tuple[bool, bool, bool]]:
    return list(zip(*(pc.match_substring_regex(texts, p).to_pylist() for p in _MAY.values()), strict=True))


_PAIRS = pa.schema([("pair", pa.int32()), ("random", pa.int64()), ("n", pa.int64())])


def pair_counts(docs: DataFrame) -> DataFrame:
    """``pair, random, ordinary``: character pairs over all texts, by label; at most one row for each pair of symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, random = np.zeros(N * N, np.int64), np.zeros(N * N, np.int64)
        for cut in slices(batches, size=SLICE):
            texts = pc.fill_null(cut.column("text"), "")
            total += _pairs("\n".join(texts.to_pylist()).encode())
            values = []
            for i, may in enumerate(_flags(texts)):
                if any(may):
                    text = texts[i].as_py()
                    values += [run for a, b, kind in base_spans(text, may) for run in RUN.findall(
                        ASSIGN.fullmatch(text[a:b])[2] if kind == "assign" else text[a:b])]
            random += _pairs("\n".join(values).encode())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(random[at]), pa.array(total[at])], schema=_PAIRS)

    counted = texts_of(docs).select("text").mapInArrow(arrow_map(run, _PAIRS), "pair int, random long, n long")
    return counted.groupBy("pair").agg(F.sum("random").alias("random"), F.greatest(F.sum("n") - F.sum("random"), F.lit(0)).alias("ordinary"))


def train(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratio, random against ordinary, of each character after each; (N, N), add-half smoothing.

    Without any labelled text a model is uniform.
    """
    counts = np.zeros((2, N * N))
    for r in pair_counts(docs).collect():  # N x N rows at most
        counts[:, r["pair"]] = r["random"], r["ordinary"]
    counts = counts.reshape(2, N, N)
    counts[:, :, 0] = 0  # a run may end anywhere
    smooth = counts + 0.5
    smooth[:, :, 0] = 0
    p = smooth / smooth.sum(axis=2, keepdims=True)
    ratio = np.zeros((N, N))
    ratio[:, 1:] = np.log(p[0, :, 1:]) - np.log(p[1, :, 1:])
    return ratio


def markov_spans(text: str, ratio: np.ndarray, taken: list[tuple[int, int, str]], min_run: int = MIN_RUN, odds: float = ODDS) -> list[tuple[int, int, str]]:
    """Runs of at least ``min_run`` characters, clear of ``taken``, in which a stretch as long has a log-likelihood ratio above ``log(odds)``."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{%d,}" % min_run, text):
        a, b = m.span()
        at = _CLASS[np.frombuffer(m[0].encode(), np.uint8)]
        upto = np.concatenate(([0.0], ratio[np.concatenate(([0], at[:-1])), at].cumsum()))
        best = (upto[min_run:] - np.minimum.accumulate(upto[:-min_run])).max()
        if best > log(odds) and not any(x < b and a < y for x, y, _ in taken):
            found.append((a, b, "markov"))
    return found


def rest_spans(text: str, ratio: np.ndarray, taken: list[tuple[int, int, str]], min_run: int = MIN_RUN, odds: float = ODDS) -> list[tuple[int, int, str]]:
    """``markov_spans`` of what lies between the spans ``taken``, which come by start."""
    found, at = [], 0
    for x, y, _ in [*taken, (len(text), len(text), "")]:
        if x - at >= min_run:
            found += [(at + a, at + b, kind) for a, b, kind in markov_spans(text[at:x], ratio, [], min_run, odds)]
        at = max(at, y)
    return found


_SPANS = pa.schema([("doc_id", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("kinds", pa.list_(pa.string()))])


def scan(docs: DataFrame, ratio: np.ndarray, min_run: int = MIN_RUN, odds: float = ODDS, keep: tuple[str, ...] = (), mask: str | None = None,
         out: tuple[str, str, str] = ("starts", "ends", "kinds")) -> DataFrame:
    """All spans of every whole text as ``starts, ends, kinds`` (or as ``out`` names them), by start and kind, next to ``doc_id`` and the columns ``keep``.

    With ``mask`` the column ``text`` comes too, every span (spans that touch taken as one) replaced by it; a null text
    stays null and has no spans.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    if set(out) & {"doc_id", "text", *keep}:
        raise ValueError(f"the input has a column of {out} already")
    # Numbered names inside: mapInArrow does not take names with dots.
    names = ["doc_id", "text", *keep]
    sent = {c: f"c{i}" for i, c in enumerate(names)}
    fields = [docs.schema[c] for c in ("doc_id", *(("text",) if mask is not None else ()), *keep)]
    ddl = ", ".join(f"{sent[f.name]} {f.dataType.simpleString()}" for f in fields) + ", s0 array<int>, s1 array<int>, s2 array<string>"
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # N x N numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = r"[A-Za-z0-9+/_=-]{%d}" % min_run
        for cut in slices(batches, "c1"):
            texts = pc.fill_null(cut.column("c1"), "")
            may = _flags(texts)
            long_run = pc.match_substring_regex(texts, wide).to_pylist()
            spans: list[list[tuple[int, int, str]]] = [[] for _ in may]
            hits = [i for i in range(len(may)) if any(may[i]) or long_run[i]]
            for i in hits:
                text = texts[i].as_py()
                own = base_spans(text, may[i])
                if long_run[i]:
                    own += rest_spans(text, shared.value, own, min_run, odds)
                spans[i] = sorted(own, key=lambda s: (s[0], KINDS.index(s[2])))
            columns = {c: cut.column(c) for c in sent.values() if c != "c1" or mask is not None}
            if mask is not None and any(spans):
                new = cut.column("c1").to_pylist()
                for i in hits:
                    new[i] = masked(new[i], spans[i], mask) if spans[i] else new[i]
                columns["c1"] = pa.array(new, cut.column("c1").type)
            kinds = pa.int32(), pa.int32(), pa.string()
            columns |= {f"s{k}": pa.array([[s[k] for s in x] for x in spans], pa.list_(kinds[k])) for k in range(3)}
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(*(F.col(f"`{c}`").alias(sent[c]) for c in names)).mapInArrow(run, ddl).toDF(*(f.name for f in fields), *out)


def masked(text: str, spans: list[tuple[int, int, str]], mask: str) -> str:
    out, at = [], 0
    for a, b, _ in spans:
        if a > at or not out:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def digests(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds and the spans as text; a text without spans has the digest of nothing and empty ``spans``."""
    found = scan(texts_of(docs), train(docs))
    line = F.transform(F.sequence(F.lit(0), F.size("kinds") - 1), lambda i: F.concat_ws(
        ":", F.col("kinds")[i], F.col("starts")[i].cast("string"), F.col("ends")[i].cast("string")))
    lines = F.when(F.size("kinds") > 0, line).otherwise(F.array().cast("array<string>"))

    def count(kind: str) -> Column:
        return F.size(F.filter("kinds", lambda x: x == kind)).cast("long").alias(f"n_{kind}")

    found = found.withColumn("_l", lines)
    return found.select(
        "doc_id", *map(count, KINDS),
        F.sha2(F.array_join(F.filter("_l", lambda x: ~x.startswith("markov:")), ","), 256).alias("base_sha256"),
        F.array_join("_l", ",").alias("spans"),
    )
