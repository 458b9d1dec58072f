"""Quality classifier by co-training of two views.

One view sees the text (character classes, hashed character pairs, repetition), the other what the page says about itself (language, source,
stated length). Both start from labelled documents. In each round every view scores all documents, is calibrated on labelled
documents kept apart, and hands documents it is sure of, with its answer as label, to the other view. In the end the two calibrated
views are combined, and every document is scored.

Models are logistic regressions fitted on the driver on at most ``LABELLED`` labelled documents and ``HANDED`` pseudo-labelled ones per view,
class and round; both bounds are parameters. Candidates for pseudo-labels are all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rfsense.llm.common import arrow_map, slices, words_of
from rfsense.session import materialise, ship

LABELLED = 12_000
"""Most labelled documents used, chosen by a hash of their id."""
HANDED = 400
"""Most pseudo-labels that a view hands over in a round, by class."""
ROUNDS = 3
SURE = 0.97
"""Calibrated probability from which on a view is sure."""
KEEP_GOOD = 0.995
"""Share of good labelled documents that the threshold keeps at least."""

PAIRS, LANGS, SOURCES, SIZES = 256, 16, 64, 40

# Classes of bytes: small, capital, digit, space, line end, full stop or comma, other marks, beyond ASCII, control.
_CLASS = np.full(256, 8, np.int64)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,")):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _k
_CLASS[[b for b in range(33, 127) if _CLASS[b] == 8]] = 6
_CLASS[128:] = 7
STATS = 9 + 6
SLICE = 1 << 19
"""Bytes of text whose features are counted at a time; a byte takes some hundred on the way."""


def text_features(texts: pa.Array) -> np.ndarray:
    """(documents, STATS + PAIRS); a null text counts as empty."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)
    doc = np.repeat(np.arange(n), size)
    some = np.maximum(size, 1)[:, None]
    classes = np.bincount(doc * 9 + _CLASS[raw], minlength=n * 9).reshape(n, 9) / some
    pair = (raw[:-1].astype(np.int64) * 37 + raw[1:] * 101) % PAIRS
    inside = doc[1:] == doc[:-1]
    pairs = np.bincount(doc[1:][inside] * PAIRS + pair[inside], minlength=n * PAIRS).reshape(n, PAIRS) / some
    codes, distinct, words = words_of(texts)
    length = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(n), words)
    own, times = np.unique(owner.astype(np.int64) << 32 | codes, return_counts=True)
    own >>= 32
    most = np.zeros(n)
    np.maximum.at(most, own, times)
    of = np.maximum(words, 1)
    mean = np.bincount(owner, length[codes], n) / of
    spread = np.sqrt(np.maximum(np.bincount(owner, length[codes] ** 2.0, n) / of - mean**2, 0))
    lines = pc.split_pattern(texts, "\n")
    at = np.diff(np.asarray(lines.offsets))
    line = lines.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    line_owner = np.repeat(np.arange(n), at)
    single = np.bincount(np.unique(line_owner.astype(np.int64) << 32 | line) >> 32, minlength=n)
    stats = np.stack([np.log1p(words), np.bincount(own, minlength=n) / of, most / of, np.log1p(mean), np.log1p(spread), 1 - single / np.maximum(at, 1)], axis=1)
    return np.concatenate([classes, stats, np.sqrt(pairs)], axis=1)


def page_features(lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """(documents, LANGS + SOURCES + SIZES): one-hot buckets; null is a bucket of its own."""

    def hashed(column: pa.Array, size: int) -> np.ndarray:
        return np.array([0 if v is None else 1 + xxhash.xxh3_64_intdigest(v) % (size - 1) for v in column.to_pylist()], np.int64)

    chars = n_chars.cast(pa.float64()).to_numpy(zero_copy_only=False)
    step = np.where(np.isnan(chars), 0, 1 + np.clip(np.floor(2 * np.log2(np.maximum(np.nan_to_num(chars), 1))), 0, SIZES - 2)).astype(np.int64)
    out = np.zeros((len(chars), LANGS + SOURCES + SIZES))
    rows = np.arange(len(chars))
    out[rows, hashed(lang, LANGS)] = 1
    out[rows, LANGS + hashed(source, SOURCES)] = 1
    out[rows, LANGS + SOURCES + step] = 1
    return out


@dataclass
class Logistic:
    """Logistic regression with a ridge, on standardised features; without both classes it knows only their share."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 3.0) -> Logistic:
        if len(y) == 0 or y.min() == y.max():
            return cls(bias=float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.concatenate([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))], axis=1)
        w = np.zeros(z.shape[1])
        penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w[:-1], float(w[-1]))

    def logit(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.bias)
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias


@dataclass
class Calibrated:
    """A model whose logits are put on the scale of probabilities by documents it was not fitted on."""

    model: Logistic
    scale: Logistic

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, apart_x: np.ndarray, apart_y: np.ndarray) -> Calibrated:
        model = Logistic.fit(x, y)
        return cls(model, Logistic.fit(model.logit(apart_x)[:, None], apart_y, 1e-3))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.scale.logit(self.model.logit(x)[:, None]), -20, 20)


@dataclass
class Classifier:
    text: Calibrated
    page: Calibrated
    both: Logistic
    threshold: float

    def scores(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, p = self.text.logit(text), self.page.logit(page)
        return tuple(1 / (1 + np.exp(-v)) for v in (t, p, self.both.logit(np.stack([t, p], axis=1))))


_FEATURES = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("page", pa.binary())])
_VIEWS = {"text": STATS + PAIRS, "page": LANGS + SOURCES + SIZES}


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
                       F.col("source").cast("string").alias("source"), F.col("n_chars").cast("double").alias("n_chars"))


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, text, page``: the features of both views as half-precision numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in slices(batches, size=SLICE):
            made = text_features(cut.column("text")), page_features(*(cut.column(c) for c in ("lang", "source", "n_chars")))
            yield pa.RecordBatch.from_arrays([cut.column("doc_id"), *(pa.array([r.tobytes() for r in m.astype("<f2")], pa.binary()) for m in made)], schema=_FEATURES)

    return _inputs(docs).mapInArrow(arrow_map(run, _FEATURES), "doc_id long, text binary, page binary")


def _unpacked(column: list[bytes], view: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f2").reshape(-1, _VIEWS[view]).astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED, rounds: int = ROUNDS, handed: int = HANDED, sure: float = SURE) -> Classifier:
    """Co-train on ``labels`` (``doc_id`` and ``label`` 0 or 1; null labels and ids are left out, repeated ones settled by majority, ties for 1)."""
    ship(docs.sparkSession)
    made = materialise(features(docs), "features")
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    known = materialise(known, "labels")
    every = -(-max(1, known.count()) // labelled)
    few = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(labelled)
    # At most ``labelled`` rows; of documents that share an id one is taken.
    rows = made.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "page", "y")).alias("r")).select("doc_id", "r.*").toPandas().sort_values("doc_id")
    x = {v: _unpacked(rows[v].tolist(), v) for v in _VIEWS}
    y = rows["y"].to_numpy(float)
    apart = np.array([xxhash.xxh3_64_intdigest(str(i)) % 10 < 3 for i in rows["doc_id"]], bool)
    pool = made.where("doc_id is not null").join(F.broadcast(few.select("doc_id")), "doc_id", "left_anti")
    sets = {v: [(x[v][~apart], y[~apart])] for v in _VIEWS}

    def fitted(view: str) -> Calibrated:
        return Calibrated.fit(np.concatenate([s[0] for s in sets[view]]), np.concatenate([s[1] for s in sets[view]]), x[view][apart], y[apart])

    models = {v: fitted(v) for v in _VIEWS}
    for turn in range(rounds):
        if len(y) == 0 or y.min() == y.max():
            break
        for view, other in (("text", "page"), ("page", "text")):
            got = _sure(pool, view, models[view], sure, handed, turn)
            if len(got):
                sets[other].append((_unpacked(got[other].tolist(), other), got["answer"].to_numpy(float)))
        models = {v: fitted(v) for v in _VIEWS}
    logits = np.stack([models[v].logit(x[v][apart]) for v in _VIEWS], axis=1)
    both = Logistic.fit(logits, y[apart], 1.0)
    good = 1 / (1 + np.exp(-both.logit(logits[y[apart] == 1])))
    threshold = min(0.5, float(np.quantile(good, 1 - KEEP_GOOD))) if len(good) else 0.0
    return Classifier(models["text"], models["page"], both, threshold)


def _sure(pool: DataFrame, view: str, model: Calibrated, sure: float, handed: int, turn: int):
    """Documents on whose class the view is sure: at most ``handed`` of each class, by a hash of their id."""
    schema = pa.schema([("doc_id", pa.int64()), ("answer", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = 1 / (1 + np.exp(-model.logit(_unpacked(batch.column(view).to_pylist(), view))))
                keep = np.maximum(p, 1 - p) >= sure
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(pa.array(keep)), pa.array((p[keep] > 0.5).astype(np.int32))], schema=schema)

    found = materialise(pool.select("doc_id", view).mapInArrow(arrow_map(run, schema), "doc_id long, answer int"), "sure")
    order = F.xxhash64("doc_id", F.lit(turn)), F.col("doc_id")
    best = [found.where(F.col("answer") == k).orderBy(*order).limit(handed) for k in (0, 1)]
    # At most 2 x ``handed`` ids; of documents that share an id one is taken.
    rows = pool.join(F.broadcast(best[0].unionByName(best[1]).groupBy("doc_id").agg(F.min("answer").alias("answer"))), "doc_id")
    return rows.groupBy("doc_id").agg(F.min(F.struct("text", "page", "answer")).alias("r")).select("doc_id", "r.*").toPandas().sort_values("doc_id")


def score_column(classifier: Classifier) -> Column:
    """A struct of ``text``, ``page`` and ``both``: probabilities that a document is good."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("text double, page double, both double")
    def scored(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        out: list[list[np.ndarray]] = [[], [], []]
        batch = pa.RecordBatch.from_arrays([text, lang, source, n_chars], names=["text", "lang", "source", "n_chars"])
        for cut in slices(iter([batch]), size=SLICE):
            got = classifier.scores(text_features(cut.column(0)), page_features(*cut.columns[1:]))
            for column, value in zip(out, got, strict=True):
                column.append(value)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(c) if c else [], pa.float64()) for c in out], ["text", "page", "both"])

    return scored(F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("double"))


def scored(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``doc_id, text_score, page_score, score, accepted`` for every row.

    Null and empty texts, null languages, sources, lengths and ids are scored like any other value; repeated rows each get their score.
    Without labels, or with one class only, all documents are accepted. Other columns are not looked at.
    """
    ship(docs.sparkSession)
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(classifier).alias("s"))
    return one.select("doc_id", F.col("s.text").alias("text_score"), F.col("s.page").alias("page_score"), F.col("s.both").alias("score"),
                      (F.col("s.both") >= classifier.threshold).alias("accepted"))


def accepted(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """The rows of ``docs`` that are accepted, as they are."""
    ship(docs.sparkSession)
    return docs.where(score_column(classifier)["both"] >= classifier.threshold)
