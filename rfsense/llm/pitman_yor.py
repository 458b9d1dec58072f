"""Hierarchical Pitman-Yor language model of order two, with scores for every document.

Each word (and the start of a text) is a context with a restaurant of its own: the words that follow are customers, seated at tables that
serve one word each. All contexts share one parent restaurant, whose customers are their tables; below it lies the uniform
distribution over the V known words and one unknown word. Gibbs sweeps seat all customers of a context and word anew,
given the tables of all others from the sweep before; predictive probabilities are averaged over the sweeps that are kept.

Spark holds the model in parts by hash. Documents are kept in blocks of tokens, once, in buckets by block. A block sends the hashes of its
distinct words or word pairs to their parts, packed into one row per block and part; a part adds them up over all blocks and answers
with one number for each. The tables of a pair depend only on its count, on what the parts answered, and on random numbers drawn from
its hash, so every block that needs them comes to the same tables, and the first block that trains on a pair reports them to the parent.

Beyond ``SINGLE`` customers of one word in a context, the next ones are seated in runs that grow with the number seated, with
the mean of a run rounded at random. Pairs are told apart by 40 bits within a part of about a million tokens (one in a million may
fall together with another one), words by 64 bits where they are counted.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rfsense.llm.common import arrow_map, slices, texts_of, words_of
from rfsense.llm.jaccard import mix
from rfsense.llm.vectors import dealt, groups
from rfsense.session import materialise, workdir

DISCOUNT, STRENGTH = (0.5, 0.8), (1.0, 1.0)
"""Of the parent restaurant and of the contexts."""
SWEEPS = 2
"""Gibbs sweeps; all are averaged, the first starts from word counts."""
SINGLE = 64
BLOCK_BYTES = 5 << 20
"""Bytes of text in a block."""
PART_TOKENS = 1_000_000
"""Tokens for each part of the model, about."""

_U = np.uint64
END, START = _U(xxhash.xxh3_64_intdigest(b"\n")), _U(xxhash.xxh3_64_intdigest(b"\t"))

_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("trains", pa.list_(pa.bool_())),
                    ("words", pa.binary()), ("tokens", pa.binary())])
_BLOCK_DDL = "block long, doc_ids array<long>, sizes array<long>, trains array<boolean>, words binary, tokens binary"
_ASK = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])
_ASK_DDL = "part int, block long, keys binary, a binary, b binary"
_ANSWER = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("x", pa.binary()), ("sums", pa.list_(pa.float64()))])
_ANSWER_DDL = "block long, part int, x binary, sums array<double>"
_SCORE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
                    ("base_score", pa.float64()), ("score", pa.float64())])
_SCORE_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def trains_on(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 != 1


def tables(customers: np.ndarray, new: np.ndarray, discount: float, seed: np.ndarray) -> np.ndarray:
    """Tables that serve one word, seated customer by customer.

    ``new``: weight of a new table, (strength + discount x all tables) x probability in the parent; ``seed``: random 64 bits each. No
    customers have no table, one has one.
    """
    out = (customers > 0).astype(np.float64)
    order = np.argsort(-customers, kind="stable")
    order = order[: int((customers > 1).sum())]
    c, a, t, s = customers[order], new[order], out[order], seed[order]
    i = 1
    while len(c):
        run = 1 if i < SINGLE else max(1, i // 16)
        size = np.minimum(run, c - i)
        chance = a / (a + np.maximum(i - discount * t, 1e-9))
        with np.errstate(over="ignore"):
            drawn = (mix(s + _U(i) * _U(0xD1342543DE82EF95)) >> _U(11)) * 2.0**-53
        t = t + np.floor(size * chance + drawn)
        i += run
        n = int(np.searchsorted(-c, -i, side="left"))  # those with more customers than i
        out[order[n:len(c)]] = t[n:]
        c, a, t, s = c[:n], a[:n], t[:n], s[:n]
        order = order[:n]
    return out


class Block:
    """The tokens of some documents, with the distinct pairs of a word and the one before."""

    def __init__(self, row: dict):
        self.id, self.doc_ids = row["block"], row["doc_ids"]
        self.sizes, self.trains = np.array(row["sizes"], np.int64), np.array(row["trains"], bool)
        self.words = np.append(np.frombuffer(row["words"], "<u8").astype(np.uint64), START)  # the last is the start of a text
        self.tokens = np.frombuffer(row["tokens"], "<u4").astype(np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.trained = np.repeat(self.trains, self.sizes)

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.firsts] = len(self.words) - 1
        return np.unique(before * len(self.words) + self.tokens, return_inverse=True)

    @property
    def pair(self) -> np.ndarray:
        """Of each token, the number of its pair."""
        return self._pairs[1]

    @cached_property
    def before(self) -> np.ndarray:
        return self._pairs[0] // len(self.words)

    @cached_property
    def word(self) -> np.ndarray:
        return self._pairs[0] % len(self.words)

    @cached_property
    def hash(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(mix(self.words[self.before]) + self.words[self.word])

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair[self.trained], minlength=len(self.hash))

    def word_counts(self) -> np.ndarray:
        """Training tokens of each word; for the start, training documents."""
        out = np.bincount(self.tokens[self.trained], minlength=len(self.words))
        out[-1] = self.trains.sum()
        return out


def _parts(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(the order that puts hashes of one part together, the part of each in that order)."""
    part = (mix(hashes) % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, part[order]


def _numbers(values: np.ndarray) -> bytes:
    """Whole numbers in the least of 1, 2, 4 or 8 bytes that holds them all, which the first byte tells."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(values.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _from_numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


def _requests(block: int, hashes: np.ndarray, parts: int, width: int, a: np.ndarray, b: np.ndarray | None = None) -> pa.RecordBatch:
    order, part = _parts(hashes, parts)
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, int)
    raw = hashes[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    rows: list[list] = [[], [], [], [], []]
    for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True):
        own = order[x:y]
        for column, value in zip(rows, (int(part[x]), block, raw[x:y].tobytes(), _numbers(a[own]), None if b is None else _numbers(b[own])), strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _ASK, strict=True)], schema=_ASK)


def _answered(answers: list[tuple[int, bytes]], hashes: np.ndarray, parts: int, fields: int) -> np.ndarray:
    """(fields, hashes): the numbers that came back, in the order of ``hashes``."""
    order, _ = _parts(hashes, parts)
    out = np.zeros((fields, len(hashes)))
    if len(hashes):
        out[:, order] = np.concatenate([_from_numbers(x).reshape(fields, -1) for _, x in sorted(answers)], axis=1)
    return out


def _reduce(width: int, answer: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[list[np.ndarray], list[float]]]):
    """Adds up what the blocks sent to a part; ``answer(keys, a, b, which key, a by row)`` gives numbers per row and sums per part."""

    def close(part: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        raw = [np.frombuffer(k, np.uint8).reshape(-1, width) for k in table.column("keys").to_pylist()]
        sizes = [len(r) for r in raw]
        wide = np.zeros((sum(sizes), 8), np.uint8)
        wide[:, :width] = np.concatenate(raw)
        keys, which = np.unique(wide.view("<u8").reshape(-1), return_inverse=True)
        a = np.concatenate([_from_numbers(x) for x in table.column("a").to_pylist()]).astype(np.int64)
        total = other = np.bincount(which, a, len(keys))
        if table.column("b").null_count == 0:
            other = np.bincount(which, np.concatenate([_from_numbers(x) for x in table.column("b").to_pylist()]), len(keys))
        values, sums = answer(keys, total, other, which, a)
        ends = np.cumsum(sizes)
        x = [_numbers(np.concatenate([v[e - n:e] for v in values])) for e, n in zip(ends, sizes, strict=True)]
        return pa.RecordBatch.from_arrays([
            pa.array([*table.column("block").to_pylist(), None], pa.int64()), pa.array([part] * (len(x) + 1), pa.int32()),
            pa.array([*x, None], pa.binary()), pa.array([None] * len(x) + [sums], pa.list_(pa.float64()))], schema=_ANSWER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for key, piece, new in groups(batches, ["part"]):
            if new and rows:
                yield close(part, rows)
                rows = []
            part = int(key[0])
            rows.append(piece)
        if rows:
            yield close(part, rows)

    return arrow_map(run, _ANSWER)


def _pair_answer(keys, total, other, which, a):
    """Twice the training count, plus one for the first block that trains on the pair; blocks come in order."""
    own = np.zeros(len(which))
    at = np.flatnonzero(a)
    own[at[np.unique(which[at], return_index=True)[1]]] = 1
    return [2 * total[which] + own], []


def _word_answer(keys, total, other, which, a):
    return [total[which]], [float(total.sum()), float((total > 0).sum())]


def _state_answer(base: float, all_tables: float, sweep: int):
    """Customers and tables in the parent restaurant, and the tables of the word's own restaurant."""

    def answer(keys, total, other, which, a):
        new = np.full(len(keys), (STRENGTH[0] + DISCOUNT[0] * all_tables) * base)
        with np.errstate(over="ignore"):
            seated = tables(total.astype(np.int64), new, DISCOUNT[0], mix(keys.astype(np.uint64) + _U(sweep)))
        return [total[which], seated[which], other[which]], [float(total.sum()), float(seated.sum())]

    return answer


class Model:
    """What the sweeps say about the words and pairs of one block."""

    def __init__(self, block: Block, answers: dict[int, list[tuple[int, bytes]]], parts: int, totals: list[list[float]]):
        got = _answered(answers[0], block.hash, parts, 1)[0]
        self.block, self.first, self.pairs = block, got % 2 == 1, (got // 2).astype(np.int64)
        self.counts = _answered(answers[1], block.words, parts, 1)[0]
        self.n, self.known = totals[0]
        self.vocabulary = self.known + 1
        self.states: list[tuple[np.ndarray, np.ndarray]] = []
        for k, (customers, seated) in enumerate(totals[1:]):
            c, t, own = _answered(answers[2 + k], block.words, parts, 3)
            back = (STRENGTH[0] + DISCOUNT[0] * seated) / (STRENGTH[0] + customers)
            self.states.append((np.maximum(c - DISCOUNT[0] * t, 0) / (STRENGTH[0] + customers) + back / self.vocabulary, own))

    def state(self, sweep: int) -> tuple[np.ndarray, np.ndarray]:
        """(probability in the parent, tables of the context) before a sweep; at first from counts alone."""
        if sweep:
            return self.states[sweep - 1]
        return (self.counts + 0.5) / (self.n + 0.5 * self.vocabulary), self.counts**0.8

    def seated(self, sweep: int) -> np.ndarray:
        p, own = self.state(sweep)
        b = self.block
        new = (STRENGTH[1] + DISCOUNT[1] * own[b.before]) * p[b.word]
        with np.errstate(over="ignore"):
            return tables(self.pairs, new, DISCOUNT[1], mix(b.hash + _U(1000 + sweep)))

    def reported(self, sweep: int) -> tuple[np.ndarray, np.ndarray]:
        """Tables that the block reports: to the parent by word, and by context."""
        t, b = np.where(self.first, self.seated(sweep), 0), self.block
        return tuple(np.bincount(at, t, len(b.words)).astype(np.int64) for at in (b.word, b.before))

    def probabilities(self) -> np.ndarray:
        """Of each pair, averaged over the sweeps."""
        b = self.block
        context = self.counts[b.before]
        total = np.zeros(len(b.hash))
        for k, (p, own) in enumerate(self.states):
            back = p[b.word]
            seen = np.maximum(self.pairs - DISCOUNT[1] * self.seated(k), 0) + (STRENGTH[1] + DISCOUNT[1] * own[b.before]) * back
            total += np.where(context > 0, seen / (STRENGTH[1] + context), back)
        return total / len(self.states)


@contextmanager
def _one_block_at_a_time(spark: SparkSession):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, made = TaskContext.get().partitionId(), 0
    for cut in slices(batches, size=BLOCK_BYTES):
        ids = cut.column("doc_id").to_pylist()
        codes, distinct, counts = words_of(cut.column("text"), lower=True)
        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))
        times = np.append(np.bincount(codes, minlength=len(distinct)), len(ids))
        order = np.argsort(-times, kind="stable")  # frequent words get small numbers, which pack well
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        sizes = counts + 1
        tokens = np.full(int(sizes.sum()), len(distinct), np.int64)
        last = np.cumsum(sizes) - 1
        word = np.ones(len(tokens), bool)
        word[last] = False
        tokens[word] = codes
        words = np.append(hashed, END)[order]
        yield pa.RecordBatch.from_arrays([pa.array([part << 32 | made]), pa.array([ids], _BLOCK.field("doc_ids").type), pa.array([sizes], _BLOCK.field("sizes").type), pa.array(
            [[trains_on(i) for i in ids]], _BLOCK.field("trains").type), pa.array([words.astype("<u8").tobytes()], pa.binary()), pa.array(
            [rank[tokens].astype("<u4").tobytes()], pa.binary())], schema=_BLOCK)
        made += 1


def _each_block(make: Callable[[Block, dict], Iterator[pa.RecordBatch]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                answers: dict[int, list[tuple[int, bytes]]] = {}
                for a in row.get("answers") or ():
                    answers.setdefault(a["kind"], []).append((a["part"], a["x"]))
                yield from make(Block(row), answers)

    return arrow_map(run, schema)


def scores(docs: DataFrame, sweeps: int = SWEEPS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``.

    Words are lower-cased (A-Z) and lie between ASCII white space; each text ends with one more token, so null and empty texts have
    one token. Rows that repeat count, and are scored, as often as they come; a null id counts as the empty text. An empty table gives an empty
    result; without training documents every word is the unknown one.
    """
    docs = texts_of(docs)
    spark = docs.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    made = docs.mapInArrow(arrow_map(_blocks, _BLOCK), _BLOCK_DDL)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Buckets by block: what parts answer comes to the blocks, the tokens never move again.
    made.write.bucketBy(buckets, "block").option("path", workdir(spark, "blocks")).option("compression", "zstd").saveAsTable(name)
    try:
        with _one_block_at_a_time(spark):
            return _scores(spark.table(name), sweeps, part_tokens)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _scores(blocks: DataFrame, sweeps: int, part_tokens: int) -> DataFrame:
    spark = blocks.sparkSession
    size = blocks.agg(F.sum(F.length("tokens") / 4).alias("n"), F.sum(F.size(F.filter("trains", lambda t: t))).alias("d")).first()
    if not size["n"]:
        return spark.createDataFrame([], _SCORE_DDL + ", perplexity double")
    parts, trained = max(1, int(size["n"]) // part_tokens), float(size["d"])

    def exchange(asked: DataFrame, width: int, answer, kind: int) -> tuple[DataFrame, list[float]]:
        got = materialise(dealt(asked, ["part"], "block").mapInArrow(_reduce(width, answer), _ANSWER_DDL), "answers")
        rows = got.where("sums is not null").select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
        return got.where("block is not null").select(F.lit(kind).alias("kind"), "block", "part", "x"), [r["v"] for r in rows]

    pairs = blocks.mapInArrow(_each_block(lambda b, _: iter([_requests(b.id, b.hash, parts, 5, b.pair_counts())]), _ASK), _ASK_DDL)
    words = blocks.mapInArrow(_each_block(lambda b, _: iter([_requests(b.id, b.words, parts, 8, b.word_counts())]), _ASK), _ASK_DDL)
    pair_answers, _ = exchange(pairs, 5, _pair_answer, 0)
    word_answers, total = exchange(words, 8, _word_answer, 1)
    # The start of a text is counted as a context, but is no word.
    known = total[1] - (trained > 0)
    answers, totals = [pair_answers, word_answers], [[total[0] - trained, known]]

    def with_answers() -> DataFrame:
        every = answers[0]
        for a in answers[1:]:
            every = every.unionByName(a)
        return blocks.join(every.groupBy("block").agg(F.collect_list(F.struct("kind", "part", "x")).alias("answers")), "block")

    tables_above = known
    for sweep in range(sweeps):
        so_far = [list(t) for t in totals]

        def report(block: Block, got: dict, sweep: int = sweep, so_far: list = so_far) -> Iterator[pa.RecordBatch]:
            up, own = Model(block, got, parts, so_far).reported(sweep)
            yield _requests(block.id, block.words, parts, 5, up, own)

        asked = with_answers().mapInArrow(_each_block(report, _ASK), _ASK_DDL)
        got, sums = exchange(asked, 5, _state_answer(1 / (known + 1), tables_above, sweep), 2 + sweep)
        answers.append(got)
        totals.append(sums)
        tables_above = sums[1]

    final = [list(t) for t in totals]

    def score(block: Block, got: dict) -> Iterator[pa.RecordBatch]:
        m = Model(block, got, parts, final)
        count = m.counts[block.tokens]
        base = np.log10((count + 0.5) / (m.n + 0.5 * (m.known + 1)))
        own = np.log10(m.probabilities())[block.pair]
        at = block.firsts
        yield pa.RecordBatch.from_arrays([
            pa.array(block.doc_ids, pa.int64()), pa.array(~block.trains), pa.array(block.sizes), pa.array(np.add.reduceat((count > 0).astype(np.int64), at)),
            pa.array(np.full(len(at), int(m.n)), pa.int64()), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(own, at))], schema=_SCORE)

    out = materialise(with_answers().mapInArrow(_each_block(score, _SCORE), _SCORE_DDL), "scores")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
