"""N-gram Jaccard join by universe-partition pigeonhole.

A document's set holds the hashes of its distinct word n-grams. Sizes fall into bands; two sets that link lie in one band
or in two that follow each other, so every band is also a domain that the next band's sets join. In a domain of sets
that differ by at most H elements when they link, tokens are hashed into segments. A segment weighs 1 if sets must agree on it to
meet (one signature) and 2 if they may differ by one element (a signature for the subset and one for each subset with an
element left out); with a total weight of H + t, sets that link meet in segments of weight t at least. Weights are
dealt out by cost: segments whose signatures collide most over all documents are skipped, and paid for by those where
one-deletion signatures cost least. A set leaves out its signatures of empty subsets unless they weigh t or more: then a pair that
meets only in empty subsets still meets, and no other pair meets because of them. What remains of t after that, c, is spent on the largest buckets: two
sets that link meet in buckets that weigh c together, so each leaves its largest ones out, as far as these weigh less than c. Of the buckets they share, the last in
the common order of sizes stays in both. So long sets that meet others by chance in a few buckets, or share a passage with very many, meet nobody there. A set's own
size says how many elements it may differ by from any partner, so c is the larger the smaller a set is within its domain.

Candidates are filtered by size and by a parity sketch (the bits in which two sketches differ never exceed the elements in which
the sets differ), and verified on the whole texts. Equal sets are one node. In each bucket the nodes are first
compared with the least one; only buckets whose nodes are not all in one component by then go on. So no bucket of near copies is expanded into its pairs, and every
link between components is tested.

Versions of one text that stay just below the threshold meet in many segments. So for the sets that are left over the universe is parted once more, into single elements, of
which only those count that sets of several components hold. A set that holds fewer of them than a link takes is out. The others leave out their most frequent elements in the
same way, each as far as a link with any partner allows; at an element where two sets meet, each must have as many left, from there on in the common order, as a link of just
these two takes (the first element they share passes), and a sketch of 1024 bits is compared. The elements of the least component in a bucket are not compared among themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rfsense.llm.common import arrow_map, components, slices, texts_of, words_of
from rfsense.llm.vectors import dealt
from rfsense.session import materialise

GROUPS = 16
"""Kinds of segments of a domain, by number; a kind has one weight."""
CELLS = 64
"""Signed counters that estimate how often the signatures of a kind collide."""
HOT = 32
"""Nodes of one signature in a slice of documents from which on they are joined among themselves first."""
BROADCAST_ROWS = 1_000_000
MIDDLE = 16
"""Words of the sketches that are compared where two sets meet in an element."""
SLICE = 2 << 20
"""Bytes of text whose sets and signatures a worker holds at a time."""

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)
_TAG = _U(511)  # the low bits of a signature: its domain, and whether its segment weighs 2


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit (splitmix64)."""
    x = x.astype(np.uint64) + _MUL
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all texts one after another, and how many each has.

    Words lie between ASCII white space, A-Z lower-cased. Shorter texts have their whole sequence as one element; without words there is
    none.
    """
    codes, distinct, counts = words_of(texts, lower=True)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))[codes]
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        n = max(0, len(hashed) - words + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(words):
            rolled = rolled * _MUL + hashed[k:k + n]
        rolled = mix(rolled)
        out = []
        for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
            if count >= words:
                out.append(np.unique(rolled[end - count:end - words + 1]))
            elif count:
                whole = np.full(1, count, np.uint64)
                for h in hashed[end - count:end]:
                    whole = whole * _MUL + h
                out.append(mix(mix(whole)))
            else:
                out.append(np.zeros(0, np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array([len(x) for x in out], np.int64)


@dataclass(frozen=True)
class Bands:
    """Size bands for a threshold of ``percent`` / 100."""

    percent: int

    def starts(self) -> np.ndarray:
        return _starts(self.percent)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts(), sizes, side="right") - 1

    def differ(self, domain: int) -> int:
        """The most elements in which two sets of a domain that link can differ."""
        p, most = self.percent, int(self.starts()[domain + 1]) - 1
        return (100 - p) * (most + most * 100 // p) // (100 + p)

    def weight(self, domain: int) -> tuple[int, int, int]:
        """Total weight of the segments; the weight of empty subsets from which on a set takes part in them; and the weight of the buckets in
        which two sets that link meet beyond those.

        Sets that link agree in all that goes beyond the elements in which they differ.
        """
        h = self.differ(domain)
        empty = 1 if h == 0 else 2 + h // 64
        shared = max(1 if h < 2 else 2 if h < 8 else 3, 1 + h // 16)
        return h + empty + shared - 1, empty, shared

    def shared(self, domain: Column, n: Column) -> Column:
        """The weight of the buckets in which a set of ``n`` elements meets any set that it links with in a domain: ``weight`` has the least of a domain.

        Its partner is at most as large as the threshold allows, and lies in the domain's own band if the set lies in the next one.
        """
        p, starts = self.percent, self.starts().tolist()
        own = range(len(starts) - 2)
        weights = [self.weight(d) for d in own]

        def at(values) -> Column:
            return F.element_at(F.array(*(F.lit(int(v)) for v in values)), domain + 1)

        next_, last, least = at(starts[1:-1]), at(x - 1 for x in starts[2:]), at(shared for _, _, shared in weights)
        partner = F.when(n >= next_, next_ - 1).otherwise(F.least(F.floor(n * 100 / p), last))
        return F.greatest(least, at(total - empty + 1 for total, empty, _ in weights) - F.floor((100 - p) * (n + partner) / (100 + p)))


@cache
def _starts(percent: int) -> np.ndarray:
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(starts[-1] * 100 // percent + 1)
    return np.array(starts, np.int64)


def segments_of(total: int, weights: np.ndarray) -> int:
    """How many segments a domain needs for its total weight, with these weights by kind."""
    n = round_ = 0
    per_round = int(weights.sum())
    if per_round:
        round_ = max(0, total // per_round - 1)
        n, total = round_ * GROUPS, total - round_ * per_round
    while total > 0:
        total -= int(weights[n % GROUPS])
        n += 1
    return n


def signatures(flat: np.ndarray, sizes: np.ndarray, domains: np.ndarray, bands: Bands, plan: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set, kind of segment, domain) of sets, each in the domain given for it (none below 0)."""
    some = np.flatnonzero((sizes > 0) & (domains >= 0))
    all_starts = np.cumsum(sizes) - sizes
    if not len(some):
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    own_domain, n = domains[some], sizes[some]
    flat = flat[np.repeat(all_starts[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    each = {int(d): (plan.get(int(d), np.ones(GROUPS, np.int64)), *bands.weight(int(d))) for d in np.unique(own_domain)}
    m = np.array([segments_of(each[int(d)][1], each[int(d)][0]) for d in own_domain], np.int64)
    least = np.array([each[int(d)][2] for d in own_domain], np.int64)
    base = np.cumsum(m) - m
    row = np.repeat(np.arange(len(some)), n)
    with np.errstate(over="ignore"):
        cell = base[row] + ((flat >> _U(20)) % m[row].astype(np.uint64)).astype(np.int64)
        total = int(m.sum())
        mixed = mix(flat)
        low = np.bincount(cell, (mixed & _U(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
        high = np.bincount(cell, (mixed >> _U(32)).astype(np.float64), total).astype(np.uint64)
        sums = low + (high << _U(32))
        held = np.bincount(cell, minlength=total)
        owner = np.repeat(np.arange(len(some)), m)
        number = np.arange(total) - base[owner]
        kind = number % GROUPS
        weight = np.stack([each[int(d)][0] for d in np.unique(own_domain)])[np.searchsorted(np.unique(own_domain), own_domain)][owner, kind]
        salt = (own_domain[owner].astype(np.uint64) << _U(48)) + number.astype(np.uint64) + _U(1)

        whole = np.flatnonzero(weight > 0)
        drop = np.flatnonzero(weight[cell] == 2)  # elements that are left out in turn
        segment = np.concatenate([whole, cell[drop]])
        subset = np.concatenate([sums[whole], sums[cell[drop]] - mixed[drop]])
        empty = np.concatenate([held[whole] == 0, held[cell[drop]] == 1])
        # A set's empty signatures count only where it might meet others in nothing else.
        reached = np.zeros(total, bool)
        reached[segment[empty]] = True
        may = np.bincount(owner, np.where(reached, weight, 0), len(some)) >= least
        keep = ~empty | may[owner[segment]]
        segment, subset = segment[keep], subset[keep]
        of = own_domain[owner[segment]]
        tag = of.astype(np.uint64) << _U(1) | (weight[segment] == 2).astype(np.uint64)
        return mix(mix(salt[segment]) + subset) & ~_TAG | tag, some[owner[segment]], kind[segment], of


def sketches(flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Parity sketches: 64-bit words, at least 4, with two to four bits for each element."""
    out, at = [], 0
    for n in sizes.tolist():
        bits = 256
        while bits < 2 * n:
            bits *= 2
        odd = np.bincount((flat[at:at + n] >> _U(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8"))
        at += n
    return out


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("small", pa.list_(pa.int64())),
                   ("sketch", pa.list_(pa.int64())), ("domain", pa.int32()), ("cell", pa.int32()), ("sum", pa.int64()), ("number", pa.int64())])
_SIGNED = pa.schema([("sig", pa.int64()), ("salt", pa.int64()), ("node", pa.int64())])
_MET = pa.schema([("sig", pa.int64()), ("first", pa.int64()), ("node", pa.int64())])


def _keys(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set."""
    ends = np.cumsum(sizes)
    raw = [xxhash.xxh3_128_digest(flat[e - n:e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    both = np.frombuffer(b"".join(raw), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _sets(words: int, bands: Bands):
    """One row per document, and one per slice, domain and counter for the cost of signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in slices(batches, size=SLICE):
            flat, sizes = shingles(cut.column("text"), words)
            x, y = _keys(flat, sizes)
            none = np.zeros(len(sizes), bool) | (sizes == 0)
            n, nulls, full = len(sizes), pa.nulls, sketches(flat, sizes)
            small = [np.bitwise_xor.reduce(s.reshape(-1, 4), axis=0) for s in full]
            yield pa.RecordBatch.from_arrays([cut.column("doc_id"), pa.array(sizes), pa.array(x, mask=none), pa.array(y, mask=none), pa.array(
                small, pa.list_(pa.int64())), pa.array(full, pa.list_(pa.int64())), nulls(n, pa.int32()), nulls(n, pa.int32()), nulls(n, pa.int64()), nulls(n, pa.int64())], schema=_SETS)
            own = bands.of(np.maximum(sizes, 1))
            for step in (0, 1):
                sig, _, kind, domain = signatures(flat, sizes, own - step, bands, {})
                if not len(sig):
                    continue
                sign = np.where(sig >> _U(63), 1, -1)
                at = (domain * GROUPS + kind) * CELLS + ((sig >> _U(40)) % _U(CELLS)).astype(np.int64)
                keys, where = np.unique(at, return_inverse=True)
                sums, number = np.bincount(where, sign, len(keys)).astype(np.int64), np.bincount(where, minlength=len(keys))
                n = len(keys)
                yield pa.RecordBatch.from_arrays([nulls(n, f.type) for f in list(_SETS)[:6]] + [
                    pa.array(keys // (GROUPS * CELLS), pa.int32()), pa.array(keys % (GROUPS * CELLS), pa.int32()), pa.array(sums), pa.array(number)], schema=_SETS)

    return arrow_map(run, _SETS)


def allocate(collide: np.ndarray, number: np.ndarray, mean: float) -> np.ndarray:
    """Weights (0, 1 or 2) of the kinds of segments of one domain.

    ``collide``: pairs of signatures that meet, by kind; ``number``: signatures; ``mean``: elements of a segment. A kind is skipped and
    another one gets weight 2 as long as that lowers signatures plus meetings.
    """
    weights = np.ones(GROUPS, np.int64)
    one = number + collide
    two = number * (1 + mean) + collide * (1 + 2 * mean)
    order = np.argsort(one, kind="stable")[::-1]
    for skip, pay in zip(order[:GROUPS // 2], order[::-1][:GROUPS // 2], strict=True):
        if one[skip] + one[pay] <= two[pay] or not number[pay]:
            break
        weights[skip], weights[pay] = 0, 2
    return weights


def plan_of(costs: DataFrame, bands: Bands) -> dict[int, np.ndarray]:
    """Weights by domain, from counters over all documents: at most ``GROUPS * CELLS`` rows for each of some hundred domains."""
    got = costs.where("domain is not null").groupBy("domain", "cell").agg(F.sum("sum").alias("sum"), F.sum("number").alias("number"))
    # The squares of signed counters add up to the sum of squared frequencies.
    rows = got.groupBy("domain", F.floor(F.col("cell") / CELLS).cast("int").alias("kind")).agg(
        F.sum(F.col("sum").cast("double") * F.col("sum")).alias("squares"), F.sum("number").alias("number")).collect()
    out = {}
    for d in {r["domain"] for r in rows}:
        squares, number = np.zeros(GROUPS), np.zeros(GROUPS)
        for r in rows:
            if r["domain"] == d:
                squares[r["kind"]], number[r["kind"]] = r["squares"], r["number"]
        mean = float(bands.starts()[d]) / segments_of(bands.weight(d)[0], np.ones(GROUPS, np.int64))
        if bands.weight(d)[0] > GROUPS:  # below, kinds do not all occur
            out[d] = allocate(np.maximum(squares - number, 0) / 2, number, mean)
    return out


def _emit(words: int, bands: Bands, plan: dict[int, np.ndarray]):
    """(signature, salt, node): once for each distinct set of a slice; a salt where a slice has very many nodes of a signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in slices(batches, size=SLICE):
            flat, sizes = shingles(cut.column("text"), words)
            x, _ = _keys(flat, sizes)
            own = bands.of(np.maximum(sizes, 1))
            first = np.zeros(len(x), bool)
            first[np.unique(x, return_index=True)[1]] = True
            own = np.where(first, own, -1)
            parts = [signatures(flat, sizes, own - step, bands, plan)[:2] for step in (0, 1)]
            sig, node = np.concatenate([p[0] for p in parts]), x[np.concatenate([p[1] for p in parts])]
            order = np.lexsort((node, sig))
            sig, node = sig[order], node[order]
            begins = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, int)
            counts = np.diff(np.append(begins, len(sig)))
            many = counts > HOT
            salt = np.zeros(len(sig), np.int64)
            if many.any():  # these meet by themselves; their first node goes on to meet all others
                lead = begins[many]
                salt[np.repeat(many, counts)] = x[0] | 1
                sig, salt, node = np.concatenate([sig, sig[lead]]), np.append(salt, np.zeros(len(lead), np.int64)), np.concatenate([node, node[lead]])
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(salt), pa.array(node)], schema=_SIGNED)

    return arrow_map(run, _SIGNED)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by signature, salt and node: each node but the first of a signature and salt, with the first."""
    last = last_first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, salt, node = (batch.column(c).to_numpy() for c in ("sig", "salt", "node"))
        begins = np.concatenate(([True], (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1])))
        at = np.flatnonzero(begins)
        firsts = node[at].copy()
        if last == (sig[0], salt[0]):
            firsts[0] = last_first
        first = firsts[np.cumsum(begins) - 1]
        last, last_first = (sig[-1], salt[-1]), first[-1]
        keep = node != first
        yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(first[keep]), pa.array(node[keep])], schema=_MET)


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_HELD = pa.schema([("element", pa.int64()), ("node", pa.int64()), ("root", pa.int64())])


def _verify(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in (c2 for c1 in slices(iter([batch]), "ta", SLICE) for c2 in slices(iter([c1]), "tb", SLICE)):
                n = cut.num_rows
                flat, sizes = shingles(pa.concat_arrays([cut.column("ta"), cut.column("tb")]), words)
                ends = np.cumsum(sizes)
                link = []
                for i in range(n):
                    a, b = flat[ends[i] - sizes[i]:ends[i]], flat[ends[n + i] - sizes[n + i]:ends[n + i]]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    link.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
                keep = pa.array(link, pa.bool_())
                yield pa.RecordBatch.from_arrays([cut.column("a").filter(keep), cut.column("b").filter(keep)], schema=_PAIR)

    return arrow_map(run, _PAIR)


def _elements(words: int):
    """One row for each element of a node's set, with the node's component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in slices(batches, size=SLICE):
            flat, sizes = shingles(cut.column("text"), words)
            of = [pa.array(np.repeat(cut.column(c).to_numpy(), sizes)) for c in ("node", "root")]
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), *of], schema=_HELD)

    return arrow_map(run, _HELD)


def may_link(na: Column, sa: Column, nb: Column, sb: Column, percent: int) -> Column:
    """Sizes and sketches allow a link. The longer of two sketches is folded to the length of the other: sizes allow a link only if it
    is at most twice as long."""

    def xor(x: Column, y: Column) -> Column:
        return F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))

    def halved(x: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return xor(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half))

    small, large = F.least(na, nb), F.greatest(na, nb)
    a, b = F.when(F.size(sa) > F.size(sb), halved(sa)).otherwise(sa), F.when(F.size(sb) > F.size(sa), halved(sb)).otherwise(sb)
    differ = F.aggregate(xor(a, b), F.lit(0), lambda t, x: t + F.bit_count(x))
    sized = percent * large <= 100 * small
    return F.when(sized, (F.size(a) != F.size(b)) | (differ <= na + nb - 2 * F.ceil(percent * (na + nb) / (100 + percent)))).otherwise(False)


def folded(sketch: Column) -> Column:
    """A sketch of at most ``MIDDLE`` words."""
    word = F.sequence(F.lit(0), F.lit(MIDDLE - 1))
    return F.when(F.size(sketch) <= MIDDLE, sketch).otherwise(F.transform(word, lambda i: F.aggregate(
        F.sequence(i, F.size(sketch) - 1, F.lit(MIDDLE)), F.lit(0).cast("long"), lambda t, k: t.bitwiseXOR(F.get(sketch, k)))))


def texts_for(needed: DataFrame, docs: DataFrame) -> DataFrame:
    """Stored rows of nodes led by documents ``rep``, with the ``text`` of those."""
    ids = needed.select(F.col("rep").alias("doc_id"))
    if needed.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    texts = docs.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return needed.join(texts, needed["rep"] == texts["doc_id"]).drop("doc_id")


def pairs_across(sets: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs ``a < b`` of stored rows ``node, root, n, rep, sketch`` with different roots that may link: all that do are among them."""
    held = texts_for(sets.select("node", "root", "rep"), docs).select("node", "root", "text")
    # Windows sort once and spill; a table of all elements to join with would take memory for each that only one set holds.
    alike = Window.partitionBy("element")
    frequent = held.mapInArrow(_elements(words), "element long, node long, root long").withColumns(
        {"size": F.count(F.lit(1)).over(alike), "lo": F.min("root").over(alike), "hi": F.max("root").over(alike)}).where("lo <> hi")
    # How many elements a set has from each one on, in the common order from rare to frequent.
    rest = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("size"), F.desc("element")))
    rare = frequent.drop("root", "hi").withColumn("rest", rest).join(sets.select("node", "root", "n", folded(F.col("sketch")).alias("sketch")), "node")
    rare = materialise(rare.where(100 * F.col("rest") >= percent * F.col("n")).drop("size"), "rare")
    a, b = (rare.select("element", *(F.col(c).alias(c + s) for c in ("node", "root", "n", "rest", "sketch", "lo"))) for s in "ab")
    once = (F.col("roota") != F.col("loa")) & (F.col("roota") != F.col("rootb")) & ((F.col("rootb") == F.col("loa")) | (F.col("nodea") < F.col("nodeb")))
    left = (100 + percent) * F.least("resta", "restb") >= percent * (F.col("na") + F.col("nb"))
    met = a.join(b, "element").where(once & left & may_link(F.col("na"), F.col("sketcha"), F.col("nb"), F.col("sketchb"), percent))
    return met.select(F.least("nodea", "nodeb").alias("a"), F.greatest("nodea", "nodeb").alias("b")).distinct()


def links_of(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs of nodes ``a``, ``b`` whose sets link, verified on the texts of their documents."""
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "rep"), "node")
    texts = texts_for(materialise(needed, "needed"), docs).select("node", "text")
    both = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "tb"}), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(_verify(words, percent), "a long, b long")


def join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per input row; two documents link when their Jaccard similarity is at
    least ``percent`` / 100, and ``component_id`` is the least id reachable by links.

    Null and empty texts, and texts without words, have no shingles and link with nothing. Rows that repeat come back as often; rows
    with one id are one document of the join, its least text standing for it where a pair is verified. A row without an id has no component. Elements are 64-bit hashes,
    sets are told apart by 128 bits.
    """
    bands = Bands(percent)
    docs = texts_of(docs)
    counted = materialise(docs.mapInArrow(_sets(words, bands), "doc_id long, n long, x long, y long, small array<long>, sketch array<long>, domain int, cell int, sum long, number long"), "sets")
    sets = counted.where("domain is null")
    # x alone is the node: a node is led by the set with the least document.
    classes = sets.where("x is not null and doc_id is not null").groupBy("x", "y").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("small").alias("small"), F.first("sketch").alias("sketch"))
    nodes = materialise(classes.withColumnRenamed("x", "node"), "nodes")
    plan = plan_of(counted, bands)
    named = docs.where("doc_id is not null")
    met = materialise(dealt(named.select("text").mapInArrow(_emit(words, bands, plan), "sig long, salt long, node long"), ["sig", "salt"], "node")
                      .mapInArrow(arrow_map(_meet, _MET), "sig long, first long, node long"), "met")

    def informed(pairs: DataFrame, sketch: str) -> DataFrame:
        a, b = (nodes.select(F.col("node").alias(s), F.col("n").alias("n" + s), F.col(sketch).alias("s" + s)) for s in "ab")
        return pairs.join(a, "a").join(b, "b").where(may_link(F.col("na"), F.col("sa"), F.col("nb"), F.col("sb"), percent)).select("a", "b")

    # The short sketches drop most pairs, the long ones nearly all others that do not link.
    stars = materialise(informed(met.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "small"), "stars")
    stars = materialise(informed(stars, "sketch"), "stars")
    links = materialise(links_of(stars, nodes, named, words, percent), "links")
    roots = components(links)

    # Buckets that are not in one component yet.
    met_in = met.join(roots.withColumnRenamed("node", "first").withColumnRenamed("root", "rf"), "first", "left").join(roots.withColumnRenamed("root", "rn"), "node", "left")
    met_in = met_in.select("sig", "first", "node", F.coalesce("rf", "first").alias("rf"), F.coalesce("rn", "node").alias("rn"))
    open_ = met_in.groupBy("sig").agg(F.min(F.least("rf", "rn")).alias("lo"), F.max(F.greatest("rf", "rn")).alias("hi")).where("lo <> hi").select("sig")
    inside = met_in.join(open_, "sig")
    members = inside.select("sig", F.col("first").alias("node"), F.col("rf").alias("root")).unionByName(inside.select("sig", "node", F.col("rn").alias("root"))).distinct()
    members = materialise(members, "members")
    # Every set leaves its largest buckets out, as far as they weigh less than what two sets that link share.
    sizes = members.groupBy("sig").agg(F.count(F.lit(1)).alias("size"))
    domain = F.shiftrightunsigned(F.col("sig").bitwiseAND(511), 1).cast("int")
    largest = Window.partitionBy("node", "domain").orderBy(F.desc("size"), "sig").rowsBetween(Window.unboundedPreceding, 0)
    members = members.join(sizes, "sig").withColumn("domain", domain).withColumn("upto", F.sum(1 + F.col("sig").bitwiseAND(1)).over(largest))
    members = members.join(nodes.select("node", "n"), "node").where(F.col("upto") >= bands.shared(F.col("domain"), F.col("n")))
    members = materialise(members.select("sig", "node", "root"), "members")
    still = members.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("sig")
    sets_left = materialise(members.join(still, "sig").select("node", "root").distinct().join(nodes.select("node", "n", "rep", "sketch"), "node"), "left")
    # All pairs across components that sizes, elements and sketches allow.
    rest = materialise(pairs_across(sets_left, named, words, percent), "pairs")  # else each element that two sets share would be compared with the stars
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = materialise(rest.join(tested, ["a", "b"], "left_anti"), "rest")
    if rest.take(1):
        rest = materialise(informed(rest, "sketch"), "rest")
        links = links.unionByName(links_of(rest, nodes, named, words, percent))
    # Components over documents: a node is all sets of its hash, led by the least document each.
    ends = links.join(nodes.select(F.col("node").alias("a"), F.col("rep").alias("ra")), "a").join(nodes.select(F.col("node").alias("b"), F.col("rep").alias("rb")), "b")
    same = sets.where("x is not null and doc_id is not null").select("doc_id", "x", "y").distinct().join(nodes.select(F.col("node").alias("x"), "y", "rep"), ["x", "y"])
    # A document with several rows of other texts holds their classes together.
    several = same.where("doc_id <> rep").join(nodes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("ra"), F.col("rep").alias("rb"))
    final = components(ends.select("ra", "rb").unionByName(several), "ra", "rb").withColumnRenamed("node", "rep")
    rooted = nodes.select(F.col("node").alias("x"), "y", "rep").join(final, "rep", "left").select("x", "y", F.coalesce("root", "rep").alias("root"))
    out = sets.select("doc_id", "n", "x", "y").join(rooted, ["x", "y"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the document with the least id, once; rows without an id stay.

    Rows that share an id are one document only if they share the text: each text of an id is compared, and stays or goes, by itself. Null and empty texts, and
    texts without words, are nobody's duplicates, but of such rows with one id and text one stays. All columns come back, whatever their
    names; an empty table stays empty.
    """
    new = "_" * (1 + max(len(c) for c in docs.columns))  # longer than any name there is
    ident, text, number, own = (new + c for c in ("id", "text", "number", "own"))
    keyed = docs.withColumns({ident: F.col("doc_id").cast("long"), text: F.xxhash64("text")})
    named = keyed.where(F.col(ident).isNotNull()).select(ident, text)
    if not named.groupBy(ident).agg((F.min(text) < F.max(text)).alias("several")).where("several").take(1):
        return _least_ids(docs, words, percent, new)
    # Numbers in the order of the ids, one for each text of an id.
    numbers = materialise(named.distinct().orderBy(ident, text).withColumn(number, F.monotonically_increasing_id()), "numbers")
    numbered = keyed.join(numbers, [ident, text], "left").withColumnsRenamed({"doc_id": own}).withColumnsRenamed({number: "doc_id"}).drop(ident, text)
    kept = _least_ids(materialise(numbered, "numbered"), words, percent, new)
    return kept.drop("doc_id").withColumnsRenamed({own: "doc_id"}).select(*(f"`{c}`" for c in docs.columns))


def _least_ids(docs: DataFrame, words: int, percent: int, new: str) -> DataFrame:
    """``deduplicated`` for rows that share their text wherever they share an id. Names that begin with ``new`` are free."""
    joined = join(docs, words, percent)
    gone, many, row = (new + c for c in ("gone", "many", "row"))
    going = materialise(joined.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct(), "gone")
    left = docs.join(going, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
    repeated = joined.where("doc_id is not null").groupBy(F.col("doc_id").alias(many)).count().where("count > 1").select(many)
    if not repeated.take(1):
        return left
    again = left.join(repeated, F.col("doc_id").cast("long") == F.col(many), "left_semi")
    by = Window.partitionBy("doc_id").orderBy(F.xxhash64(*(f"`{c}`" for c in docs.columns)))
    once = again.withColumn(row, F.row_number().over(by)).where(F.col(row) == 1).drop(row)
    return left.join(repeated, F.col("doc_id").cast("long") == F.col(many), "left_anti").unionByName(once)
