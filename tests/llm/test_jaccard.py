"""The n-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rfsense.llm import jaccard
from rfsense.llm.queries import QUERIES
from tests.conftest import SF
from tests.llm.conftest import ROWS, text_of


def elements(text, words):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def by_hand(rows, words, percent):
    sets = [elements(t, words) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both) and None not in (rows[i][0], rows[j][0]):
                x, y = find(rows[i][0]), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        k = rng.randrange(len(out)) if out else 0
        out[k:k + rng.randint(0, 1)] = [f"w{rng.randrange(5000)}"] * rng.randint(0, 1)
    return out


def corpus(seed):
    """Families whose members differ by a few edits, about the threshold; short texts; a passage that many share."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 5, 8, 15, 40, 150, 700]))]
        texts += [" ".join(edited(rng, base, rng.choice([0, 1, 1, 2, 3, 5, len(base) // 40 + 1]))) for _ in range(8)]
    texts += [" ".join([*passage, *(f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 10, 60])))]) for _ in range(30)]
    texts += ["a", "A", "a b", "a b c", "a B c", "", None, "a b c d", "b c d e"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("words, percent, hot, weights", [(4, 85, 32, None), (5, 80, 2, None), (4, 85, 32, "mixed"), (2, 60, 3, "mixed"), (3, 95, 32, None)])
def test_components(spark, monkeypatch, words, percent, hot, weights):
    monkeypatch.setattr(jaccard, "HOT", hot)
    if weights:  # skip some kinds of segments and use one-deletion neighbourhoods for others
        mixed = np.array([0, 2, 1, 2, 0, 1, 1, 1] * 2)
        monkeypatch.setattr(jaccard, "plan_of", lambda costs, bands: dict.fromkeys(range(60), mixed))
    rows = corpus(words * percent)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words, percent).collect()
    want = by_hand(rows, words, percent)
    assert sorted(map(tuple, got), key=str) == want
    assert sum(i != c for i, _, c in want) > 20


def test_odd_texts(spark, odd, none):
    rows = [(r[0], text_of(r)) for r in ROWS]
    assert sorted(map(tuple, jaccard.join(odd, 4, 85).collect()), key=str) == by_hand(rows, 4, 85)
    assert jaccard.join(none, 4, 85).count() == 0


def test_many_copies(spark):
    """A third of all rows is one text, another third its near copies: one component, and no row of pairs for them."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words)) for i in range(0, 900, 3)] + [(i, " ".join([*words[:i % 190], "x%d" % i, *words[i % 190 + 1:]])) for i in range(1, 900, 3)]
    rows += [(i, " ".join(f"{i}-{k}" for k in range(50))) for i in range(2, 900, 3)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 4, 85).collect()
    assert {r.component_id for r in got if r.doc_id % 3 < 2} == {0}
    assert all(r.component_id == r.doc_id for r in got if r.doc_id % 3 == 2)


def test_query(spark, table):
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    assert sorted(map(tuple, QUERIES["op7_jaccard"](spark, SF).collect()), key=str) == by_hand(rows, 4, 85)


def test_bands_hold_all_links():
    for percent in (60, 80, 85, 95):
        bands = jaccard.Bands(percent)
        for a in range(1, 400):
            for b in (a, a * 100 // percent):
                da, db = bands.of(np.array([a, b]))
                assert db in (da, da + 1)
                common = -(-percent * (a + b) // (100 + percent))
                assert a + b - 2 * common <= bands.differ(int(da))


def test_allocation_skips_what_collides():
    number, collide = np.full(jaccard.GROUPS, 1000.0), np.full(jaccard.GROUPS, 10.0)
    assert (jaccard.allocate(collide, number, 6.0) == 1).all()
    collide[3] = 1e6
    weights = jaccard.allocate(collide, number, 6.0)
    assert weights[3] == 0 and (weights == 2).sum() == 1 and weights.sum() == jaccard.GROUPS


def test_deduplicated(spark, odd):
    kept = jaccard.deduplicated(odd, 5, 80)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None], key=str)


def test_long_texts_around_one_passage(spark):
    """Long texts that share a passage meet by chance and link with nothing but their edits; no pairs of the others are compared in full."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(80)]
    rows = []
    for i in range(0, 240, 2):
        own = [f"w{rng.randrange(400)}" for _ in range(rng.choice([700, 1500]))]
        at = rng.randrange(len(own))
        text = own[:at] + passage + own[at:]
        rows += [(i, " ".join(text)), (i + 1, " ".join(edited(rng, text, 4)))]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 5, 80).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows, 5, 80)


@pytest.mark.parametrize("extra", [0, 12, 40])
def test_short_texts_around_one_passage(spark, extra):
    """A third of all short texts holds one passage; some differ from others by a word."""
    rng = random.Random(extra)
    passage = [f"p{i}" for i in range(25)]
    rows = [(i, " ".join([*passage, *(f"w{rng.randrange(60)}" for _ in range(extra))] if i % 3 == 0 else [f"w{rng.randrange(3000)}" for _ in range(30)])) for i in range(450)]
    rows += [(1000 + i, " ".join(edited(rng, t.split(), 1))) for i, t in rows[:60]]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4, 85).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows, 4, 85)


def test_deduplicated_with_names_of_its_own(spark):
    """Columns of any name come back, also with several texts under one id."""
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words), (1, words), (2, words + " x"), (2, "another text of its own kind"), (3, None), (3, None), (4, "")]
    for names in (["_gone", "_many", "_row"], ["_id", "_text", "_number", "_own"], ["__id", "___gone"]):
        docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names))
        for some in (docs, docs.where("doc_id <> 2")):
            kept = jaccard.deduplicated(some, 5, 80)
            assert kept.columns == some.columns and kept.select(names[0]).distinct().count() == 1
        assert sorted((r.doc_id, r.text or "") for r in jaccard.deduplicated(docs, 5, 80).collect()) == [(1, words), (2, "another text of its own kind"), (3, ""), (4, "")]


def test_versions_below_the_threshold(spark, monkeypatch):
    """Versions of one long text that share most segments and do not link are not compared in pairs; those that do link are found."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(1200)]

    def version(of, edits):
        out = list(of)
        for k in rng.sample(range(len(out)), edits):
            out[k] = f"v{k}-{rng.randrange(4)}"  # others make the same edit
        return out

    versions = [version(base, rng.choice([45, 60, 80])) for _ in range(150)]
    rows = [(i, " ".join(v)) for i, v in enumerate([*versions, *(version(v, rng.choice([10, 20, 24])) for v in versions[:60])])]
    counts, write = {}, jaccard.materialise
    monkeypatch.setattr(jaccard, "materialise", lambda df, name: counts.update({name: (out := write(df, name)).count()}) or out)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4, 85).collect()
    want = by_hand(rows, 4, 85)
    assert sorted(map(tuple, got), key=str) == want
    assert sum(i != c for i, _, c in want) > 20
    assert counts["pairs"] <= 2 * len(rows)


def test_shared_weight_holds_for_all_links(spark):
    """A set's own weight is at least its domain's, and at most what it shares with any set it links with beyond empty segments."""
    for percent in (60, 85, 95):
        bands = jaccard.Bands(percent)
        starts = bands.starts()
        sizes = [(d, n) for n in range(1, 300) for d in {int(bands.of(np.array([n]))[0]) - k for k in (0, 1)} if d >= 0]
        got = spark.createDataFrame(sizes, "d int, n long").withColumn("shared", bands.shared(F.col("d"), F.col("n"))).collect()
        for d, n, shared in got:
            total, empty, least = bands.weight(d)
            partners = [m for m in range(-(-percent * n // 100), n * 100 // percent + 1) if starts[d] <= min(m, n) < starts[d + 1] and max(m, n) < starts[d + 2]]
            assert shared >= least
            assert all(total - empty + 1 - (n + m - 2 * -(-percent * (n + m) // (100 + percent))) >= shared for m in partners)
