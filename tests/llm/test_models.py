"""Trained operators: held-out accuracy, exact counts, and seats taken one by one."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rfsense.llm import pitman_yor, quality
from rfsense.llm.queries import QUERIES
from tests.conftest import SF
from tests.llm.conftest import ROWS, text_of

SF01 = "/root/testdata/sf0.01"


def test_quality_on_labels_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    fit = labels.where("doc_id % 3 <> 0")
    got = quality.scored(docs, quality.train(docs, fit)).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    assert got["accepted"][got["quality"] == 1].mean() >= 0.98
    assert (~got["accepted"][got["quality"] == 0]).mean() >= 0.9
    assert len(QUERIES["op3_quality"](spark, SF).collect()) == docs.sparkSession.read.parquet(f"{SF}/documents.parquet").count()


def test_views_teach_each_other(spark):
    """The page tells the class; only few labels do. The text model learns from documents that the page view is sure of."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["zig", "zag", "blip"] if i % 2 else ["calm", "deep", "lake"], 30)), "en", f"site{i % 2}", 200) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(60)], "doc_id long, quality int")
    got = quality.scored(docs, quality.train(docs, labels, sure=0.8)).toPandas()
    assert (got["accepted"] == (got["doc_id"] % 2 == 0)).mean() > 0.99


def test_quality_of_odd_documents(odd, none, spark):
    labels = spark.createDataFrame([(0, 1), (0, 0), (4, 1), (5, 0), (8, 0), (9, None), (None, 1), (99, 1)], "doc_id long, quality int")
    classifier = quality.train(odd, labels)
    got = quality.scored(odd, classifier)
    assert got.count() == len(ROWS) and got.where("score is null or accepted is null").count() == 0
    assert quality.accepted(odd, classifier).columns == odd.columns
    assert quality.scored(none, quality.train(none, labels)).count() == 0
    nothing = quality.train(odd, labels.limit(0))
    assert quality.scored(odd, nothing).where("accepted").count() == len(ROWS)
    ones = quality.train(odd, labels.where("quality = 1"))
    assert quality.scored(odd, ones).where("accepted").count() == len(ROWS)


def test_features_do_not_depend_on_the_batch():
    texts = pa.array([text_of(r) for r in ROWS])
    whole = quality.text_features(texts)
    each = np.concatenate([quality.text_features(texts.slice(i, 1)) for i in range(len(texts))])
    assert np.allclose(whole, each)


def tokens_of(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def base_by_hand(rows):
    train = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1 for i, _ in rows]
    c = Counter(w for (_, t), k in zip(rows, train, strict=True) if k for w in tokens_of(t))
    n, v = sum(c.values()), len(c)
    return [(i, not k, len(tokens_of(t)), sum(w in c for w in tokens_of(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens_of(t)), 6))
            for (i, t), k in zip(rows, train, strict=True)]


def base(got):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str)


@pytest.mark.parametrize("parts", [10, 1_000_000])
def test_counts_and_base(spark, odd, none, parts):
    rows = [(r[0], r[1]) for r in ROWS]
    got = pitman_yor.scores(odd, part_tokens=parts).collect()
    assert base(got) == sorted(base_by_hand(rows), key=str)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert pitman_yor.scores(none).count() == 0
    only = odd.where("doc_id is not null").where("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 1")
    assert 0 < only.count() == pitman_yor.scores(only).where("n_known = 0 and train_tokens = 0 and base_score = 0").count()


def test_query_counts(spark, table):
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    got = QUERIES["op6_pitman_yor"](spark, SF).collect()
    assert base(got) == sorted(base_by_hand(rows), key=str)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def model_by_hand(rows, sweeps):
    """The same model over plain dictionaries, with the same tables for the same counts."""
    D, S = pitman_yor.DISCOUNT, pitman_yor.STRENGTH
    docs = [(tokens_of(t), zlib.crc32(str(i).encode()) % 5 != 1) for i, t in rows]
    pairs, cu, c = Counter(), Counter(), Counter()
    for toks, k in docs:
        if k:
            c.update(toks)
            before = [b"\t", *toks[:-1]]
            pairs.update(zip(before, toks, strict=True))
            cu.update(before)
    h = {w: np.uint64(pitman_yor.xxhash.xxh3_64_intdigest(w)) for toks, _ in docs for w in [b"\t", *toks]}
    n, v = sum(c.values()), len(c)
    counts = {**c, b"\t": cu[b"\t"]}
    mix, U = pitman_yor.mix, np.uint64
    with np.errstate(over="ignore"):
        def pair_hash(u, w):
            return mix(mix(np.array([h[u]])) + h[w])

        def seat(customers, new, d, seed):
            return pitman_yor.tables(np.array([customers]), np.array([new]), d, seed)[0]

        p = {w: (counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1)) for w in h}
        own = {w: counts.get(w, 0) ** 0.8 for w in h}
        above, kept = v, []
        for s in range(sweeps):
            t = {(u, w): seat(k, (S[1] + D[1] * own[u]) * p[w], D[1], mix(pair_hash(u, w) + U(1000 + s))) for (u, w), k in pairs.items()}
            up, new_own = Counter(), Counter()
            for (u, w), k in t.items():
                up[w] += k
                new_own[u] += k
            # a part tells words apart by 40 bits of their hash, and seats them by these
            t1 = {w: seat(int(k), (S[0] + D[0] * above) / (v + 1), D[0], mix(np.array([h[w] & U((1 << 40) - 1)]) + U(s))) for w, k in up.items()}
            total, above = sum(up.values()), sum(t1.values())
            back = (S[0] + D[0] * above) / (S[0] + total)
            p = {w: max(up[w] - D[0] * t1.get(w, 0), 0) / (S[0] + total) + back / (v + 1) for w in h}
            own = {w: new_own[w] for w in h}
            kept.append((t, p, own))
    out = {}
    for (i, _), (toks, _) in zip(rows, docs, strict=True):
        score = 0.0
        for u, w in zip([b"\t", *toks[:-1]], toks, strict=True):
            probs = [(max(pairs[u, w] - D[1] * t.get((u, w), 0), 0) + (S[1] + D[1] * own[u]) * p[w]) / (S[1] + counts[u]) if counts.get(u) else p[w] for t, p, own in kept]
            score += math.log10(sum(probs) / len(probs))
        out[i] = score
    return out


def test_model_by_hand(spark, table):
    """Nearly: the order in which sums reach a float may move a seat."""
    rows = [(r.doc_id, r.text) for r in table("documents").collect()][:60]
    got = {r.doc_id: r.score for r in pitman_yor.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), part_tokens=500).collect()}
    want = model_by_hand(rows, pitman_yor.SWEEPS)
    assert all(abs(got[i] - want[i]) < 1e-6 * abs(want[i]) + 1e-6 for i in want)


def test_tables_are_seated_as_a_restaurant():
    """Means and spread of the number of tables as with customers seated one by one at random."""
    rng = np.random.default_rng(5)
    for c, new, d in ((2, 0.3, 0.8), (10, 1.0, 0.5), (60, 2.0, 0.8), (500, 0.7, 0.8)):
        got = pitman_yor.tables(np.full(4000, c), np.full(4000, new), d, rng.integers(0, 2**63, 4000).astype(np.uint64))
        want = np.ones(4000)
        for i in range(1, c):
            want += rng.random(4000) < new / (new + i - d * want)
        assert abs(got.mean() - want.mean()) < 5 * want.std() / 4000**0.5 + 0.02 * want.mean()
        assert got.min() >= 1 and got.max() <= c
    assert pitman_yor.tables(np.array([0, 1]), np.array([5.0, 5.0]), 0.8, np.zeros(2, np.uint64)).tolist() == [0, 1]


def test_session_setting_stays(spark, odd):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    pitman_yor.scores(odd.where(F.col("doc_id") == 0))
    assert spark.conf.get(key) == before and not [t for t in spark.catalog.listTables() if t.name.startswith("blocks_")]
