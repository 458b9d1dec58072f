"""The corpus pipeline, stage by stage and as a whole."""

import corpus_pipeline
from rfsense.llm import packing, secrets
from rfsense.llm.queries import WORD_BPE
from tests.conftest import SF
from tests.llm.conftest import ROWS
from tests.llm.test_jaccard import by_hand
from tests.llm.test_secrets_sharding import base
from tests.llm.test_tokens import check_packing

SF01 = "/root/testdata/sf0.01"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_quality_keeps_good_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    kept = stage("quality classifier")(spark, docs, SF01)
    assert kept.columns == docs.columns
    known = labels.join(kept.selectExpr("doc_id", "true as kept"), "doc_id", "left").toPandas()
    assert (known["kept"] == True)[known["quality"] == 1].mean() >= 0.99  # noqa: E712
    assert known["kept"].isna()[known["quality"] == 0].mean() >= 0.9


def test_one_of_each(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = stage("n-gram Jaccard join")(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in by_hand(rows, 5, 80)})


def test_texts_of_one_id_are_documents_of_their_own(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a, "x"), (1, b, "x"), (1, a, "y"), (1, "", "x"), (2, b + " more", "x"), (3, a, "x"), (None, a, "x"), (0, "c " + b, "x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    kept = stage("n-gram Jaccard join")(spark, docs, SF)
    assert kept.schema == docs.schema
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, ""), (None, a), (0, "c " + b)], key=str)


def test_secrets_are_masked(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    clean = stage("secret scans")(spark, docs, SF01)
    assert clean.columns == docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    changed = 0
    for r in clean.collect():
        old = before.pop(r.doc_id)
        if base(old.text):
            changed += 1
            assert corpus_pipeline.MASK in r.text and not base(r.text) and r.n_chars == len(r.text)
        elif r.text != old.text:
            assert corpus_pipeline.MASK in r.text
        else:
            assert r == old
    assert not before and changed > 5


def test_run(spark):
    """Every stage over what the one before kept; the sequences hold exactly the last documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, apply in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(apply(spark, docs, SF).collect(), docs.schema)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    made, least = check_packing(corpus_pipeline.run(spark, SF).collect(), rows, 2048)
    assert made <= least + 2


def test_odd_documents(spark, odd, none):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, apply in corpus_pipeline.STAGES[:-1]:
        assert apply(spark, docs, SF).columns == docs.columns
        assert apply(spark, none, SF).count() == 0
    masked = {r.doc_id: r for r in corpus_pipeline.without_secrets(spark, odd.selectExpr("*", "'k' as kinds"), SF).collect()}
    assert masked[1].text is None and masked[6].ids == ROWS[7][1]
    assert corpus_pipeline.sequences(spark, none, SF).count() == 0


def test_general_outputs(spark):
    docs = spark.createDataFrame([(1, "token = abcdefgh12345678")], "doc_id long, text string")
    found = secrets.scan(docs, secrets.train(docs)).collect()[0]
    assert (found.starts, found.ends, found.kinds) == ([0], [24], ["assign"])
    assert packing.packed(docs, WORD_BPE, 8, None, with_ids=True).count() >= 1
