"""Scores of the two classifiers against the same methods in plain Python."""

from pyspark.sql import functions as F

from skerry.llm import quality, toxicity

from .plain import quality_scores, toxic_scores
from .test_text_operators import labelled

SHOUTS = ["YOU ARE ALL FOOLS AND NOBODY LIKES ANY OF YOU", "what!!! a da*n id*ot", "é É ÀÀÀ", ""]


def test_toxicity_by_force(spark):
    docs, labels, told = labelled(spark, 11)
    docs = docs.unionByName(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(SHOUTS)], "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = toxic_scores(rows, {i: t for i, _, t in told if i % 3 != 1})
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels, F.col("doc_id") % 3 != 1)).collect()}
    assert len({round(x, 3) for x in want.values()}) > 20
    assert max(abs(got[i] - want[i]) for i in want) < 2e-3
    assert got.keys() == want.keys()


def test_quality_by_force(spark):
    docs, labels, told = labelled(spark, 12)
    docs = docs.unionByName(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(SHOUTS)], "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = quality_scores(rows, {i: q for i, q, _ in told if i % 5 != 0})
    got = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels, F.col("doc_id") % 5 != 0)).collect()}
    assert len({round(x, 6) for x in want.values()}) > 20
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6
    assert got.keys() == want.keys()


def test_whole_labelled_texts_reach_the_dictionary(spark):
    docs = spark.createDataFrame([(1, "".join(chr(97 + (k * k) % 26) for k in range(40_000)))], "doc_id long, text string").withColumn("label", F.lit(1))
    assert sum(len(c) for _, c in quality.sample_chunks(docs)) == 40_000
