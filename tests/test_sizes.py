"""What keeps long texts and many words small, against plain Python."""

import math
import re

import pyarrow as pa
from pyspark.sql import functions as F

from veilspark.functions import columns as fn
from veilspark.operators import detect, subwords
from veilspark.operators import tokens as tk
from veilspark.plans import pipeline


def test_texts_in_parts():
    texts = [None, "", "  x", "a\x1cb\x85c　d\U0001f600 e\x0b", "x" * 50, *["ab  cd\n"] * 40]
    parts = tk.parts(pa.array(texts), 60)
    assert len(parts) > 4 and [t for p in parts for t in p] == [t or "" for t in texts]
    got = tk._joined([tk._words(p) for p in parts]).to_pylist()
    assert got == [[{"idx": i, "token": m[0], "s": m.start(), "e": m.end()} for i, m in enumerate(re.finditer(r"\S+", t or ""))] for t in texts]
    assert tk.parts(pa.array([], pa.string())) == [[]] and tk._joined([tk._words([])]).to_pylist() == []


def _evaluations(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_subwords_are_cut_once(spark):
    docs = spark.createDataFrame([("a", "one two"), ("b", "")], "doc_id string, text string")
    assert _evaluations(subwords.windowed(docs, subwords.DEFAULT, "doc_id")) == 1


def test_batches_are_bounded(spark):
    @F.arrow_udf("int")
    def rows(column: pa.Array) -> pa.Array:
        return pa.array([len(column)] * len(column), pa.int32())

    tk.bounded_batches(spark)
    texts = spark.range(0, 9000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("t"))
    assert texts.select(rows("t").alias("n")).agg(F.max("n")).first()[0] < 4000


def test_matches_are_searched_once(spark):
    docs = spark.createDataFrame([(1, "call 555-123-4567 or 555-123-4567")], "doc_id long, text string")
    plan = detect.with_matches(docs).where(F.exists("matches", lambda m: m["valid"])).select(F.size("matches"), detect.resolve(F.col("matches")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CREDITCARDNUMBER") == 1


def test_softmax_of_many_rows(spark):
    rows = [(0, [1.0, 3.0, 3.0]), (1, None), (3, [0.5]), (4, [1.0, None, 2.0]), (5, [-4.0, 2.0, 1.0, 0.0])]
    got = spark.createDataFrame(rows, "k int, z array<double>").select("k", fn.softmax_rows("z").alias("a"), fn.softmax_stats(F.col("z")).alias("b")).collect()
    for r in got:
        for name in ("entropy", "confidence", "pred"):
            a, b = r.a[name], r.b and r.b[name]
            assert (a is None and b is None) or math.isclose(a, b, abs_tol=1e-12), (r.k, name, a, b)


def test_context_of_a_long_text(spark):
    """Boundaries near the target, and so far that the whole text is needed."""
    texts = ["word " * 1000, "x" * 4000, "a b" + "x" * 3000 + ". y" + "z" * 900, "é😀 " * 700]
    rows = [(t, s, s + 5) for t in texts for s in (0, 3, 300, 399, 656, 657, 700, 1500, len(t) - 5)]
    got = spark.createDataFrame(rows, "t string, s int, e int").select(fn.context(F.col("t"), F.col("s"), F.col("e")).alias("a"), fn._context(F.col("t"), F.col("s"), F.col("e"), 400).alias("b")).collect()
    assert all(r.a == r.b for r in got)


def test_only_samples_with_matches_are_folded(spark):
    samples = spark.createDataFrame([("a", "mail a.berg@example.com now"), ("b", "nothing here"), ("c", None)], "sample_id string, text string")
    rows = [(k, i, w, t.index(w), t.index(w) + len(w), "O") for k, t in (("a", "mail a.berg@example.com now"), ("b", "nothing here"), ("c", "lost")) for i, w in enumerate(t.split())]
    tokens = spark.createDataFrame(rows, "sample_id string, idx int, token string, s int, e int, label string")
    found = detect.matches(samples, "sample_id")
    one, two = (sorted(map(tuple, pipeline.promote(tokens, samples, found=f).collect())) for f in (None, found))
    assert one == two and ("a", 1, "a.berg@example.com", 5, 23, "B-EMAIL") in two
