from pyspark.sql import functions as F

from veilspark.operators.order import written
from veilspark.plans import pipeline


def test_words_carry_what_is_asked_for(spark, monkeypatch):
    """After the arbiter's stage the words of a system have no columns that only an analysis shows."""
    kept = []
    monkeypatch.setattr(pipeline, "written", lambda df: kept.append(df.columns) or written(df))
    samples = spark.createDataFrame([("a", "mail now")], "sample_id string, text string")
    scored = spark.createDataFrame([("a", i, w, s, s + len(w), [1.0] + [0.0] * 40) for i, (w, s) in enumerate([("mail", 0), ("now", 5)])], "sample_id string, idx int, token string, s int, e int, logits array<double>")
    assert pipeline.hybrid_system(samples, scored, version=1).count() == 2
    words = [set(c) for c in kept if "token" in c]
    assert len(words) == 2 and "entropy" in words[0] and words[-1] == {"sample_id", "idx", "token", "s", "e", "label"}


def test_written_numbers(spark):
    rows = spark.range(0, 50_000, 1, 2).select("id", (F.col("id") * 7 % 5000).cast("int").alias("s"), F.array(F.col("id")).alias("list"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("gap"))
    assert sorted(map(tuple, written(rows).collect())) == sorted(map(tuple, rows.collect()))
