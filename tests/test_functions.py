"""Hand-computed expectations of the scalar operators."""

import pytest
from pyspark.sql import functions as F

from veilspark.functions import columns as fn
from veilspark.functions.registry import NEMOTRON_CLEAN, NEMOTRON_EXCLUDED, NEMOTRON_FULL, PATTERNS, PII_CLASSES, UNIFIED, bio_labels


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_registry():
    assert len(bio_labels(PII_CLASSES)) == 41 and len(PATTERNS) == 10 and sum(map(len, UNIFIED.values())) == len(PII_CLASSES)
    assert set(NEMOTRON_FULL) == set(NEMOTRON_CLEAN) | set(NEMOTRON_EXCLUDED)


def test_checksums(spark):
    rows = [("4111 1111 1111 1111",), ("1234-5678-9012-3456",), ("4532881190007654",), ("1234567890123452",), ("",), (None,)]
    got = values(spark, rows, "x string", fn.luhn(F.col("x")), fn.card(F.col("x")))
    assert [g[0] for g in got] == [True, False, False, True, False, None]
    assert [bool(g[1]) for g in got] == [True, False, True, True, False, False]
    assert [g[0] for g in values(spark, [("555-01-4433",), ("000-12-3456",), ("123-00-1234",), ("123-45-0000",), ("1",)], "x string", fn.ssn(F.col("x")))] == [True, False, False, False, False]
    assert [g[0] for g in values(spark, [("DE89370400440532013000",), ("DE89370400440532013001",), ("GB82 WEST 1234 5698 7654 32",), ("de123456789",), ("",)], "x string", fn.iban(F.col("x")))] == [True, False, True, False, False]


def test_uncertainty(spark):
    (row,) = values(spark, [([2.0, 1.0, 0.0],)], "z array<double>", fn.softmax_stats(F.col("z"))["entropy"], fn.softmax_stats(F.col("z"))["confidence"], fn.softmax_stats(F.col("z"))["pred"], fn.normalized_entropy(fn.softmax_stats(F.col("z"))["entropy"], F.lit(3)))
    assert row[0] == pytest.approx(0.83239558, abs=1e-8) and row[1] == pytest.approx(0.66524096, abs=1e-8) and row[2] == 0 and row[3] == pytest.approx(0.75767911, abs=1e-8)


def test_labels(spark):
    got = values(spark, [("CITY", "B-CITY"), ("CITY", "O"), ("O", "B-CITY"), ("CITY", "I-DATE")], "c string, p string", fn.class_to_bio(F.col("c"), F.col("p")))
    assert [g[0] for g in got] == ["I-CITY", "B-CITY", "O", "B-CITY"]
    got = values(spark, [("O", "I-CITY"), ("B-DATE", "I-CITY"), ("I-CITY", "I-CITY"), ("O", "B-CITY")], "p string, l string", fn.bio_consistent(F.col("p"), F.col("l")))
    assert [g[0] for g in got] == [False, False, True, True]
    assert values(spark, [("B-CITY",), ("I-CITY",), ("O",)], "l string", fn.entity(F.col("l")), fn.rebuild(F.col("l"), F.lit("X"))) == [("CITY", "B-X"), ("CITY", "I-X"), ("O", "X")]


def test_text(spark):
    got = values(spark, [(["▁New", "▁Yo", "##rk"],)], "p array<string>", fn.clean_wordpiece(F.col("p")))
    assert got == [("New York",)]
    long = "a" * 300 + " left side TARGET right. side " + "b" * 300
    (row,) = values(spark, [(long, long.index("TARGET"), long.index("TARGET") + 6)], "t string, s int, e int", fn.context(F.col("t"), F.col("s"), F.col("e"), 50))
    # both ends grow outwards to a boundary; on the left there is none but the first character, which is left out
    assert row[0] == "..." + "a" * 299 + " left side >>> TARGET <<< right. side " + "b" * 300 + "..."
    assert values(spark, [("Hybrid V2 (gpt/x)",), ("Base",)], "n string", fn.model_name(F.col("n")), fn.safe_name(F.col("n"))) == [("gpt/x", "hybrid_v2_gpt_x"), ("Base", "base")]
    assert [r[0] for r in values(spark, [(0.0001,), (0.005,), (0.03,), (0.2,)], "p double", fn.stars(F.col("p")))] == ["***", "**", "*", "n.s."]
