"""Pattern fixtures: spans, validation, priority, redaction, corrections."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.functions.registry import PATTERNS
from veilspark.operators import correct, detect
from veilspark.operators.tokens import word_tokens
from veilspark.plans import pipeline

TEXTS = [
    ("F1", "Mail ana.b@ex.org or call (217) 555-0199."), ("F2", "SSN 555-01-4433, bad 000-12-3456."), ("F3", "Card 4111 1111 1111 1111 and 1234-5678-9012-3456."),
    ("F4", "IBAN DE89370400440532013000 vs DE89370400440532013001"), ("F5", "Born 2024-01-15, due 31.12.2020, us 01/31/99."), ("F6", "ZIP 62704-1234 and SW1A 1AA"),
    ("F7", "Passport P44992211 tax 99-1234567 lic D8954201"), ("F8", "é123-45-6789 ß4111111111111111"), ("F9", "vat de123456789"), ("F10", "ip 152.143.123.131"), ("F11", None), ("F12", ""),
]
WANT = {
    ("F1", "EMAIL", 5, 17, True), ("F1", "TELEPHONENUM", 27, 40, True), ("F2", "SOCIALNUM", 4, 15, True), ("F2", "SOCIALNUM", 21, 32, False), ("F3", "CREDITCARDNUMBER", 5, 24, True),
    ("F3", "CREDITCARDNUMBER", 29, 48, False), ("F3", "TELEPHONENUM", 5, 24, True), ("F3", "TELEPHONENUM", 29, 48, True), ("F4", "IBAN", 5, 27, True), ("F4", "IBAN", 31, 53, False),
    ("F5", "DATE", 5, 15, True), ("F5", "DATE", 21, 31, True), ("F5", "DATE", 36, 44, True), ("F6", "TELEPHONENUM", 4, 14, True), ("F6", "ZIPCODE", 4, 14, True), ("F6", "ZIPCODE", 19, 27, True),
    ("F7", "TELEPHONENUM", 23, 33, True), ("F7", "PASSPORTNUM", 9, 18, True), ("F7", "PASSPORTNUM", 38, 46, True), ("F7", "TAXNUM", 23, 33, True), ("F7", "DRIVERLICENSENUM", 9, 18, True),
    ("F7", "DRIVERLICENSENUM", 38, 46, True), ("F9", "IBAN", 4, 15, False), ("F9", "PASSPORTNUM", 4, 15, True), ("F9", "TAXNUM", 4, 15, True), ("F10", "TELEPHONENUM", 3, 18, True),
}


def test_fixtures(spark):
    got = detect.matches(spark.createDataFrame(TEXTS, "doc_id string, text string")).collect()
    assert {(r.doc_id, r["class"], r.s, r.e, r.valid) for r in got} == WANT


def test_spans_equal_finditer(spark):
    @settings(max_examples=4, deadline=None)
    @given(st.lists(st.text("ab1234567890-. @/éA(\n", max_size=60), min_size=20, max_size=20))
    def check(texts):
        rows = detect.matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        want = {(i, c, m.start(), m.end()) for i, t in enumerate(texts) for c, p, _, _ in PATTERNS for m in re.finditer(p, t, re.I)}
        assert {(r.doc_id, r["class"], r.s, r.e) for r in rows} == want

    check()


def test_redaction(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id string, text string")
    got = {r.doc_id: r for r in pipeline.redacted(docs).collect()}
    assert got["F1"].redacted == "Mail ████████ or call (████████." and got["F1"].n_entities == 2
    assert got["F11"].redacted == "" and got["F8"].redacted == TEXTS[7][1]
    assert {r.doc_id: r.redacted for r in pipeline.redacted(docs, labels=True).collect()}["F6"] == "ZIP [TELEPHONENUM] and [ZIPCODE]"


def fold(spark, text, labels, partial=False):
    rows = detect.with_matches(spark.createDataFrame([(text, labels)], "text string, labels array<string>")).withColumn("tokens", word_tokens(F.col("text")))
    r = rows.select(correct.fold_matches(F.col("labels"), F.col("tokens"), F.col("matches"), partial=partial).alias("x")).first().x
    return r.labels, [(a.action, a["class"], a.n) for a in r.actions]


def test_corrections(spark):
    o = ["O"] * 7
    assert fold(spark, TEXTS[5][1], o[:5])[0] == ["O", "B-TELEPHONENUM", "O", "B-ZIPCODE", "I-ZIPCODE"]
    assert fold(spark, TEXTS[6][1], o[:6])[0] == ["O", "B-PASSPORTNUM", "O", "B-TELEPHONENUM", "O", "B-PASSPORTNUM"]
    assert fold(spark, TEXTS[2][1], o)[0] == ["O", "B-CREDITCARDNUMBER", "I-CREDITCARDNUMBER", "I-CREDITCARDNUMBER", "I-CREDITCARDNUMBER", "O", "B-TELEPHONENUM"]
    labels, actions = fold(spark, TEXTS[3][1], o[:4])
    assert labels == o[:4] and ("promoted", "IBAN", 1) in actions
    assert fold(spark, "x 4111111111111111", ["O", "B-SOCIALNUM"])[0] == ["O", "B-CREDITCARDNUMBER"]
    assert fold(spark, "x a@b.org", ["O", "B-CITY"])[0] == ["O", "B-CITY"]
    assert fold(spark, "217 5550199", ["B-TELEPHONENUM", "O"], True)[0] == ["B-TELEPHONENUM", "I-TELEPHONENUM"]
    assert fold(spark, "217 5550199", ["B-CITY", "O"], True)[0] == ["B-CITY", "O"]
    assert fold(spark, "217 5550199", ["B-TELEPHONENUM", "O"])[0] == ["B-TELEPHONENUM", "O"]
