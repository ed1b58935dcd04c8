import random

from pyspark.sql import functions as F

from veilspark.operators import order, producers, subwords
from veilspark.operators import tokens as tk

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


# --- span producers ---------------------------------------------------------------------------------
def test_producer_gets_text_and_labels(spark):
    def produce(text, labels):
        for k, label in enumerate(labels):
            yield 0, 4, label, 0.5 + k
        yield 1, 2, "NOT ASKED", 1.0
        yield 3, 99, labels[0], 1.0
        yield 2, 2, labels[0], 1.0

    docs = spark.createDataFrame([(1, "abcdef"), (2, None), (3, ""), (4, "xyzä")], "sample_id long, text string")
    got = sorted(map(tuple, producers.produced(docs, ["A", "B"], produce).collect()))
    assert got == [(k, 0, 4, c, p) for k in (1, 4) for c, p in (("A", 0.5), ("B", 1.5))]
    assert [r["class"] for r in producers.produced(docs, ["A", "B"], produce, least=1.0).collect()] == ["B", "B"]


def test_best_of_overlapping_spans(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 20), s, s + rng.randint(1, 8), "X", round(rng.random(), 2)) for s in (rng.randint(0, 100) for _ in range(400))]
    got = {tuple(r) for r in producers.without_overlaps(spark.createDataFrame(rows, "sample_id long, s int, e int, class string, score double")).collect()}
    want = set()
    for key in range(21):
        taken = []
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (-r[4], r[1] - r[2], r[1])):
            if all(r[1] >= o[2] or r[2] <= o[1] for o in taken):
                taken.append(r)
        want |= set(taken)
    assert got == want


def test_word_labels(spark):
    produce = producers.pattern_producer({"NUM": r"\d+", "NAME": r"[A-Z]\w+(?: [A-Z]\w+)*"})
    docs = spark.createDataFrame([(7, "ask Ann Lee at 12345 or Bob"), (8, "nothing here"), (9, None)], "sample_id long, text string")
    got = [(r.sample_id, r.token, r.label) for r in producers.word_labels(docs, ["NUM", "NAME", "OTHER"], produce).orderBy("sample_id", "idx").collect()]
    assert got == [(7, "ask", "O"), (7, "Ann", "B-NAME"), (7, "Lee", "I-NAME"), (7, "at", "O"), (7, "12345", "B-NUM"), (7, "or", "O"), (7, "Bob", "B-NAME"), (8, "nothing", "O"), (8, "here", "O")]


# --- subwords in windows ----------------------------------------------------------------------------
def by_number(pieces):
    return F.transform(pieces, lambda p: F.when(p["id"] % 5 == 0, "B-X").otherwise("O"))


def test_every_subword_once_and_no_window_too_long(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = ["", None, "one", "Straße 😀 ünïcode wörds", " ".join(rng.choices(["alpha", "unbelievable", "x9-z", "ok", "Ärger"], k=900)), " ".join(["word"] * 512), " ".join(["word"] * 513)]
    docs = spark.createDataFrame(list(enumerate(texts)), "sample_id int, text string")
    cut = subwords.windowed(docs, TOKENIZER, size=512, stride=128)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = {k: tokenizer.encode(t or "", add_special_tokens=False) for k, t in enumerate(texts)}
    sizes = {r.sample_id: (r.n_windows, r.n_pieces, r.longest) for r in subwords.limits(cut).collect()}
    assert set(sizes) == {k for k, e in want.items() if e.ids} and all(n == len(want[k].ids) and longest <= 512 for k, (_, n, longest) in sizes.items())
    assert sizes[5][0] == 1 and sizes[6][0] > 1
    got = {}
    for r in subwords.decided(cut, by_number).orderBy("sample_id", "idx").collect():
        got.setdefault(r.sample_id, []).append((r.idx, r.id, (r.s, r.e), r.label))
    for k, rows in got.items():
        assert rows == [(i, x, o, "B-X" if x % 5 == 0 else "O") for i, (x, o) in enumerate(zip(want[k].ids, want[k].offsets))]


def test_the_last_window_decides(spark):
    docs = spark.createDataFrame([(1, "word " * 40)], "sample_id int, text string")
    cut = subwords.windowed(docs, TOKENIZER, size=16, stride=8)
    labelled = cut.withColumn("labels", F.transform("pieces", lambda p: F.concat(F.lit("w"), F.col("window"))))
    got = [r.label for r in subwords.decided(labelled, F.col("labels")).orderBy("idx").collect()]
    plan = [(w.first, w.stop) for w in spark.range(1).select(tk.windows(F.lit(40), 16, 8).alias("w")).first().w]
    want = [None] * 40
    for k, (a, b) in enumerate(plan):
        want[a:b] = [f"w{k}"] * (b - a)
    assert got == want


def test_words_from_subwords(spark):
    docs = spark.createDataFrame([(1, "some unbelievable 12345 thing"), (2, None)], "sample_id int, text string")
    got = subwords.word_verdicts(docs, TOKENIZER, lambda p: F.transform(p, lambda x: F.when(x["s"] == 18, "B-NUM").otherwise("O"))).orderBy("idx").collect()
    assert [(r.idx, r.label) for r in got] == [(0, "O"), (1, "O"), (2, "B-NUM"), (3, "O")]


# --- positional zip ---------------------------------------------------------------------------------
def test_zip_by_position(spark):
    rng = random.Random(3)
    left, right = [(rng.random(), k) for k in range(700)], [(rng.random(), f"r{k}") for k in range(450)]
    a = spark.createDataFrame(left, "x double, name int").repartition(4)
    b = spark.createDataFrame(right, "x double, name string").repartition(3)
    got = sorted(map(tuple, order.positional_zip(a, b, [F.col("x")], [F.col("x").desc()]).collect()))
    want = [(k + 1, *p, *q) for k, (p, q) in enumerate(zip(sorted(left), sorted(right, reverse=True)))]
    assert got == want and order.positional_zip(a, b, [F.col("x")], [F.col("x")]).columns == ["position", "x", "name", "right_x", "right_name"]
    assert order.positional_zip(a, b.where("false"), [F.col("x")], [F.col("x")]).count() == 0
