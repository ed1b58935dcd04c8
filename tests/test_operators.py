"""Alignment, routing, arbiter and evaluation on hand-made rows and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark.functions import columns as fn
from veilspark.functions.registry import PII_CLASSES, RouteConfig
from veilspark.operators import arbiter, calibrate, correct, evaluate, route
from veilspark.operators import tokens as tk
from veilspark.plans import experiments, pipeline
from veilspark.queries import QUERIES
from veilspark.sources import adapters


def sequence(spark, labels, **more):
    rows = [(0, i, l, *[float(more[k][i]) for k in more]) for i, l in enumerate(labels)]
    return spark.createDataFrame(rows, "sample_id int, idx int, label string" + "".join(f", {k} double" for k in more))


def test_words_and_windows(spark):
    text = "a bé\t😀c \x1c d"
    row = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(tk.word_tokens(F.col("t")).alias("w")).collect()
    assert [(t.token, t.s, t.e) for t in row[0].w] == [("a", 0, 1), ("bé", 2, 4), ("😀c", 5, 7), ("d", 10, 11)] and row[1].w == row[2].w == []
    (w,) = spark.range(1).select(tk.windows(F.lit(800)).alias("w")).first()
    assert [(x.start, x.stop) for x in w] == [(0, 382), (382, 800), (764, 800)]
    (o,) = spark.createDataFrame([(["ab", "c"],)], "t array<string>").select(tk.joined_offsets(F.col("t"))).first()
    assert [(x.s, x.e) for x in o] == [(0, 2), (3, 4)]


def test_align_and_repair(spark):
    kind = "tokens array<struct<s:int,e:int>>, spans array<struct<s:int,e:int,class:string>>"
    df = spark.createDataFrame([([(0, 4), (5, 10)], [(2, 7, "X")]), ([(0, 2), (3, 5), (6, 8)], [(0, 5, "A"), (6, 8, "A")])], kind)
    assert [r[0] for r in df.select(tk.align(F.col("tokens"), F.col("spans"))).collect()] == [["B-X", "O"], ["B-A", "I-A", "B-A"]]
    got = tk.repair_rows(sequence(spark, ["I-CITY", "I-CITY", "O", "I-CITY", "B-DATE", "I-CITY"])).orderBy("idx").collect()
    assert [r.label for r in got] == ["B-CITY", "I-CITY", "O", "B-CITY", "B-DATE", "B-CITY"]
    got = tk.inside_only_to_bio(sequence(spark, ["I-A", "I-A", "I-B", "O", "I-B"])).orderBy("idx").collect()
    assert [r.label for r in got] == ["B-A", "I-A", "B-B", "O", "B-B"]


def test_chunks(spark):
    labels = ["I-A", "I-A", "B-A", "I-B", "O", "B-C", "I-C"]
    chunk = lambda strict: sorted((r["class"], r.first_idx, r.last_idx) for r in tk.bio_spans(sequence(spark, labels), strict=strict).collect())
    assert chunk(False) == [("A", 0, 1), ("A", 2, 2), ("B", 3, 3), ("C", 5, 6)]
    assert chunk(True) == [("A", 2, 2), ("C", 5, 6)]


def test_routing(spark):
    rows = [("B-CITY", 0.6, 0.7), ("B-CITY", 0.583, 0.7), ("B-SOCIALNUM", 0.45, 0.85), ("O", 0.8, 0.5), ("O", 0.9, 0.5), ("I-CITY", 0.9, 0.5)]
    df = spark.createDataFrame(rows, "l string, h double, c double")
    decide = lambda config: [r[0] for r in df.select(route.decision(F.col("l"), F.col("h"), F.col("c"), config)).collect()]
    assert decide(route.PII_ROUTES) == ["routed", "blocked_by_threshold", "routed", "blocked_by_threshold", "routed_o", "routed"]
    strict = RouteConfig(routable=None, blocked=frozenset({"CITY"}))
    assert decide(strict) == ["blocked_by_entity", "blocked_by_threshold", "blocked_by_threshold", "routed", "routed", "blocked_by_entity"]
    # by default every class may be routed: an unsure O and an I- too
    assert decide(RouteConfig())[3:] == ["routed", "routed", "routed"]
    assert decide(RouteConfig(routable=frozenset({"CITY"}), routable_inside=frozenset({"AGE"}), blocked=frozenset({"O"}))) == ["routed", "blocked_by_threshold", "blocked_by_threshold", "blocked_by_entity", "blocked_by_entity", "blocked_by_continuation"]
    assert decide(calibrate.calibrated(0.8, 0.6, route.PII_ROUTES))[:5] == ["blocked_by_threshold"] * 5
    legacy = [r[0] for r in df.select(route.legacy_decision(F.col("l"), F.col("h"), F.col("c"), ("AGE",), ("CITY",))).collect()]
    assert legacy == [True, False, False, True, True, True]
    assert decide(RouteConfig(selective=False))[3:] == ["routed"] * 3


def test_spans(spark):
    labels = ["B-A", "I-A", "I-B", "I-A", "B-B", "I-B", "O", "I-A"]
    df = sequence(spark, labels, s=[float(10 * i) for i in range(8)], e=[float(10 * i + 5) for i in range(8)], entropy=[1.0] + [0.0] * 7, confidence=[0.1] + [0.9] * 7)
    got = sorted((r["class"], r.first_idx, r.last_idx, r.is_uncertain) for r in route.entity_spans(df).collect())
    assert got == [("A", 0, 1, True), ("B", 4, 5, False)]
    o = sequence(spark, ["O"] * 5, s=[0.0, 2, 4, 9, 20], e=[1.0, 3, 8, 9, 21], entropy=[2.0, 2, 0, 2, 2], confidence=[0.1] * 5)
    assert sorted((r.first_idx, r.last_idx) for r in route.uncertain_o_spans(o).collect()) == [(0, 1)]
    never = route.ablate(df).where("variant = 'never_route' and decision in ('routed', 'routed_o')")
    assert never.count() == 0


def test_entity_rows(spark):
    labels = ["B-A", "I-B", "I-A", "O", "I-A", "B-C"]
    df = sequence(spark, labels, s=[0.0, 2, 4, 6, 8, 10], e=[1.0, 3, 5, 7, 9, 11], confidence=[0.5, 0.1, 0.7, 1, 1, 0.9]).withColumn("token", F.concat(F.lit("t"), "idx"))
    got = sorted((r["class"], r.s, r.e, r.text, round(r.confidence, 6)) for r in pipeline.entity_rows(df).collect())
    assert got == [("A", 0.0, 5.0, "t0 t2", 0.6), ("C", 10.0, 11.0, "t5", 0.9)]


def test_arbiter(spark):
    one = lambda row, f: spark.createDataFrame([(row,)], "raw string").select(f(F.col("raw")).alias("v")).first().v
    assert one('thinks {no} {"a": {"b": "}"}} {"c": 1}', arbiter.first_json) == '{"a": {"b": "}"}}' and one("none {", arbiter.first_json) is None
    label = lambda raw, before="O": one(raw, lambda c: arbiter.validate_label(c, F.lit(before), F.lit("B-DATE"), ("O", "B-CITY", "I-CITY", "B-DATE")))
    assert label('{"label": "b-city", "corrected_label": "O"}').label == label('{"corrected_label": ["?", "B-city"]}').label == "B-CITY"
    rejected = label('{"label": "I-CITY", "reasoning": "r"}')
    assert (rejected.label, rejected.valid, rejected.reasoning) == ("B-DATE", False, "BIO violation rejected: r") and label('{"label": "I-CITY"}', "B-CITY").valid
    assert label('{"label": "O"}').is_pii is False and label("no").label == "B-DATE"
    gate = lambda raw: one(raw, arbiter.validate_o_span)
    assert gate('{"is_pii": true, "entity_class": "B-Planet"}').new_class == "Planet" and not gate('{"entity_class": "CITY"}').is_pii and gate(None).new_class == "O"
    raws = ['{"entity_class": " b-city "}', 'x {"entity_class": "ssn"} y', '{"entity_class": "planet"}', "no", None]
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    assert [r.v.new_class for r in df.select(arbiter.validate_class(F.col("raw"), F.lit("AGE")).alias("v")).collect()] == ["CITY", "SOCIALNUM", "AGE", "AGE", "AGE"]
    calls = []
    rows = [("t1", "c", "O", "B-CITY", 1), ("t1", "c", "O", "B-CITY", 2), ("555 0199 22", "c", "O", "O", 3)]
    req = spark.createDataFrame(rows, "target string, context string, prev_label string, pred string, n int")
    got = {r.n: r.raw for r in arbiter.ask(req, arbiter.rule_backend).collect()}
    assert got[1] == got[2] and '"CITY"' in got[1] and '"TELEPHONENUM"' in got[3] and not calls

    def broken(rows):
        raise RuntimeError

    assert [r.raw for r in arbiter.ask(req, broken).collect()] == [None] * 3
    cache = arbiter.ask(req, arbiter.rule_backend).select("cache_key", "raw").distinct()
    assert {r.n: r.raw for r in arbiter.ask(req, broken, cache).collect()} == got
    prompt = req.select(arbiter.render("span", ("CITY",))).first()[0]
    assert "Span: t1" in prompt and "CITY, O" in prompt
    seq = spark.createDataFrame([(1, 0, "a", "O", True), (1, 1, "b", "O", True)], "sample_id int, idx int, token string, label string, routed boolean")
    out = arbiter.route_in_order(seq, lambda token, label, previous: "B-X" if previous == "O" else "I-X")
    assert [r.label for r in out.orderBy("idx").collect()] == ["B-X", "I-X"]


def test_verdicts(spark):
    df = sequence(spark, ["B-CITY", "I-CITY", "O", "B-AGE"])
    v = spark.createDataFrame([(0, 0, 1, False, "O", 0.9, False), (0, 3, 3, False, "O", 0.9, True)], "sample_id int, first_idx int, last_idx int, is_pii boolean, new_class string, confidence double, failed boolean")
    labels = lambda **k: [r.label for r in correct.apply_verdicts(df, v, **k).orderBy("idx").collect()]
    assert labels() == ["O", "O", "O", "O"]
    assert labels(on_error="keep") == ["O", "O", "O", "B-AGE"]
    assert labels(gates={"CITY": 0.8}) == ["B-CITY", "I-CITY", "O", "O"]
    merged = spark.createDataFrame([("O", "B-Planet"), ("O", "B-CITY"), ("B-AGE", "B-Planet")], "l string, x string").select(correct.merge_extended(F.col("l"), F.col("x"))).collect()
    assert [r[0] for r in merged] == ["B-Planet", "O", "B-AGE"] and len(PII_CLASSES) == 20


def test_metrics_against_python(spark):
    rng = random.Random(3)
    names = ["O", "B-A", "I-A", "B-B"]
    rows = [(i // 9, i % 9, rng.choice(names), rng.choice(names)) for i in range(400)]
    df = spark.createDataFrame(rows, "sample_id int, idx int, gold string, pred string")
    report = {r.label: r for r in evaluate.per_label(df).collect()}
    for name in names[1:]:
        tp = sum(g == p == name for *_, g, p in rows)
        assert (report[name].tp, report[name].fp, report[name].fn) == (tp, sum(p == name for *_, p in rows) - tp, sum(g == name for _, _, g, _ in rows) - tp)
    average = {r.average: r for r in evaluate.averages(evaluate.per_label(df)).collect()}
    assert min(r.f1 for r in report.values()) <= average["micro"].f1 <= max(r.f1 for r in report.values())
    assert average["macro"].f1 == pytest.approx(sum(r.f1 for r in report.values()) / 3)
    assert evaluate.confusion(df).agg(F.sum("n")).first()[0] == len(rows)
    lat = evaluate.latency(spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40, 50)], "v double"), "v").first()
    assert (lat.median_ms, lat.p95_ms, lat.p99_ms) == pytest.approx((30.0, 48.0, 49.6))


def test_statistics(spark):
    pairs = spark.createDataFrame([(True, False)] * 11 + [(False, True)] * 16 + [(True, True)] * 5, "right_a boolean, right_b boolean")
    r = calibrate.mcnemar(pairs).first()
    assert r.chi2 == pytest.approx(0.59259259) and r.p == pytest.approx(0.44141833, abs=1e-6)
    assert calibrate.mcnemar(pairs.where("right_a and right_b")).first().p == 1.0
    rng = random.Random(1)
    samples = spark.createDataFrame([(i, 0.5, 0.55 + rng.gauss(0, 0.1)) for i in range(200)], "sample_id int, a double, b double")
    one, two = (calibrate.paired_bootstrap(samples.repartition(n), 400).first() for n in (1, 3))
    assert one.low < one.delta < one.high and one.p < 0.05 and one.low == pytest.approx(two.low)
    line = calibrate.boundary(spark.createDataFrame([(1.0, -1.0), (2.0, 0.0), (3.0, 1.0), (3.0, 1.0)], "x double, y double"), "x", "y").first()
    assert line.zero == pytest.approx(2.0) and line.spearman == pytest.approx(1.0)
    front = evaluate.pareto(spark.createDataFrame([("a", 1.0, 0.5), ("b", 2.0, 0.4), ("c", 3.0, 0.9)], "s string, cost double, f double"), "cost", "f")
    assert {r.s for r in front.where("on_front").collect()} == {"a", "c"}
    ties = evaluate.pareto(spark.createDataFrame([("a", 1.0, 0.5), ("b", 2.0, 0.5), ("c", 2.0, 0.4)], "s string, cost double, f double"), "cost", "f")
    assert {r.s for r in ties.where("on_front").collect()} == {"a", "b"}


def test_grid(spark):
    rng = random.Random(2)
    rows = [(rng.random() * 1.6, 0.4 + rng.random() * 0.6, rng.random() < 0.3) for _ in range(300)]
    cells = calibrate.grid_scores(spark.createDataFrame(rows, "entropy double, confidence double, is_error boolean"), calibrate.fixed_grid(spark, 6)).collect()
    for c in cells:
        hit = [x for x in rows if x[0] > c.ent_th and x[1] < c.conf_th]
        assert (c.triggered, c.hits) == (len(hit), sum(x[2] for x in hit))
    assert len(cells) == 36


@pytest.mark.parametrize("name", ["system_base_labels", "system_hybrid_v1_labels", "system_hybrid_v2_labels"])
def test_systems_label_documents_without_matches(spark, tmp_path, name):
    rows = [(1, "Anna Berg lives in Oslo"), (2, "mail a.berg@example.com today"), (3, ""), (4, None), (5, "nothing to find")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES[name](spark, str(tmp_path)).collect()
    assert sum(r.n for r in got) == sum(len((t or "").split()) for _, t in rows)


def test_context(spark):
    rows = [("one two three four", 8, 13), ("abcdefghij klm. nop", 4, 6), ("a.b\nc d", 4, 5), ("aaaa bbbb", 0, 4), ("abc\r def ghi", 9, 12)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, s int, e int").select(fn.context(F.col("t"), F.col("s"), F.col("e"), 2)).collect()]
    assert got == ["...two >>> three <<< four...", "...bcd>>> ef <<<ghij...", "...b >>> c <<< d...", "...>>> aaaa <<< bbbb...", "...def >>> ghi <<<..."]


def test_hints_take_words_once(spark):
    tokens = sequence(spark, ["O", "O", "B-AGE", "O", "O"], s=[0.0, 2, 4, 6, 8], e=[1.0, 3, 5, 7, 9])
    found = spark.createDataFrame([(0, 2, "EMAIL", 0.0, 9.0, True), (0, 1, "DATE", 2.0, 5.0, True), (0, 0, "X", 0.0, 9.0, False)], "sample_id int, priority int, class string, s double, e double, valid boolean")
    taken = spark.createDataFrame([(0, 4, 4)], "sample_id int, first_idx int, last_idx int")
    got = sorted((r["class"], r.indices, r.s, r.e, r.prev_label) for r in route.hint_spans(tokens, found, taken).collect())
    assert got == [("DATE", [1], 2.0, 5.0, "O"), ("EMAIL", [0, 3], 0.0, 9.0, "O")]
    v = spark.createDataFrame([(0, [0, 3], True, "EMAIL", 0.5, False)], "sample_id int, indices array<int>, is_pii boolean, new_class string, confidence double, failed boolean")
    assert [r.label for r in correct.apply_verdicts(tokens, v).orderBy("idx").collect()] == ["B-EMAIL", "O", "B-AGE", "I-EMAIL", "O"]


def test_hints_reach_the_arbiter(spark):
    """An IBAN is no label of the model, so only the arbiter can say what it is; its own class comes in at the end."""
    text = "pay GB82WEST12345698765432 now"
    samples = spark.createDataFrame([("a", text)], "sample_id string, text string")
    logits = [9.0] + [0.0] * 40
    scored = spark.createDataFrame([("a", i, w, text.index(w), text.index(w) + len(w), logits) for i, w in enumerate(text.split())], "sample_id string, idx int, token string, s int, e int, logits array<double>")
    out = pipeline.hybrid_system(samples, scored, lambda rows: ['{"entity_class": "TAXNUM"}' if r["pred"] == "IBAN" else None for r in rows])
    assert [r.label for r in out.orderBy("idx").collect()] == ["O", "B-TAXNUM", "O"]
    unsure = spark.createDataFrame([("a", i, w, 4 * i, 4 * i + 3, [0.1] + [0.0] * 40) for i, w in enumerate(["red", "two"])], scored.schema)
    gate = lambda rows: ['{"is_pii": true, "entity_class": "Planet"}'] * len(rows)
    out = pipeline.hybrid_system(spark.createDataFrame([("a", "red two")], samples.schema), unsure, gate)
    assert [r.label for r in out.orderBy("idx").collect()] == ["B-Planet", "I-Planet"]
    rows = pipeline.analyze(samples, scored, lambda rows: ['{"entity_class": "TAXNUM"}'] * len(rows)).orderBy("idx").collect()
    assert [r.source for r in rows] == ["model", "arbiter", "model"]


def test_calibration(spark):
    rows = [(0.1 * (i % 9), 0.4 + 0.05 * (i % 11), i % 4 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "entropy double, confidence double, is_error boolean")
    none = calibrate.best_cell(calibrate.grid_scores(df.withColumn("is_error", F.lit(False)), calibrate.fixed_grid(spark, 4))).first()
    assert (none.ent_th, none.conf_th, none.f_beta, none.triggered, none.n_tokens) == (0.5, 0.8, 0.0, 0, 400)
    far = spark.createDataFrame([(9.0, 0.1)], "ent_th double, conf_th double")
    assert calibrate.best_cell(calibrate.grid_scores(df, far)).first().conf_th == 0.8
    ci = {r.metric: r for r in calibrate.metric_intervals(df, 0.3, 0.7).collect()}
    hit = [e for h, c, e in rows if h > 0.3 and c < 0.7]
    assert ci["precision"].value == pytest.approx(sum(hit) / len(hit)) and all(r.low < r.value < r.high for r in ci.values())
    assert [r.value for r in calibrate.metric_intervals(df.where("false"), 0.3, 0.7).collect()] == [0.0] * 3
    words = spark.createDataFrame([("B-A", "I-A", 0.9, 0.3), ("O", "B-A", 0.8, 0.4), ("O", "O", 0.1, 0.9)], "gold string, pred string, entropy double, confidence double")
    assert [r.is_error for r in calibrate.word_errors(words).collect()] == [False, True, False]
    config, _ = calibrate.calibrate(words, route.PII_ROUTES)
    assert set(config.thresholds) == {"DEFAULT"} and config.routable == route.PII_ROUTES.routable
    with pytest.raises(Exception, match="different words"):
        experiments.significance({"d": spark.createDataFrame([(1, 0, "O", None, "O")], "sample_id int, idx int, gold string, a string, b string")}, 5).collect()


def test_spans_of_python_literals(spark):
    raw = [("[{'label': \"o'x\", 'start': 1, 'end': 3, 'text': 'a'}]",), ('[{"label": "b", "start": 0, "end": 1}]',), ("[",), (None,)]
    got = [[x.label for x in r.v] for r in spark.createDataFrame(raw, "r string").select(adapters.parse_spans(F.col("r")).alias("v")).collect()]
    assert got == [["o'x"], ["b"], [], []]
