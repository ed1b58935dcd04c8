"""Sources, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from veilspark.functions.registry import NEMOTRON_CLEAN, NEMOTRON_EXCLUDED
from veilspark.plans import experiments
from veilspark.sources import adapters, sinks
from veilspark.streaming import stream


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def gold(df):
    return {r.sample_id: [(t.token, t.gold) for t in r.tokens] for r in df.collect()}


def test_span_sources(spark, tmp_path):
    spans = [{"label": "city", "start": 4, "end": 8, "text": "Rome"}]
    rows = [{"uid": "1", "text": "see Rome now", "spans": json.dumps(spans)}, {"uid": "2", "text": "see Rome", "spans": str(spans)}, {"uid": "3", "text": "x", "spans": "nonsense"}, {"uid": "4", "text": "", "spans": "[]"}]
    got = gold(adapters.read_nemotron(spark, lines(tmp_path / "n.json", rows)))
    assert got == {"1": [("see", "O"), ("Rome", "B-city"), ("now", "O")], "2": [("see", "O"), ("Rome", "B-city")], "3": [("x", "O")]}
    spark.createDataFrame([("a", "I am Bo", "en", [("GIVENNAME", 5, 7, "Bo"), ("OTHER", 0, 1, "I")])], "uid string, source_text string, language string, privacy_mask array<struct<label:string,start:int,end:int,value:string>>").write.parquet(str(tmp_path / "p"))
    assert gold(adapters.read_ai4privacy(spark, str(tmp_path / "p"))) == {"a": [("I", "O"), ("am", "O"), ("Bo", "B-GIVENNAME")]}
    literal = spark.createDataFrame([("[{'label': \"it's\", 'start': 1, 'end': 2}]",), (None,), ("{",)], "s string").select(adapters.literal_spans(F.col("s")).alias("x")).collect()
    assert [[y.label for y in r.x] for r in literal] == [["it's"], [], []]


def test_literal_spans_without_numbers(spark):
    raw = "[{'label': 'a', 'start': 'abc', 'end': 2}, {'label': 'b', 'start': '1', 'end': 3}, {'label': 'c', 'start': None, 'end': 3}, {'label': 'd', 'start': 1, 'end': 10**30}, {'label': 'e', 'start': float, 'end': 1}]"
    rows = [(raw[: raw.index(", {'label': 'd'")] + "]",), (raw,), ("[{'label': 'd', 'start': 1, 'end': 99999999999999999999}, {'label': 'f', 'start': 0, 'end': 1}]",)]
    got = spark.createDataFrame(rows, "s string").select(adapters.literal_spans(F.col("s")).alias("x")).collect()
    assert [[(y.label, y.start, y.end) for y in r.x] for r in got] == [[("b", 1, 3)], [], [("f", 0, 1)]]


def test_loading_a_bounded_sample(spark, tmp_path):
    bc = lines(tmp_path / "b.json", [{"id": str(k), "tokens": ["a", "b"], "tags": [1, 4]} for k in range(40)])
    some = [{r.sample_id for r in experiments.load(spark, "bc5cdr", bc, 7, seed).collect()} for seed in (1, 1, 2)]
    assert some[0] == some[1] != some[2] and len(some[0]) == 7
    wanted = adapters.sample_count("bc5cdr")
    assert experiments.load(spark, "bc5cdr", bc).count() == (40 if wanted is None else min(40, wanted))
    with pytest.raises(ValueError, match="known are"):
        experiments.load(spark, "nothing", bc)


def test_token_sources(spark, tmp_path):
    bc = lines(tmp_path / "b.json", [{"id": "1", "tokens": ["a", "b"], "tags": [1, 4]}, {"id": "2", "tokens": [], "tags": []}])
    assert gold(adapters.read_bc5cdr(spark, bc)) == {"1": [("a", "B-Chemical"), ("b", "I-Chemical")]}
    fin = lines(tmp_path / "f.json", [{"id": "1", "tokens": ["a"], "ner_tags": ["O"]}, {"id": "2", "tokens": ["x", "y"], "ner_tags": ["O", "B-R"]}])
    assert gold(adapters.read_labelled_jsonl(spark, fin)) == {"2": [("x", "O"), ("y", "B-R")]}
    wiki = lines(tmp_path / "w.json", [{"id": "1", "tokens": ["a"], "ner_tags": [5]}])
    out = adapters.read_wikineural(spark, {"en": wiki, "xx": str(tmp_path / "missing")})
    assert gold(out) == {"1": [("a", "B-LOC")]} and out.first().tokens[0].s == 0
    assert adapters.read_wikineural(spark, {}).count() == 0


def test_maps_and_samples(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"0": "O", "1": "B-X"}')
    assert {tuple(r) for r in adapters.read_label_map(spark, str(tmp_path / "l.json")).collect()} == {(0, "O"), (1, "B-X")}
    (tmp_path / "a.json").write_text('{"My Sys": {"d_s": {"A": ["x", "y"]}}}')
    assert {tuple(r) for r in adapters.read_alignment(spark, str(tmp_path / "a.json")).collect()} == {("my-sys", "d-s", "A", 0, "x"), ("my-sys", "d-s", "A", 1, "y")}
    df = spark.range(50).selectExpr("cast(id as string) as sample_id")
    a, b = adapters.split(df, 12, "sample_id")
    assert a.count() == 12 and b.count() == 38 and {r[0] for r in a.collect()} == {r[0] for r in adapters.subsample(df.repartition(3), 12, "sample_id").collect()}
    tokens = spark.createDataFrame([("B-ssn",), ("I-date",), ("B-url",), ("B-new",), ("O",), ("B-name",)], "gold string")
    got = adapters.map_labels(tokens, NEMOTRON_CLEAN, NEMOTRON_EXCLUDED).collect()
    assert [(r.gold, r.mapped) for r in got] == [("B-SOCIALNUM", True), ("I-DATE", True), ("O", True), ("O", False), ("O", True)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s", "d", 0.5, 0.6, 1.0)], "system string, dataset string, f1_macro double, f1_micro double, mean_ms double")
    sinks.write_experiment({"results": df}, str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x/results")).count() == 1
    calls = []
    for _ in range(2):
        out = sinks.once(spark, str(tmp_path / "once"), lambda: calls.append(1) or df)
    assert len(calls) == 1 and out.count() == 1
    assert sinks.summary(df).first().line.startswith("s ") and sinks.markdown(df).first().line == "| s | d | 0.5 | 0.6 | 1.0 |"
    (tmp_path / "r.json").write_text('{"system": "s", "dataset": "d", "token_level": {"f1": {"macro": 0.25}}}')
    r = sinks.read_results(spark, str(tmp_path / "r.json")).first()
    assert (r.f1_macro, r.f1_micro, r.n_samples) == (0.25, 0.0, 0)


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "mail a@b.org", "2024-01-01 00:01:00"), (2, "mail c@d.org", "2024-01-01 00:02:00"), (3, "none", "2024-01-01 02:00:00")], "doc_id long, text string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    docs.write.parquet(str(tmp_path / "in"))
    source = stream.read_stream(spark, str(tmp_path / "in"), docs.schema)
    stream.run_once(stream.redact_stream(source), str(tmp_path / "out"), str(tmp_path / "c1"))
    assert {r.redacted for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"mail ████████", "none"}
    stream.run_once(stream.match_counts(source, "ts"), str(tmp_path / "out2"), str(tmp_path / "c2"))
    batch = stream.match_counts(docs, "ts").collect()
    assert [r.n for r in batch] == [2]


def test_runs_and_zip(spark, tmp_path):
    import io
    import json
    import zipfile

    from veilspark import cli
    from veilspark.sources import adapters, sinks

    results = spark.sql("select 's' as system, 3L as n_samples, 0.5D as `token_level.f1.macro`")
    labels = spark.sql("select 'B-A' as label, 0.5D as precision, 0.5D as recall, 0.5D as f1, 2L as support")
    for run in ("run-1", "run-2"):
        sinks.write_run(spark, f"{tmp_path}/{run}", {"seed": 42}, results, {"per_label": labels})
    got = {r.run: json.loads(r.value) for r in sinks.read_runs(spark, str(tmp_path)).collect()}
    assert got["run-2"] == {"system": "s", "n_samples": 3, "token_level": {"f1": {"macro": 0.5}}} and len(got) == 2
    assert {r.run for r in sinks.read_per_label(spark, str(tmp_path)).collect()} == {"run-1", "run-2"}
    assert sinks.latest(spark, str(tmp_path), "config.json").endswith("run-2/config.json") and "Token Level" in sinks.read_text(spark, f"{tmp_path}/run-1/results.txt")
    assert sinks.format_size(1536) == "1.5 KB"
    sinks.write_table_report(labels.select("label", "f1"), f"{tmp_path}/pivot")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/pivot.md").collect()] == ["| label | f1 |", "|---|---|", "| B-A | 0.5 |"]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a/x.jsonl", json.dumps({"id": "1", "tokens": ["Acme", "sold"], "ner_tags": ["B-X", "O"]}) + "\n" + json.dumps({"id": "2", "tokens": ["no"], "ner_tags": ["O"]}) + "\n")
    (tmp_path / "set.zip").write_bytes(buffer.getvalue())
    assert [r.sample_id for r in adapters.read_labelled_jsonl(spark, f"{tmp_path}/set.zip").collect()] == ["1"]
    spark.createDataFrame([("d", ["a"], ["B-P"])], "document_id string, tokens array<string>, labels array<string>").coalesce(1).write.parquet(f"{tmp_path}/FOLD_2.parquet")
    assert adapters.native_labels(adapters.read_folds(spark, str(tmp_path), (2,))).first()[0] == "P"
    spark.createDataFrame([(1, [5, 6, 0], [1, 1, 0], [-100, 3, -100])], "row_id long, input_ids array<int>, attention_mask array<int>, labels array<int>").write.parquet(f"{tmp_path}/tok")
    assert [tuple(r) for r in adapters.labelled_positions(adapters.read_tokenized(spark, f"{tmp_path}/tok", 5)).collect()] == [(1, 1, 6, 3)]
    assert adapters.sample_count("wikineural", None, 3) == 3000 and adapters.sample_count("bc5cdr") is None and adapters.sample_count("bc5cdr", 7) == 7
    cli.main(["redact", "--demo", "--out", f"{tmp_path}/cli"], spark)
    assert sum(r.n_entities for r in spark.read.json(f"{tmp_path}/cli").collect()) >= 3
    cli.main(["entities", "--text", "mail a@b.com", "--out", f"{tmp_path}/cli2"], spark)
    assert json.loads(spark.read.json(f"{tmp_path}/cli2").first().entities)[0]["text"] == "a@b.com"
