import duckdb
import pyarrow as pa

from veilspark.operators import tokens as tk
from veilspark.queries import ORACLES, QUERIES

TEXTS = ["", None, "one", "  two words \n", "\t \n", "é😀 long" + "x" * 300, "a b c\r\n", "tail  "]


def test_extents_are_those_of_the_words(spark):
    texts = [*TEXTS, *["x" * 700_000 + " y", "z " * 400_000] * 2]
    got = tk.word_extents.func(pa.array(texts)).to_pylist()
    for text, row in zip(texts, got, strict=True):
        words = (text or "").split()
        assert (row["n_tokens"], row["longest"], row["chars"], row["last_end"]) == (len(words), max(map(len, words), default=0), sum(map(len, words)), len((text or "").rstrip()))
    assert tk.word_extents.func(pa.array([], pa.string())).to_pylist() == []


def test_token_spans_are_their_sql(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(path)
    with duckdb.connect() as base:
        base.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
        wanted = base.execute(ORACLES["token_spans"]).fetchall()
    got = QUERIES["token_spans"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(wanted)
    assert "aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
