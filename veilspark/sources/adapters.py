"""Sources of benchmark samples, all in one schema: sample_id, text, language, tokens array<struct<idx, token, s, e, gold>>, metadata.

Every adapter is spark -> DataFrame with declared schemas, so nothing is inferred."""

from __future__ import annotations

import ast
import io
import itertools
import json
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.registry import BC5CDR_TAGS, BIOMEDICAL_CLASSES, CONLL_TAGS, FINANCIAL_CLASSES, NEMOTRON_FULL, PII_CLASSES
from ..operators.tokens import align, joined_offsets, word_tokens

SAMPLE = "sample_id string, text string, language string, tokens array<struct<idx:int,token:string,s:int,e:int,gold:string>>, metadata map<string,string>"
_SPANS = "array<struct<label:string,start:int,end:int,text:string>>"
#: Rows of each dataset unless asked otherwise; per language for the multilingual one.
DEFAULT_COUNTS = {"ai4privacy": 5000, "nvidia-pii": 5000, "wikineural": 1000}


_SPAN_TYPE = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())])


@F.arrow_udf(T.ArrayType(_SPAN_TYPE))
def literal_spans(column: pa.Array) -> pa.Array:
    """Spans given as JSON or as a literal of single-quoted dictionaries; anything else has none, and a span whose start or end is no whole
    number is left out. Only rows that from_json can't read get here."""
    def place(value) -> int | None:
        try:
            number = int(value)
        except (TypeError, ValueError, OverflowError):
            return None
        return number if -(1 << 31) <= number < 1 << 31 else None

    out = []
    for x in column.to_pylist():
        try:
            got = json.loads(x or "[]")
        except ValueError:
            try:
                got = ast.literal_eval(x)
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                got = []
        rows = [g for g in got if isinstance(g, dict) and {"label", "start", "end"} <= set(g)] if isinstance(got, list) else []
        spans = [{"label": str(g["label"]), "start": place(g["start"]), "end": place(g["end"]), "text": str(g.get("text", ""))} for g in rows]
        out.append([x for x in spans if x["start"] is not None and x["end"] is not None])
    return pa.array(out, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])))


def parse_spans(raw: Column) -> Column:
    """Spans from text in order of place: JSON in the JVM; only what isn't JSON goes to Python, as a literal."""
    plain = F.from_json(raw, _SPANS)
    parsed = F.coalesce(plain, literal_spans(F.when(plain.isNull(), raw)), F.array().cast(_SPANS))
    kept = F.filter(parsed, lambda x: x["label"].isNotNull() & x["start"].isNotNull() & x["end"].isNotNull())
    return F.array_sort(kept, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(a["end"] - b["end"]))


def _finish(df: DataFrame, sample_id: Column, language: Column, gold: Column, tokens: Column, text: Column) -> DataFrame:
    packed = F.transform(F.arrays_zip(tokens.alias("t"), gold.alias("g")), lambda x: F.struct(x["t"]["idx"].alias("idx"), x["t"]["token"].alias("token"), x["t"]["s"].alias("s"), x["t"]["e"].alias("e"), x["g"].alias("gold")))
    out = df.select(sample_id.cast("string").alias("sample_id"), text.alias("text"), language.alias("language"), packed.alias("tokens"), F.create_map().cast("map<string,string>").alias("metadata"))
    return out.where(F.size("tokens") > 0)


def span_samples(df: DataFrame, sample_id: str, text: str, spans: Column, language: Column, classes=None) -> DataFrame:
    """Samples from text and character spans (label, start, end), aligned to words."""
    wanted = F.filter(spans, lambda s: s["label"].isin(*classes)) if classes else spans
    placed = F.array_sort(F.transform(wanted, lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), s["label"].alias("class"))))
    rows = df.withColumn("_w", word_tokens(F.col(text))).withColumn("_s", placed)
    return _finish(rows, F.col(sample_id), language, align(F.col("_w"), F.col("_s")), F.col("_w"), F.col(text))


def token_samples(df: DataFrame, sample_id: str, tokens: str, gold: Column, language: Column, entities_only: bool = False) -> DataFrame:
    """Samples from word lists and labels; the text is the words joined by spaces."""
    offsets = joined_offsets(F.col(tokens))
    words = F.transform(F.arrays_zip(F.col(tokens).alias("w"), offsets.alias("o")), lambda x, i: F.struct(i.alias("idx"), x["w"].alias("token"), x["o"]["s"].alias("s"), x["o"]["e"].alias("e")))
    rows = df.withColumn("_g", gold)
    if entities_only:
        rows = rows.where(F.exists("_g", lambda x: x != "O"))
    return _finish(rows, F.col(sample_id), language, F.col("_g"), words, F.array_join(tokens, " "))


def tags(column: str, names) -> Column:
    """Integer tags as labels, O for unknown ones."""
    table = F.array(*[F.lit(x) for x in names])
    return F.transform(F.col(column), lambda t: F.coalesce(F.get(table, t), F.lit("O")))


def read_ai4privacy(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema("uid string, source_text string, language string, privacy_mask array<struct<label:string,start:int,end:int,value:string>>").parquet(path)
    return span_samples(df, "uid", "source_text", F.col("privacy_mask"), F.col("language"), PII_CLASSES)


def read_nemotron(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema("uid string, text string, spans string").json(path)
    return span_samples(df, "uid", "text", parse_spans(F.col("spans")), F.lit("en"))


def read_wikineural(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Languages by path; those whose files don't exist are left out."""
    out = None
    for language, path in paths.items():
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            continue
        df = spark.read.schema("id string, tokens array<string>, ner_tags array<int>").json(path)
        one = token_samples(df, "id", "tokens", tags("ner_tags", CONLL_TAGS), F.lit(language))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], SAMPLE)


def read_bc5cdr(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema("id string, tokens array<string>, tags array<int>").json(path)
    return token_samples(df, "id", "tokens", tags("tags", BC5CDR_TAGS), F.lit("en"))


def read_labelled_jsonl(spark: SparkSession, path: str, labels: str = "ner_tags", sample_id: str = "id") -> DataFrame:
    """JSON lines of words and text labels (financial sets), as they are or in zip files; samples without entities are left out."""
    schema = f"{sample_id} string, tokens array<string>, {labels} array<string>"
    if path.lower().endswith(".zip"):
        df = zip_lines(spark, path).select(F.from_json("value", schema).alias("r")).select("r.*")
    else:
        df = spark.read.schema(schema).json(path)
    return token_samples(df, sample_id, "tokens", F.col(labels), F.lit("en"), entities_only=True)


def zip_lines(spark: SparkSession, path: str, suffix: str = ".jsonl") -> DataFrame:
    """(value): the lines of the files ending in ``suffix`` inside zip files, a line at a time."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in (n for n in archive.namelist() if n.endswith(suffix)):
                        with archive.open(name) as lines:
                            while part := list(itertools.islice(lines, 4096)):
                                yield pa.RecordBatch.from_arrays([pa.array([x.decode().rstrip("\r\n") for x in part], pa.string())], ["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string")


def read_folds(spark: SparkSession, path: str, folds, labels: str = "labels", sample_id: str = "document_id") -> DataFrame:
    """Samples of the named folds of a Parquet set: ``path``/FOLD_k*.parquet; those without entities are left out."""
    schema = f"{sample_id} string, tokens array<string>, {labels} array<string>"
    df = spark.read.schema(schema).parquet(*[f"{path}/FOLD_{k}*.parquet" for k in folds])
    return token_samples(df, sample_id, "tokens", F.col(labels), F.lit("en"), entities_only=True)


def read_tokenized(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(row_id, input_ids, attention_mask, labels) of a tokenized set in Parquet; ``n``: the first rows, the limit being the feature."""
    df = spark.read.schema("row_id long, input_ids array<int>, attention_mask array<int>, labels array<int>").parquet(path)
    return df if n is None else df.orderBy("row_id").limit(n)


def labelled_positions(tokenized: DataFrame, ignored: int = -100) -> DataFrame:
    """(row_id, idx, input_id, label) of the tokens that carry a label: padding and specials don't."""
    t = tokenized.select("row_id", F.posexplode(F.arrays_zip("input_ids", "attention_mask", "labels")).alias("idx", "t"))
    return t.where((F.col("t.labels") != ignored) & (F.col("t.attention_mask") == 1)).select("row_id", "idx", F.col("t.input_ids").alias("input_id"), F.col("t.labels").alias("label"))


def sample_count(dataset: str, asked: int | None = None, languages: int = 1) -> int | None:
    """Rows to take of a dataset: those asked for, else its default (per language), else all (None)."""
    default = DEFAULT_COUNTS.get(dataset)
    return asked if asked is not None else default * languages if default is not None else None


#: dataset: (domain, what its labels are, description)
_ABOUT = {
    "ai4privacy": ("pii", PII_CLASSES, "texts with masked spans of personal data"),
    "nvidia-pii": ("pii", tuple(sorted(NEMOTRON_FULL)), "synthetic texts with spans of personal data"),
    "wikineural": ("general", ("LOC", "MISC", "ORG", "PER"), "encyclopedia sentences in several languages"),
    "bc5cdr": ("biomedical", BIOMEDICAL_CLASSES, "abstracts with chemicals and diseases"),
    "finer-139": ("financial", (), "filings with numeric tags"),
    "buster": ("financial", FINANCIAL_CLASSES, "filings with parties of transactions"),
}


def describe(spark: SparkSession) -> DataFrame:
    """(name, domain, description, native_labels, default_count) of every dataset."""
    rows = [(n, domain, about, sorted(labels), DEFAULT_COUNTS.get(n)) for n, (domain, labels, about) in _ABOUT.items()]
    return spark.createDataFrame(rows, "name string, domain string, description string, native_labels array<string>, default_count int")


def native_labels(samples: DataFrame) -> DataFrame:
    """(label) of the classes that occur in samples."""
    found = samples.select(F.explode("tokens").alias("t")).select(F.regexp_replace("t.gold", "^[BI]-", "").alias("label"))
    return found.where("label <> 'O'").distinct()


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """(label_id, label) of a JSON object of ids."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "label")).select(F.col("k").cast("int").alias("label_id"), "label")


def normal_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[ _]", "-")


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """(system, dataset, sys_label, ord, ds_label) of a nested JSON object."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,map<string,array<string>>>>").alias("m"))
    return alignment_rows(raw)


def alignment_rows(raw: DataFrame) -> DataFrame:
    a = raw.select(F.explode("m").alias("system", "d")).select("system", F.explode("d").alias("dataset", "l")).select("system", "dataset", F.explode("l").alias("sys_label", "x"))
    return a.select(normal_name(F.col("system")).alias("system"), normal_name(F.col("dataset")).alias("dataset"), "sys_label", F.posexplode("x").alias("ord", "ds_label"))


def given_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(path, text) of texts given on a command line."""
    return spark.createDataFrame([(f"text-{k}", t) for k, t in enumerate(texts)], "path string, text string")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def subsample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash of the key: a sampling operator, so the limit is the feature."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(n)


def split(df: DataFrame, n: int, key: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(calibration, evaluation): the n rows of subsample() and the rest."""
    first = subsample(df, n, key, seed)
    return first, df.join(first.select(key), key, "left_anti")


def tokens_of(samples: DataFrame) -> DataFrame:
    """One row per word."""
    return samples.select("sample_id", F.explode("tokens").alias("t")).select("sample_id", "t.*")


def map_labels(tokens: DataFrame, mapping: dict[str, str], excluded=(), label: str = "gold") -> DataFrame:
    """Dataset labels as model labels, O where unmapped; words of excluded labels are left out. (``mapped``: whether the map has it.)"""
    cls = F.regexp_replace(F.col(label), "^[BI]-", "")
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    to = F.try_element_at(table, cls)
    rows = tokens.where(~cls.isin(*excluded)) if excluded else tokens
    new = F.when(to.isNull() | (to == "O"), "O").otherwise(F.concat(F.substring(F.col(label), 1, 2), to))
    return rows.withColumn("mapped", (F.col(label) == "O") | to.isNotNull()).withColumn(label, F.when(F.col(label) == "O", "O").otherwise(new))
