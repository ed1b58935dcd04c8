"""Writers and readers of experiments and reports. Files of one document go through Hadoop's file system, so any store will do."""

from __future__ import annotations

import json

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_experiment(tables: dict[str, DataFrame], path: str) -> None:
    """Each table (results, per_label, confusion, errors_fp, ...) as JSON lines in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def write_predictions(tokens: DataFrame, path: str) -> None:
    """Aligned predictions (sample_id, idx, gold, pred) by system and dataset if these are columns."""
    by = [c for c in ("system", "dataset") if c in tokens.columns]
    tokens.write.mode("overwrite").partitionBy(*by).parquet(path) if by else tokens.write.mode("overwrite").parquet(path)


def once(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; computed and written only if it isn't there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def summary(results: DataFrame) -> DataFrame:
    """(dataset, system, line): fixed-width lines, best macro F1 first."""
    line = F.format_string("%-40s %-16s %8.4f %8.4f %10.2f", "system", "dataset", "f1_macro", "f1_micro", "mean_ms")
    return results.select("dataset", "system", "f1_macro", line.alias("line")).orderBy("dataset", F.desc("f1_macro"), "system")


def pivot_entities(labels: DataFrame, systems: list[str]) -> DataFrame:
    """(entity, system...): mean F1 over the B- and I- labels with support."""
    rows = labels.where("support > 0").withColumn("entity", F.regexp_replace("label", "^[BI]-", ""))
    return rows.groupBy("entity").pivot("system", systems).agg(F.avg("f1"))


def markdown(df: DataFrame) -> DataFrame:
    """(line) of a Markdown table, a row per row."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Flat rows of nested result files: a missing number is zero."""
    schema = "system string, dataset string, n_samples long, token_level struct<f1:struct<macro:double,micro:double>>, entity_level struct<f1:double>, latency struct<mean_ms:double>"
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return flatten_results(df)


def flatten_results(df: DataFrame) -> DataFrame:
    def number(c):
        return F.coalesce(F.col(c), F.lit(0.0))

    return df.select("system", "dataset", F.coalesce("n_samples", F.lit(0)).alias("n_samples"), number("token_level.f1.macro").alias("f1_macro"), number("token_level.f1.micro").alias("f1_micro"), number("entity_level.f1").alias("entity_f1"), number("latency.mean_ms").alias("mean_ms"))


def _target(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A file of one text; folders are made as needed."""
    target, fs = _target(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _target(spark, path)
    return fs.exists(target)


def format_size(n_bytes: float) -> str:
    """Bytes with a unit, to one decimal."""
    for unit in ("B", "KB", "MB", "GB"):
        if n_bytes < 1024:
            return f"{n_bytes:.1f} {unit}"
        n_bytes /= 1024
    return f"{n_bytes:.1f} TB"


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, indent=2, ensure_ascii=False, default=str))


def _tree(row: dict) -> dict:
    """A flat row as a nested document: "a.b" is b inside a."""
    out: dict = {}
    for name, value in row.items():
        *path, last = name.split(".")
        at = out
        for part in path:
            at = at.setdefault(part, {})
        at[last] = value
    return out


def write_run(spark: SparkSession, path: str, config: dict, results: DataFrame, tables: dict[str, DataFrame] | None = None) -> None:
    """A run's folder: config.json, results.json and results.txt of the one row of ``results`` (columns like token_level.f1.macro), and ``tables``
    (confusion, per_label, errors_fp, ...) as folders of JSON lines, which may be large."""
    row = results.first().asDict(recursive=True)
    write_json(spark, f"{path}/config.json", config)
    write_json(spark, f"{path}/results.json", _tree(row))
    write_text(spark, f"{path}/results.txt", report(row))
    write_experiment(tables or {}, path)


def report(row: dict) -> str:
    """A results row as aligned text, one section per first part of the names."""
    lines, section = [], None
    for name, value in row.items():
        head, _, rest = name.partition(".")
        if rest and head != section:
            section = head
            lines += ["", head.replace("_", " ").title(), "-" * 40]
        shown = f"{value:.4f}" if isinstance(value, float) else str(value)
        lines.append(f"{(rest or head):<28} {shown:>12}")
    return "\n".join(lines).lstrip("\n") + "\n"


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run, value) of every results.json one folder below ``path``; value: the document's text."""
    df = spark.read.text(f"{path}/*/results.json", wholetext=True)
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/results[.]json$", 1).alias("run"), "value")


def read_per_label(spark: SparkSession, path: str) -> DataFrame:
    """Rows of every per_label table one folder below ``path``, with their run."""
    df = spark.read.schema("label string, precision double, recall double, f1 double, support long").json(f"{path}/*/per_label")
    return df.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/per_label/[^/]*$", 1))


def latest(spark: SparkSession, path: str, name: str) -> str | None:
    """The path of the last file of this name one folder below ``path``, by folder name; None if there is none."""
    found = spark.read.format("binaryFile").load(f"{path}/*/{name}").select("path") if exists(spark, path) else None
    return found.agg(F.max("path")).first()[0] if found is not None else None


def entity_json(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, entities): the entities of a document (class, s, e, text) as one JSON text, in order of place."""
    packed = F.array_sort(F.collect_list(F.struct("s", "e", F.col("class").alias("label"), "text")))
    return entities.groupBy(key).agg(F.to_json(packed).alias("entities"))


def write_table_report(df: DataFrame, path: str) -> None:
    """A small table twice: ``path``.csv and ``path``.md, each a folder of one file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}.csv")
    names = df.sparkSession.createDataFrame([("| " + " | ".join(df.columns) + " |",), ("|" + "---|" * len(df.columns),)], "line string").coalesce(1)
    names.union(markdown(df).coalesce(1)).coalesce(1).write.mode("overwrite").text(f"{path}.md")
