"""Experiments over systems, datasets and variants: what runs, what failed, how results compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import stars
from ..operators import calibrate, evaluate, route
from ..sources import adapters

#: Dataset readers by name.
DATASETS = {
    "ai4privacy": adapters.read_ai4privacy, "nvidia-pii": adapters.read_nemotron, "wikineural": adapters.read_wikineural, "bc5cdr": adapters.read_bc5cdr,
    "finer-139": adapters.read_labelled_jsonl, "buster": lambda spark, path: adapters.read_folds(spark, path, (5,)),
}


def load(spark: SparkSession, dataset: str, path: str, max_samples: int | None = None, seed: int = 42, languages: int = 1) -> DataFrame:
    """Samples of a dataset by name: ``max_samples`` of them, else the dataset's default number for each language, else all; the same rows
    for the same seed, whatever the partitions. An unknown name is an error that says which are known."""
    if dataset not in DATASETS:
        raise ValueError(f"unknown dataset {dataset}; known are {', '.join(sorted(DATASETS))}")
    samples = DATASETS[dataset](spark, path)
    wanted = adapters.sample_count(dataset, max_samples, languages)
    return samples if wanted is None else adapters.subsample(samples, wanted, "sample_id", seed)


def combinations(systems: DataFrame, datasets: DataFrame) -> DataFrame:
    """Every system with every dataset, to be run in this order: two small tables of names."""
    return systems.crossJoin(datasets).orderBy("system", "dataset")


def backfill(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """gold (sample_id, idx, gold) with predictions (sample_id, idx, pred); words of failed samples are O."""
    return gold.join(predicted.select("sample_id", "idx", "pred"), ["sample_id", "idx"], "left").withColumn("pred", F.coalesce("pred", F.lit("O")))


def ablation(tokens: DataFrame) -> DataFrame:
    """(variant, average, precision, recall, f1): every variant's routed tokens (label, entropy, confidence, gold, pred) get the verdict
    ``fixed``, the others keep ``pred``. Tokens are scored once; the five variants come from one pass."""
    decided = route.ablate(tokens)
    routed = F.col("decision").isin("routed", "routed_o")
    return evaluate.averages(evaluate.per_label(decided.withColumn("pred", F.when(routed, F.col("fixed")).otherwise(F.col("pred"))), ["variant"]), ["variant"])


def sample_scores(words: DataFrame) -> DataFrame:
    """(sample_id, a, b): strict entity F1 of each sample for both systems of words (sample_id, idx, gold, a, b); 0 where there is no entity."""
    out = words.select("sample_id").distinct()
    for c in ("a", "b"):
        f1 = evaluate.entity_scores(words.withColumn("pred", F.col(c)), ["sample_id"], strict=True).select("sample_id", F.col("f1").alias(c))
        out = out.join(f1, "sample_id", "left")
    return out.select("sample_id", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))


def significance(domains: dict[str, DataFrame], replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """One row per domain from words (sample_id, idx, gold, a, b) that both systems labelled: per-sample strict entity F1 compared by
    bootstrap, per-word agreement by McNemar's test, with stars. Comparing different sample sets is an error when the row is computed."""
    out = None
    for name, words in domains.items():
        missing = F.raise_error(F.lit(f"{name}: the systems labelled different words"))
        words = words.withColumns({c: F.coalesce(c, missing) for c in ("a", "b")})
        right = {c: F.col(c) == F.col("gold") for c in ("a", "b")}
        scores = sample_scores(words)
        row = calibrate.paired_bootstrap(scores, replicates, seed).withColumnRenamed("p", "bootstrap_p").crossJoin(calibrate.mcnemar(words.select(right["a"].alias("right_a"), right["b"].alias("right_b"))).withColumnRenamed("p", "mcnemar_p"))
        row = row.select(F.lit(name).alias("domain"), "*", stars(F.col("bootstrap_p")).alias("stars"))
        out = row if out is None else out.unionByName(row)
    return out


def compare_models(rows: DataFrame, baseline: str) -> DataFrame:
    """(model, size_mb, f1, ms) against the row of ``baseline``: share of its size and F1, and how many times as fast."""
    base = rows.where(F.col("model") == baseline).select(F.col("size_mb").alias("b_size"), F.col("f1").alias("b_f1"), F.col("ms").alias("b_ms"))
    return rows.crossJoin(F.broadcast(base.limit(1))).select("model", (F.col("size_mb") / F.col("b_size")).alias("size_ratio"), (F.col("f1") / F.col("b_f1")).alias("f1_retained"), (F.col("b_ms") / F.col("ms")).alias("speed_up"))
