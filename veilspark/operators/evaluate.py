"""Metrics of predicted against gold word labels; tables have (sample_id, idx, gold, pred)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import entity, frequency_bucket, length_bucket
from .quantiles import exact_quantiles
from .tokens import bio_spans, sequence


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def per_label(tokens: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, label, tp, fp, fn, precision, recall, f1, support) for every label but O. The tokens are aggregated to (gold, pred) pairs
    first, so what is shuffled doesn't grow with them."""
    by = by or []
    pairs = tokens.groupBy(*by, "gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p")))
    rows = pairs.withColumn("x", F.explode(sides)).select(*by, "x.label", "n", "x.g", "x.p", (F.col("gold") == F.col("pred")).alias("hit")).where("label <> 'O'")
    out = rows.groupBy(*by, "label").agg(
        F.sum(F.when(F.col("hit") & (F.col("g") == 1), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~F.col("hit"), F.col("n") * F.col("p")).otherwise(0)).alias("fp"),
        F.sum(F.when(~F.col("hit"), F.col("n") * F.col("g")).otherwise(0)).alias("fn"),
    )
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall"))).withColumn("support", F.col("tp") + F.col("fn"))


def summary(tokens: DataFrame) -> DataFrame:
    """(level, entity, prefix, tp, fp, fn, support, precision, recall, f1) of labels, of their classes and of all, in one pass: the pairs of labels
    are counted once, and a rollup adds them up. level is label, class or total; what a level sums over is null."""
    pairs = tokens.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("gold") == F.col("pred")
    sides = F.array(
        F.struct(F.col("gold").alias("label"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(hit, 0).otherwise(F.col("n")).alias("fn")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.when(hit, 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("long").alias("fn")),
    )
    rows = pairs.select(F.explode(sides).alias("x")).select("x.*").where("label <> 'O'")
    rows = rows.select(entity(F.col("label")).alias("entity"), F.when(F.col("label").rlike("^[BI]-"), F.substring("label", 1, 1)).otherwise("").alias("prefix"), "tp", "fp", "fn")
    out = rows.rollup("entity", "prefix").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.grouping_id().alias("_g"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    level = F.when(F.col("_g") == 0, "label").when(F.col("_g") == 1, "class").otherwise("total")
    out = out.where("_g < 3 or tp is not null").select(level.alias("level"), "entity", "prefix", "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"), p.alias("precision"), r.alias("recall"))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def averages(labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, average, precision, recall, f1): macro, micro and weighted over the rows of per_label()."""
    by = by or []
    tp, fp, fn, n = F.sum("tp"), F.sum("fp"), F.sum("fn"), F.sum("support")
    micro_p, micro_r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    kinds = [
        ("macro", *[F.avg(m) for m in ("precision", "recall", "f1")]),
        ("micro", micro_p, micro_r, f1(micro_p, micro_r)),
        ("weighted", *[ratio(F.sum(F.col(m) * F.col("support")), n) for m in ("precision", "recall", "f1")]),
    ]
    packed = F.array(*[F.struct(F.lit(k).alias("average"), p.alias("precision"), r.alias("recall"), f.alias("f1")) for k, p, r, f in kinds])
    return labels.groupBy(*by).agg(packed.alias("a")).select(*by, F.explode("a").alias("a")).select(*by, "a.*")


def entity_scores(tokens: DataFrame, by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Exact-match chunks: (by, tp, n_gold, n_pred, precision, recall, f1)."""
    by = by or []
    gold = bio_spans(tokens.withColumn("label", F.col("gold")), strict=strict)
    pred = bio_spans(tokens.withColumn("label", F.col("pred")), strict=strict)
    both = gold.withColumn("side", F.lit("g")).unionByName(pred.withColumn("side", F.lit("p")))
    chunk = both.groupBy("sample_id", "class", "first_idx", "last_idx").agg(F.max((F.col("side") == "g").cast("int")).alias("g"), F.max((F.col("side") == "p").cast("int")).alias("p"))
    out = chunk.groupBy(*by).agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("n_pred"))).withColumn("recall", ratio(F.col("tp"), F.col("n_gold")))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def confusion(tokens: DataFrame) -> DataFrame:
    """(gold, pred, n) over the sorted union of labels, zeros included: a cross product of labels, never of tokens."""
    seen = tokens.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    labels = seen.select(F.explode(F.array("gold", "pred")).alias("l")).distinct()
    grid = labels.select(F.col("l").alias("gold")).crossJoin(labels.select(F.col("l").alias("pred")))
    return grid.join(seen, ["gold", "pred"], "left").select("gold", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def by_length(tokens: DataFrame, samples: DataFrame) -> DataFrame:
    """(bucket, n_samples, f1_macro) by the samples' (sample_id, n_chars); buckets without samples score 0."""
    sized = samples.select("sample_id", length_bucket(F.col("n_chars")).alias("bucket"))
    scores = averages(per_label(tokens.join(sized, "sample_id"), ["bucket"]), ["bucket"]).where("average = 'macro'").select("bucket", F.col("f1").alias("f1_macro"))
    counts = sized.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_samples"))
    names = tokens.sparkSession.createDataFrame([("short",), ("medium",), ("long",)], "bucket string")
    return names.join(counts, "bucket", "left").join(scores, "bucket", "left").select("bucket", F.coalesce("n_samples", F.lit(0)).alias("n_samples"), F.coalesce("f1_macro", F.lit(0.0)).alias("f1_macro"))


def by_frequency(tokens: DataFrame) -> DataFrame:
    """(bucket, n_entities, entities, f1_macro): classes by their number of gold tokens."""
    counts = tokens.where("gold <> 'O'").groupBy(entity(F.col("gold")).alias("class")).agg(F.count(F.lit(1)).alias("n")).select("class", frequency_bucket(F.col("n")).alias("bucket"))
    labels = per_label(tokens).withColumn("class", entity(F.col("label"))).join(F.broadcast(counts), "class")
    return labels.groupBy("bucket").agg(F.countDistinct("class").alias("n_entities"), F.array_join(F.array_sort(F.collect_set("class")), ",").alias("entities"), F.avg("f1").alias("f1_macro"))


def errors(tokens: DataFrame, kind: str, labels=None, limit: int = 500) -> DataFrame:
    """The first ``limit`` false positives ("fp": gold O, an entity predicted) or negatives ("fn": a gold entity, predicted O) in document
    order with three words on either side; an entity taken for another is neither. Words with a class outside ``labels`` on either
    side are skipped. A top-k report: limit is the feature."""
    w = sequence()
    around = F.array_join(F.collect_list("token").over(w.rowsBetween(-3, 3)), " ")
    one, other = ("pred", "gold") if kind == "fp" else ("gold", "pred")
    rows = tokens.withColumn("context", around).where((F.col(one) != "O") & (F.col(other) == "O"))
    if labels is not None:
        rows = rows.where(entity(F.col(one)).isin(*labels))
    return rows.orderBy("sample_id", "idx").limit(limit).select("sample_id", "idx", "token", "context", "pred", "gold")


def latency(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, mean_ms, median_ms, p95_ms, p99_ms, per_second) of millisecond latencies: exact quantiles, interpolated, and units per second."""
    by = by or []
    found = exact_quantiles(df, value, (0.5, 0.95, 0.99), by)
    means = df.groupBy(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)]).agg(F.avg(value).alias("mean_ms"), (F.count(value) / F.sum(value) * 1000).alias("per_second"))
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & found[c].eqNullSafe(F.col(f"_g{k}"))
    out = found.join(means, same) if by else found.crossJoin(F.broadcast(means))
    return out.select(*by, "mean_ms", *[F.get("quantiles", k).alias(n) for k, n in enumerate(("median_ms", "p95_ms", "p99_ms"))], "per_second")


def accuracy(tokens: DataFrame) -> DataFrame:
    return tokens.agg(F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n_tokens"))


def effect(tokens: DataFrame) -> DataFrame:
    """What a hybrid changed (gold, base, hybrid): changed, helped, hurt, net, both accuracies."""
    changed = F.col("base") != F.col("hybrid")
    helped, hurt = (F.sum((changed & (F.col(x) == F.col("gold"))).cast("long")) for x in ("hybrid", "base"))
    return tokens.agg(
        F.sum(changed.cast("long")).alias("changed"), helped.alias("helped"), hurt.alias("hurt"), (helped - hurt).alias("net"),
        F.avg((F.col("base") == F.col("gold")).cast("double")).alias("base_accuracy"), F.avg((F.col("hybrid") == F.col("gold")).cast("double")).alias("hybrid_accuracy"),
    )


def mask_labels(tokens: DataFrame, classes) -> DataFrame:
    """Labels of other classes become O on either side."""
    def keep(c):
        return F.when(entity(F.col(c)).isin(*classes), F.col(c)).otherwise("O")

    return tokens.withColumn("gold", keep("gold")).withColumn("pred", keep("pred"))


def label_overlap(system: DataFrame, dataset: DataFrame) -> DataFrame:
    """(side, label): shared, system_only, dataset_only."""
    s, d = system.select("label").distinct().withColumn("s", F.lit(True)), dataset.select("label").distinct().withColumn("d", F.lit(True))
    side = F.when(F.col("s") & F.col("d"), "shared").when(F.col("s"), "system_only").otherwise("dataset_only")
    return s.join(d, "label", "full").select(side.alias("side"), "label")


def aligned_overlap(system: DataFrame, dataset: DataFrame, alignment: DataFrame) -> DataFrame:
    """The same by an alignment (sys_label, ord, ds_label): (side, label)."""
    hits = alignment.join(system.select(F.col("label").alias("sys_label")), "sys_label", "left_semi").join(dataset.select(F.col("label").alias("ds_label")), "ds_label", "left_semi")
    used, met = hits.select(F.col("sys_label").alias("label")).distinct(), hits.select(F.col("ds_label").alias("label")).distinct()
    return (
        met.select(F.lit("shared").alias("side"), "label")
        .unionByName(system.join(used, "label", "left_anti").select(F.lit("system_only").alias("side"), "label"))
        .unionByName(dataset.join(met, "label", "left_anti").select(F.lit("dataset_only").alias("side"), "label"))
    )


def remap(pred: Column, gold: Column, targets: Column) -> Column:
    """A prediction whose class aligns with several dataset labels becomes the gold one if it is among them, else the first."""
    cls = F.when(F.array_contains(targets, entity(gold)), entity(gold)).otherwise(F.get(targets, 0))
    return F.when(targets.isNull() | (F.size(targets) == 0), "O").otherwise(F.concat(F.substring(pred, 1, 2), cls))


def rank_systems(df: DataFrame, score: str = "f1_macro") -> DataFrame:
    return df.withColumn("rank", F.rank().over(W.partitionBy("dataset").orderBy(F.desc(score))))


def pareto(df: DataFrame, cost: str, score: str) -> DataFrame:
    """Rows that nothing cheaper beats: by rising cost, then score, those that reach the running maximum; ties stay. One row per system meets here."""
    w = W.orderBy(F.col(cost), F.col(score)).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("on_front", F.col(score) >= F.max(score).over(w))


def reverse_alignment(alignment: DataFrame) -> DataFrame:
    """(system, dataset, ds_label, sys_label): of several system labels for a dataset label the last one, by (sys_label, ord)."""
    return alignment.groupBy("system", "dataset", "ds_label").agg(F.max_by("sys_label", F.struct("sys_label", "ord")).alias("sys_label"))


def mean_by_entity(labels: DataFrame) -> DataFrame:
    """(entity, f1): mean F1 of the rows of per_label() of a class, its B- and I-."""
    return labels.where("label <> 'O'").groupBy(entity(F.col("label")).alias("entity")).agg(F.avg("f1").alias("f1"))


def delta(df: DataFrame, baseline: str, score: str = "f1_macro", by: str = "dataset", higher: bool = True) -> DataFrame:
    """``df`` (system, by, score) with delta to the ``baseline`` system of the same ``by`` (null where it has none) and best, whether none is better."""
    base = df.where(F.col("system") == baseline).groupBy(by).agg(F.max(score).alias("_base"))
    best = (F.max if higher else F.min)(score).over(W.partitionBy(by))
    return df.join(F.broadcast(base), by, "left").withColumn("delta", F.col(score) - F.col("_base")).withColumn("best", F.col(score) == best).drop("_base")


def paired_domains(rows: DataFrame, base: str, hybrid: str, scores=("f1_macro", "entity_f1")) -> DataFrame:
    """One row per domain from (domain, system, scores): both systems' scores side by side and the delta. Domains that lack one are left out."""
    a, b = (rows.where(F.col("system") == s).select("domain", *[F.col(c).alias(f"{c}_{side}") for c in scores]) for s, side in ((base, "base"), (hybrid, "hybrid")))
    return a.join(b, "domain").select("*", *[(F.col(f"{c}_hybrid") - F.col(f"{c}_base")).alias(f"{c}_delta") for c in scores])


def variant_grid(df: DataFrame, variants: list[str], score: str = "f1_macro") -> DataFrame:
    """One row per model, one column per variant; a combination that wasn't run is 0."""
    return df.groupBy("model").pivot("variant", variants).agg(F.max(score)).na.fill(0.0)


def intervention_report(tokens: DataFrame) -> DataFrame:
    """One row of (gold, base, hybrid, entropy) over words with a gold entity or a prediction: n_active, both accuracies, share of words
    changed, of the changes those that corrected, mean entropy of right and wrong base labels."""
    active = tokens.where("gold <> 'O' or base <> 'O' or hybrid <> 'O'")
    right, changed = F.col("base") == F.col("gold"), F.col("base") != F.col("hybrid")
    return active.agg(
        F.count(F.lit(1)).alias("n_active"), F.avg(right.cast("double")).alias("base_accuracy"), F.avg((F.col("hybrid") == F.col("gold")).cast("double")).alias("hybrid_accuracy"),
        F.avg(changed.cast("double")).alias("intervention_rate"), F.sum((changed & (F.col("hybrid") == F.col("gold"))).cast("long")).alias("corrections"),
        F.avg(F.when(right, F.col("entropy"))).alias("entropy_right"), F.avg(F.when(~right, F.col("entropy"))).alias("entropy_wrong"),
    )


def span_evaluation(tokens: DataFrame, timings: DataFrame, warm_up: int = 10) -> DataFrame:
    """Entity scores (strict) and latency of one run: the first ``warm_up`` samples, by sample_id, aren't timed. timings: (sample_id, ms)."""
    first = timings.orderBy("sample_id").limit(warm_up).select("sample_id")
    timed = latency(timings.join(first, "sample_id", "left_anti"), "ms")
    return entity_scores(tokens, strict=True).crossJoin(timed)
