"""Spans of scored tokens and the decision which of them go to the arbiter.

Token tables have (sample_id, idx, s, e, label, entropy, confidence); every window is over one sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import entity, uncertain
from ..functions.registry import PII_CLASSES, PII_ROUTES, RouteConfig
from .intervals import least_overlap, marked
from .tokens import sequence


def placed(tokens: DataFrame, key: str = "sample_id") -> DataFrame:
    """``tokens`` with prev_label, the label before or O, and place, 1, 2, 3... in the sample: all that routing needs of the other tokens. The
    operators below look at few tokens then; tables without these columns get them there."""
    if {"prev_label", "place"} <= set(tokens.columns):
        return tokens
    w = sequence(key)
    return tokens.withColumn("prev_label", F.lag("label", 1, "O").over(w)).withColumn("place", F.row_number().over(w))


def thresholds(cls: Column, config: RouteConfig) -> tuple[Column, Column]:
    """(entropy, confidence) thresholds of a class: its own, those of "DEFAULT", or the configuration's."""
    entropy, confidence = config.thresholds.get("DEFAULT", (config.entropy, config.confidence))
    entropy, confidence = F.lit(entropy), F.lit(confidence)
    for name, (e, c) in config.thresholds.items():
        if name != "DEFAULT":
            entropy, confidence = F.when(cls == name, e).otherwise(entropy), F.when(cls == name, c).otherwise(confidence)
    return entropy, confidence


def decision(label: Column, entropy: Column, confidence: Column, config: RouteConfig = PII_ROUTES) -> Column:
    """routed, routed_o, or what blocked it: blocked_by_threshold, blocked_by_continuation, blocked_by_entity.

    O is a class like others to ``blocked`` and ``routable``; where ``routable`` leaves it out it is routed from ``o_multiplier`` times
    the threshold on. What falls through counts as blocked by threshold. ``routable_inside`` None blocks no I-."""
    cls = entity(label)
    above, below = thresholds(cls, config)
    out = F.when(~uncertain(entropy, confidence, above, below), "blocked_by_threshold")
    if not config.selective:
        return out.otherwise("routed")
    if config.block_inside and config.routable_inside is not None:
        out = out.when(label.startswith("I-") & ~cls.isin(*config.routable_inside), "blocked_by_continuation")
    out = out.when(cls.isin(*config.blocked), "blocked_by_entity")
    if config.routable is None:
        return out.otherwise("routed")
    out = out.when(cls.isin(*config.routable), "routed")
    return out.when((label == "O") & (entropy > config.o_multiplier * above), "routed_o").otherwise("blocked_by_threshold")


def legacy_decision(label: Column, entropy: Column, confidence: Column, blocked=(), routable=PII_CLASSES, config: RouteConfig = PII_ROUTES) -> Column:
    """The token router with one pair of thresholds: uncertain, and O or a routable class that isn't blocked; unknown classes are not routed."""
    cls = entity(label)
    unsure = uncertain(entropy, confidence, config.entropy, config.confidence)
    if not config.selective:
        return unsure
    return unsure & ~cls.isin(*blocked) & ((cls == "O") | cls.isin(*routable))


def route_stats(decided: DataFrame) -> DataFrame:
    """One row: calls, routed, blocked by what, rate in percent with two digits."""
    def count(*names):
        return F.sum(F.col("decision").isin(*names).cast("long"))

    return decided.agg(
        F.count(F.lit(1)).alias("checked"), count("routed", "routed_o").alias("routed"), count("routed_o").alias("routed_o"), count("blocked_by_threshold").alias("blocked_by_threshold"),
        count("blocked_by_continuation").alias("blocked_by_continuation"), count("blocked_by_entity").alias("blocked_by_entity"),
        F.format_string("%.2f%%", 100.0 * count("routed", "routed_o") / F.count(F.lit(1))).alias("routing_rate"),
    )


def entity_spans(tokens: DataFrame, config: RouteConfig = PII_ROUTES, key: str = "sample_id") -> DataFrame:
    """(key, span_id, class, first_idx, last_idx, s, e, is_uncertain, prev_label): B- starts a span, I- of its class extends it, anything
    else ends it. Whether a span is uncertain is decided by its first token."""
    cls = entity(F.col("label"))
    # a run: B- and the I- of its class after it; every other row breaks the run, and those that are O are in none
    continues = F.col("label").startswith("I-") & (entity(F.col("prev_label")) == cls) & (F.col("prev_label") != "O")
    rows = placed(tokens, key).where("label <> 'O'").withColumn("_break", (F.col("label").startswith("B-") | ~F.coalesce(continues, F.lit(False))).cast("int"))
    rows = rows.withColumn("_span", F.sum("_break").over(sequence(key)))
    above, below = thresholds(cls, config)
    rows = rows.withColumn("_cls", cls).withColumn("_unsure", uncertain(F.col("entropy"), F.col("confidence"), above, below))
    out = rows.groupBy(key, "_span").agg(
        F.min_by("label", "idx").alias("_first"), F.min_by("_cls", "idx").alias("class"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"),
        F.min("s").alias("s"), F.max_by("e", "idx").alias("e"), F.min_by("_unsure", "idx").alias("is_uncertain"), F.min_by("prev_label", "idx").alias("prev_label"),
    )
    return out.where("_first like 'B-%'").select(key, F.col("first_idx").alias("span_id"), "class", "first_idx", "last_idx", "s", "e", "is_uncertain", "prev_label")


def uncertain_o_spans(tokens: DataFrame, config: RouteConfig = PII_ROUTES, min_chars: int = 2, key: str = "sample_id") -> DataFrame:
    """Islands of O tokens with entropy above multiplier times the threshold and confidence below it, of min_chars or more."""
    unsure = (F.col("label") == "O") & (F.col("e") > F.col("s")) & uncertain(F.col("entropy"), F.col("confidence"), config.o_multiplier * config.entropy, config.confidence)
    rows = placed(tokens, key).where(unsure).withColumn("_island", F.col("place") - F.row_number().over(sequence(key)))
    out = rows.groupBy(key, "_island").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("prev_label", "idx").alias("prev_label"))
    return out.where(F.col("e") - F.col("s") >= min_chars).select(key, "first_idx", "last_idx", "s", "e", "prev_label")


VARIANTS = {
    "never_route": RouteConfig(entropy=1e9, confidence=-1.0, routable=PII_ROUTES.routable, routable_inside=PII_ROUTES.routable_inside),
    "always_route": RouteConfig(entropy=-1.0, confidence=2.0, routable=PII_ROUTES.routable, routable_inside=PII_ROUTES.routable_inside),
    "entropy_only": RouteConfig(entropy=PII_ROUTES.entropy, confidence=2.0, routable=PII_ROUTES.routable, routable_inside=PII_ROUTES.routable_inside),
    "confidence_only": RouteConfig(entropy=-1.0, confidence=PII_ROUTES.confidence, routable=PII_ROUTES.routable, routable_inside=PII_ROUTES.routable_inside),
    "full_system": PII_ROUTES,
}


def ablate(tokens: DataFrame) -> DataFrame:
    """Every token under every variant: scored once, five decisions in one row, then unpivoted."""
    decided = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), decision(F.col("label"), F.col("entropy"), F.col("confidence"), c).alias("decision")) for n, c in VARIANTS.items()])).alias("v")
    return tokens.select("*", decided).select("*", "v.variant", "v.decision").drop("v")


def covered(spans: DataFrame, found: DataFrame, key: str = "sample_id") -> DataFrame:
    """Spans inside a validated match of their class: these need no arbiter."""
    return marked(spans, found.where("valid"), [key, "class"], "inside", "_hit").where("_hit").drop("_hit")


def without_overlap(spans: DataFrame, others: DataFrame, key: str = "sample_id") -> DataFrame:
    """Spans that overlap none of ``others``."""
    return marked(spans, others, [key], "overlap", "_hit").where("not _hit").drop("_hit")


def unconfirmed(spans: DataFrame, found: DataFrame, classes, key: str = "sample_id") -> DataFrame:
    """Spans of ``classes`` that neither lie in a validated match of their class nor contain one: these are demoted."""
    out, valid = spans.where(F.col("class").isin(*classes)), found.where("valid")
    for kind in ("inside", "around"):
        out = marked(out, valid, [key, "class"], kind, "_hit").where("not _hit").drop("_hit")
    return out


def pending(tokens: DataFrame, spans: DataFrame, found: DataFrame, key: str = "sample_id") -> DataFrame:
    """Uncertain spans that no match settles, with the label before them."""
    unsure = spans.where("is_uncertain")
    settled = covered(unsure, found, key).select(key, "span_id")
    unsure = unsure.join(settled, [key, "span_id"], "left_anti")
    if "prev_label" in spans.columns:
        return unsure
    return unsure.join(placed(tokens, key).select(key, F.col("idx").alias("first_idx"), "prev_label"), [key, "first_idx"])


def hint_spans(tokens: DataFrame, found: DataFrame, taken: DataFrame, key: str = "sample_id") -> DataFrame:
    """Pattern hits where the model says O: (key, indices, first_idx, last_idx, class, s, e, prev_label), to be judged by the arbiter.

    A word belongs to the first validated hit, by (priority, s, e), that overlaps it, if its label is O and it lies in none of the
    spans ``taken`` (key, first_idx, last_idx) that are pending already. One hit after the other takes what the ones before it left, so
    the first hit of a word is all that matters."""
    hit = found.where("valid").select(key, "s", "e", F.struct("priority", F.col("s").alias("hs"), F.col("e").alias("he"), "class").alias("_hit"))
    tokens = placed(tokens, key).join(hit.select(key).distinct(), key, "left_semi")
    # a word is an interval of one index here
    free = tokens.where("e > s and label = 'O'").select(key, F.col("idx").alias("s"), F.col("idx").alias("e"), F.struct("s", "e").alias("_place"))
    free = marked(free, taken.select(key, F.col("first_idx").alias("s"), F.col("last_idx").alias("e")), [key], "inside", "_taken").where("not _taken")
    owned = least_overlap(free.select(key, F.col("s").alias("idx"), "_place.s", "_place.e"), hit, key, "_hit", "_hit").select(key, "idx", "_hit")
    before = tokens.select(key, F.col("idx").alias("first_idx"), "prev_label")
    out = owned.groupBy(key, "_hit").agg(F.array_sort(F.collect_list("idx")).alias("indices"))
    out = out.select(key, "indices", F.col("indices")[0].alias("first_idx"), F.array_max("indices").alias("last_idx"), F.col("_hit.class").alias("class"), F.col("_hit.hs").alias("s"), F.col("_hit.he").alias("e"))
    return out.join(before, [key, "first_idx"]).select(key, "indices", "first_idx", "last_idx", "class", "s", "e", "prev_label")


def shared_only(spans: DataFrame, shared) -> DataFrame:
    """Spans of classes that the model and the arbiter share: a restricted vocabulary routes nothing else."""
    return spans.where(F.col("class").isin(*shared))
