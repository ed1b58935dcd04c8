"""Quality rules with risk-controlled thresholds.

Each rule is a score of the whole text (higher is worse) and a cutoff per stratum (the language); a text whose score is
above the cutoff is rejected. Cutoffs come from the labelled rows: for a stratum and rule the grid is tested from the most
lenient cutoff on, each by the exact (Clopper-Pearson) upper bound of its false rejections among rows of quality 1, and the
first cutoff whose bound is above the rule's share of ALPHA ends the walk (fixed-sequence testing). The confidence is
divided by strata times rules (Bonferroni), so with probability 1 - DELTA no stratum loses more than ALPHA of its good
texts by the rules together. Of the admitted cutoffs the one with the most rejections of bad rows less COST times those of
good rows is used, the more lenient at ties; where none is admitted (few labels, unknown stratum) the rule rejects nothing.

Null text counts as empty: no words, so base_failed. A null lang is a stratum of its own. Labels of a doc_id that occur
twice count with their smallest quality; null labels are left out. Repeated rows of the documents give repeated results and
are counted once each. Empty tables give no rows, or no cutoffs. Other columns pass through ``judge`` unless they are named like its
own columns, which replace them.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, quoted, read, small_side, texts

ALPHA, DELTA, COST = 0.05, 0.05, 20
MIN_WORDS = 50
RULES = ("symbols", "dup_lines", "repeats", "word_length", "capitals", "bangs")
#: Scores are in thousandths; one grid for all rules, most lenient first. A score above the last value exceeds every cutoff.
GRID = tuple(sorted({round(10 ** (k / 16)) for k in range(0, 65)} | {0}, reverse=True))

_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters", "n_bangs")
_TYPE = T.StructType([T.StructField(f, T.LongType(), False) for f in _FIELDS])
_SYMBOLS = tuple(b"#*$%&|<>")
_CLASSES = np.zeros((256, 4), np.int64)
_CLASSES[list(_SYMBOLS), 0] = 1
_CLASSES[65:91, 1] = 1
_CLASSES[65:91, 2] = 1
_CLASSES[97:123, 2] = 1
_CLASSES[33, 3] = 1
#: Bytes that start a code point and are no white space.
_STARTS = np.ones(256, np.int64)
_STARTS[0x80:0xC0] = 0
_STARTS[[9, 10, 11, 12, 13, 32]] = 0


def features(data: bytes) -> tuple[int, ...]:
    """The counts of _FIELDS of one text in UTF-8."""
    words = data.split()
    n = len(words)
    histogram = np.zeros(256, np.int64)
    for at in range(0, len(data), 1 << 22):
        histogram += np.bincount(np.frombuffer(data[at : at + (1 << 22)], np.uint8), minlength=256)
    symbols, capitals, letters, bangs = (int(x) for x in histogram @ _CLASSES)
    repeats = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        counts = Counter(windows)
        if len(counts) < len(windows):
            twice = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : k + len(twice)] |= twice
            repeats = int(covered.sum())
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return n, int(histogram @ _STARTS), symbols, len(lines) - len(set(lines)), repeats, len(lines), capitals, letters, bangs


@F.arrow_udf(_TYPE)
def text_features(column: pa.Array) -> pa.Array:
    rows = np.array([features(x) for x in texts(column)], np.int64).reshape(-1, len(_FIELDS))
    return pa.StructArray.from_arrays([pa.array(rows[:, k].tolist(), pa.int64()) for k in range(len(_FIELDS))], list(_FIELDS))


#: Declared as not deterministic, so that a filter on its result doesn't compute it a second time.
text_features = text_features.asNondeterministic()


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts as columns, and base_failed."""
    out = docs.withColumn("_f", text_features(F.col("text")))
    out = out.withColumns({f: F.col(f"_f.{f}") for f in _FIELDS}).drop("_f")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _scores() -> dict:
    def per(a, b):
        return F.when(F.col(b) > 0, F.floor(1000 * F.col(a) / F.col(b))).otherwise(0).cast("long")

    return {
        "symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words"),
        "word_length": per("word_chars", "n_words"), "capitals": per("n_capitals", "n_letters"), "bangs": per("n_bangs", "n_words"),
    }


def _stratum():
    return F.col("lang").alias("stratum")


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p)."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    gammas = np.array([math.lgamma(x + 1) for x in range(n + 1)]) if n < 4096 else None
    if gammas is None:
        choose = np.array([math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) for x in range(k + 1)])
    else:
        choose = gammas[n] - gammas[i] - gammas[n - i]
    logs = choose + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return min(1.0, math.exp(top) * float(np.exp(logs - top).sum()))


def admitted(k: int, n: int, alpha: float, delta: float) -> bool:
    """Whether the exact upper bound, at confidence 1 - delta, of a rate seen k times in n is at most alpha.

    The Clopper-Pearson bound is at most alpha exactly if P(X <= k) <= delta for X ~ Binomial(n, alpha)."""
    return n > 0 and k < n * alpha and binomial_cdf(k, n, alpha) <= delta


def choose_cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff) from ``labelled`` (lang, quality and the feature columns). A group of the choice holds one row per grid value."""
    grid = F.array(*[F.lit(x).cast("long") for x in GRID])
    long = labelled.select(_stratum(), (F.col("quality") == 1).alias("good"), F.explode(F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(*_scores().values()))).alias("rule", "score"))
    # a text is rejected by the cutoffs below its score: those from position ``step`` of the grid on
    step = F.size(F.filter(grid, lambda c: c >= F.col("score")))
    hist = long.groupBy("stratum", "rule", step.alias("step")).agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    hist = materialize(hist, "quality-histogram")
    strata = hist.select("stratum").distinct().count()
    share, level = alpha / len(RULES), delta / max(1, strata * len(RULES))

    def choose(table: pa.Table) -> pa.Table:
        good, bad = np.zeros(len(GRID) + 1, np.int64), np.zeros(len(GRID) + 1, np.int64)
        for name, counts in (("good", good), ("bad", bad)):
            np.add.at(counts, table["step"].to_pylist(), table[name].to_pylist())
        n, best = int(good.sum()), (0, None)
        for at, cutoff in enumerate(GRID):
            lost = int(good[: at + 1].sum())
            if not admitted(lost, n, share, level):
                break
            gain = int(bad[: at + 1].sum()) - COST * lost
            if gain > best[0]:
                best = (gain, cutoff)
        rows = [{"stratum": table["stratum"][0].as_py(), "rule": table["rule"][0].as_py(), "cutoff": best[1]}] * (best[1] is not None)
        return pa.Table.from_pylist(rows, pa.schema([("stratum", pa.string()), ("rule", pa.string()), ("cutoff", pa.int64())]))

    return hist.groupBy("stratum", "rule").applyInArrow(choose, "stratum string, rule string, cutoff long")


def judge(docs: DataFrame, labels: DataFrame, texts_too: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, lang, more) with counts, base_failed and kept; cutoffs from ``labels`` (doc_id, quality).

    The counts are written without the texts; with ``texts_too`` the texts are counted once more rather than copied."""
    own = ("doc_id", "text", "lang")
    # other columns travel as one value, so that none can clash with a working column
    more = [c for c in docs.columns if c.lower() not in own and c.lower() not in (*_FIELDS, "base_failed", "kept")]
    carried = [F.struct(*[F.col(quoted(c)) for c in more]).alias("_more")] if more else []
    rows = docs.select(*own, *carried)
    marked = materialize(with_features(rows.select(*own) if texts_too else rows).drop("text"), "quality-docs")
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_l")).agg(F.min("quality").alias("quality"))
    labelled = marked.select("doc_id", "lang", *_FIELDS).join(known, F.col("doc_id") == F.col("_l"))
    cutoffs = choose_cutoffs(labelled).groupBy("stratum").pivot("rule", list(RULES)).agg(F.min("cutoff"))
    cutoffs = materialize(cutoffs.select(F.col("stratum").alias("_s"), *[F.col(r).alias(f"_cut_{r}") for r in RULES]), "quality-cutoffs")
    out = (with_features(rows) if texts_too else marked).join(small_side(cutoffs, cutoffs.count()), _stratum().eqNullSafe(F.col("_s")), "left")
    bad = F.lit(False)
    for rule, score in _scores().items():
        bad = bad | F.coalesce(score > F.col(f"_cut_{rule}"), F.lit(False))
    out = out.withColumn("kept", ~F.col("base_failed") & ~bad)
    kept = [F.col(f"_more.{quoted(c)}") if c in more else F.col(c) for c in docs.columns if c in more or c.lower() in own and c in out.columns]
    return out.select(*kept, *_FIELDS, "base_failed", "kept")


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = judge(docs, read(spark, sf_dir, "labels"), texts_too=False)
    return out.select("doc_id", *_FIELDS[:5], "base_failed", "kept")
