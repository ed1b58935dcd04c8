"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A seed is a fixed mask over SPAN words: the hash of the words at its kept positions, so that a substituted word at an
ignored position doesn't matter. Seeds of the benchmark items are joined with those of the documents; each hit fixes an
alignment of document and item, on which the words are compared. A leak is an alignment with a stretch of
min(STRETCH, item length) neighbouring words of which SHARE are equal. MASKS are chosen so that any stretch of STRETCH
words with up to two substitutions contains one of them unharmed. Items of MIN_WORDS to STRETCH - 1 words are looked for
as a whole, by masks of their own length (``whole_masks``) of which every pattern of substitutions that SHARE allows leaves
one unharmed; shorter ones identify nothing and are left out.

Words are runs without ASCII white space, compared in lower case. Null texts have no words. A null doc_id is kept as null;
repeated rows give one result. Benchmark rows with the same item_id but other texts are items of their own. Empty tables
give no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, free_name, materialize, read, row_key, small_side

STRETCH, SHARE, MIN_WORDS = 13, 0.8, 5
#: Kept positions of each mask.
MASKS = ((0, 1, 2, 5, 8, 9), (0, 2, 3, 4, 5, 8))
SPAN = 10
#: Seeds of the benchmark up to which they are broadcast (16 bytes each and the item).
BROADCAST_SEEDS = 500_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def whole_masks(n: int) -> list[tuple[int, ...]]:
    """Masks for items of ``n`` words: the words are dealt to two blocks more than substitutions are allowed, a mask keeps two of the blocks."""
    blocks = n - math.ceil(SHARE * n) + 2
    return [tuple(k for k in range(n) if k % blocks in kept) for kept in itertools.combinations(range(blocks), 2)]


def _seeds(hashes: Column, n: Column, masks, whole: bool) -> Column:
    """An array of all seed hashes, mask after mask: n of each mask, null where the item of the mask runs over the end. Masks are
    (length of the items they are for, at least STRETCH for all longer ones; kept positions). ``whole``: only the seeds of those items."""

    def of(k: int, length: int, mask) -> Column:
        kept = [lambda i, o=o: F.get(hashes, i + o) for o in mask]
        end = mask[-1] if length >= STRETCH else length - 1
        own = (n >= STRETCH if length >= STRETCH else n == length) if whole else F.lit(True)
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(own & (i + end < n), F.xxhash64(F.lit(k), *[g(i) for g in kept])))

    return F.concat(*[of(k, length, m) for k, (length, m) in enumerate(masks)])


def _exploded(df: DataFrame, keep: list[str], masks, whole: bool) -> DataFrame:
    """(keep, pos, h): every seed of the rows of ``df`` (words)."""
    hashed = df.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("_hs"), F.size("words").alias("_n")).where("_n > 0")
    rows = hashed.select(*keep, "_n", F.posexplode(_seeds(F.col("_hs"), F.col("_n"), masks, whole)).alias("_at", "h"))
    return rows.where("h is not null").select(*keep, (F.col("_at") % F.col("_n")).alias("pos"), "h")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start (word of the document where the item would begin), n_item_words, n_equal and best_stretch
    (equal words in the best stretch), one row per leak; ``_uid`` tells documents apart."""
    uid = row_key()
    items = benchmark.select("item_id", row_key("item_id").alias("iuid"), _words(F.col("text")).alias("words")).where(F.size("words") >= MIN_WORDS)
    items = materialize(items.dropDuplicates(["iuid"]), "leak-items")
    lengths = [r[0] for r in items.select(F.size("words").alias("n")).where(F.col("n") < STRETCH).distinct().collect()]
    masks = [(STRETCH, m) for m in MASKS] + [(n, m) for n in sorted(lengths) for m in whole_masks(n)]
    seeds = _exploded(items, ["iuid"], masks, True).select("iuid", F.col("pos").alias("item_pos"), "h")
    seeds = materialize(seeds, "leak-seeds")
    if seeds.count() <= BROADCAST_SEEDS:
        seeds = F.broadcast(seeds)
    texts = docs.select("doc_id", "text", uid.alias("uid")).withColumn("words", _words(F.col("text")))
    hits = _exploded(texts, ["uid"], masks, False).join(seeds, "h").select("uid", "iuid", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    hits = materialize(hits, "leak-hits")
    asked = hits.select("uid").distinct()
    few = asked.count()
    # only documents with a hit go on
    found = texts.join(small_side(asked, few), "uid", "left_semi").dropDuplicates(["uid"]).select("uid", "doc_id", "words")
    n_hits = hits.count()
    aligned = found.join(small_side(hits, n_hits), "uid")
    n_items = items.count()
    aligned = aligned.join(small_side(items.select("iuid", "item_id", F.col("words").alias("item")), n_items if n_items * 10 <= BROADCAST_ROWS else BROADCAST_ROWS + 1), "iuid")
    low, high = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("item"), F.size("words") - F.col("shift"))
    stretch = F.least(F.lit(STRETCH), F.size("item"))
    aligned = aligned.withColumn("low", low).withColumn("high", high).withColumn("stretch", stretch).where(F.col("high") - F.col("low") >= F.col("stretch"))
    equal = F.transform(F.sequence(F.col("low"), F.col("high") - 1), lambda j: (F.get("item", j) == F.get("words", j + F.col("shift"))).cast("int"))
    aligned = aligned.withColumn("equal", equal)
    total = F.aggregate("equal", F.lit(0), lambda a, x: a + x)
    inside = F.transform(F.sequence(F.lit(1), F.size("equal") - F.col("stretch") + 1), lambda s: F.aggregate(F.slice("equal", s, F.col("stretch")), F.lit(0), lambda a, x: a + x))
    aligned = aligned.withColumn("best_stretch", F.array_max(inside)).where(F.col("best_stretch") >= F.ceil(F.lit(SHARE) * F.col("stretch")))
    out = aligned.select("uid", "iuid", "doc_id", "item_id", F.col("shift").cast("long").alias("start"), F.size("item").cast("long").alias("n_item_words"), total.cast("long").alias("n_equal"), F.col("best_stretch").cast("long"))
    # of overlapping alignments of the same item the best one
    best = F.max(F.struct("n_equal", "best_stretch", (-F.col("start")).alias("back"), "doc_id", "item_id", "n_item_words")).alias("b")
    out = out.groupBy("uid", "iuid").agg(best, F.count(F.lit(1)).alias("n_alignments"))
    return out.select("b.doc_id", "b.item_id", (-F.col("b.back")).alias("start"), "b.n_item_words", "b.n_equal", "b.best_stretch", "n_alignments", F.col("uid").alias("_uid"))


def remove_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak."""
    key = free_name(docs, "_row_key")
    bad = materialize(leaks(docs, benchmark).select(F.col("_uid").alias(key)).distinct(), "leak-docs")
    return docs.withColumn(key, row_key()).join(small_side(bad, bad.count()), key, "left_anti").drop(key)


def decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("_uid")
