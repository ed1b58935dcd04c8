"""Mixing sources to target weights by nested hash thresholds.

Every row gets a 60-bit hash. A source with budget ``r`` keeps the rows whose hash is at most the source's threshold, so
nothing is sorted and a rerun keeps the same rows. The threshold is found by histograms: words by (source, 12 hash bits),
the bucket in which the budget runs out, then only that bucket's rows by the next 12 bits, until one hash value is left.

Null text has size 0, null source is a source of its own and comes last, null doc_id hashes like the text "null".
Rows that agree in doc_id (repeated rows) share a hash and are taken or left together. An empty table gives no rows.
Columns of the input beyond doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, read, small_side, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words asked for, as a share of all words.
SHARE = 1.5
#: No source, and no document, is taken more than so many times.
REPEAT = 2
BITS, HASH_BITS = 12, 60


def _hash(doc_id):
    """60 bits of the MD5 of the id's text: the same in any SQL engine that has md5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """(source, source_size, target): ``share`` of all words dealt by weight; what is above ``repeat`` times a source's size is
    dealt again to the others by weight. That ends at target = least(repeat * size, lambda * weight) for one lambda, which a
    running sum over the sources in order of cap / weight gives. One row per source meets here, never a document."""
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", w.cast("long"))
    per = per.withColumn("cap", F.lit(repeat) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = (
        per.withColumn("cap_before", F.coalesce(F.sum("cap").over(order), F.lit(0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(order), F.lit(0)))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(all_rows))
        .withColumn("w_all", F.sum("w").over(all_rows))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before")))
    )
    # from the first source on that lambda doesn't fill, levels only fall: lambda is the largest of them
    level = F.max(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.col("level"))).over(all_rows)
    per = per.withColumn("lambda", level)
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("lambda"), F.lit(0.0)) * F.col("w")).alias("target"))


def _thresholds(sized: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """Per source: the whole passes and the largest hash that the rest of its target takes."""
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = plan.select(F.col("source").alias("s"), full.alias("passes"), (F.col("target") - full * F.col("source_size")).alias("rest"))
    state = state.withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long"))
    rows = sized.select("source", "u", "size")
    for shift in range(HASH_BITS - BITS, -1, -BITS):
        inside = rows
        if shift + BITS < HASH_BITS:
            at = small_side(state.select(F.col("s"), "prefix"), n_sources)
            inside = rows.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("u", shift + BITS) == F.col("prefix"))).drop("s", "prefix")
        hist = inside.groupBy("source", F.shiftright("u", shift).alias("bucket")).agg(F.sum("size").alias("own"))
        hist = hist.withColumn("upto", F.sum("own").over(W.partitionBy("source").orderBy("bucket")))
        hist = hist.join(small_side(state.drop("prefix"), n_sources), F.col("source").eqNullSafe(F.col("s"))).withColumn("upto", F.col("upto") + F.col("below"))
        # the bucket in which the budget runs out, or the last one where it does not
        at = F.struct("bucket", (F.col("upto") - F.col("own")).alias("below"), F.col("upto"))
        pick = hist.groupBy("s", "passes", "rest").agg(F.coalesce(F.min(F.when(F.col("upto") > F.col("rest"), at)), F.max(at)).alias("b"))
        state = materialize(pick.select("s", "passes", "rest", F.col("b.bucket").alias("prefix"), F.col("b.below").alias("below"), F.col("b.upto").alias("upto")), "mix-level")
        last, state = state, state.drop("upto")
    take = (F.col("upto") <= F.col("rest")) | (F.col("upto") - F.col("rest") < F.col("rest") - F.col("below"))
    return last.select("s", "passes", F.when(take, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("threshold"))


def _plan(docs: DataFrame, weights, share) -> tuple[DataFrame, DataFrame, int]:
    """(sizes and hashes of the rows; per source its size, target, passes and threshold; number of sources)."""
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _hash(F.col("doc_id")).alias("u")), "mix-sizes")
    plan = materialize(source_targets(sized, weights, share), "mix-plan")
    n_sources = plan.count()
    cut = _thresholds(sized, plan, n_sources)
    plan = plan.withColumnRenamed("source", "p_source").join(cut, F.col("p_source").eqNullSafe(F.col("s"))).drop("s")
    return sized, plan, n_sources


def _copies(rows: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """``rows`` (source, u) with its source's plan and how often the mix takes the row. A large plan is joined by a shuffle, whose hot source AQE splits."""
    joined = rows.join(small_side(plan, n_sources), F.col("source").eqNullSafe(F.col("p_source")))
    return joined.withColumn("copies", F.least(F.col("passes") + (F.col("u") <= F.col("threshold")).cast("long"), F.lit(REPEAT)))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (0, 1 or 2 times the size), source, copies."""
    sized, plan, n_sources = _plan(docs, weights, share)
    return _copies(sized, plan, n_sources).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def apply(docs: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: a filter by thresholds, no shuffle of texts."""
    _, plan, n_sources = _plan(docs, weights, share)
    plan = plan.select("p_source", "passes", "threshold")
    # the row travels as one value, so that no column of its can clash with the plan's
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", _hash(F.col("doc_id")).alias("u"))
    rows = _copies(rows, plan, n_sources).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def mix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
c AS (SELECT *, [3, 1, 2][((rank - 1) % 3 + 1)::INT] AS w, 2 * source_size AS cap FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER o, 0)::DOUBLE) / ((sum(w) OVER ()) - coalesce(sum(w) OVER o, 0))::DOUBLE AS level
  FROM c WINDOW o AS (ORDER BY cap::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(max(CASE WHEN cap::DOUBLE / w >= level THEN level END) OVER (), 0) * w) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t),
g AS (
  SELECT source, u, sum(size)::BIGINT AS own, sum(sum(size)) OVER (PARTITION BY source ORDER BY u)::BIGINT AS upto FROM d GROUP BY source, u),
x AS (
  SELECT g.source, g.u, p.source_size, p.target, p.passes,
         (g.upto <= p.target - p.passes * p.source_size)
         OR (g.upto - g.own <= p.target - p.passes * p.source_size
             AND g.upto - (p.target - p.passes * p.source_size) < (p.target - p.passes * p.source_size) - (g.upto - g.own)) AS more
  FROM g JOIN p ON g.source IS NOT DISTINCT FROM p.source)
SELECT d.doc_id, d.size, x.source_size, x.target, least(x.passes + x.more::BIGINT, 2) * d.size AS taken
FROM d JOIN x ON d.u = x.u AND d.source IS NOT DISTINCT FROM x.source
"""
