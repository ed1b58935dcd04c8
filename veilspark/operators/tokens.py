"""Words with offsets, sliding windows, alignment of spans to words, BIO repair."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.columns import entity, once
from ..functions.registry import STRIDE, WINDOW
from .intervals import first_from

_PIECE = re.compile(r"\w+|[^\w\s]")
#: Whether a code point is white space; the last entry stands for all above.
_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])
_TOKENS = T.ArrayType(T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("token", T.StringType()), T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))


def bounded_batches(spark: SparkSession, size: str = "4m") -> SparkSession:
    """``spark`` with Arrow batches of at most ``size``: a worker holds whole batches, and 10,000 long texts with all their words are much."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return spark


def parts(column: pa.Array, most: int = 1 << 20) -> list[list[str]]:
    """The texts of a batch (null: empty) in runs of about ``most`` bytes, so that what Python makes of them stays small whatever the batch."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    run = sizes // most
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(column)]
    return [[x or "" for x in column.slice(a, b - a).to_pylist()] for a, b in itertools.pairwise(edges)]


def _lists(tokens: list[str], starts, numbers, edges) -> pa.Array:
    s, words = pa.array(starts, pa.int32()), pa.array(tokens, pa.string())
    rows = pa.StructArray.from_arrays([pa.array(numbers, pa.int32()), words, s, pc.add(s, pc.utf8_length(words))], ["idx", "token", "s", "e"])
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), rows)


def _found(pattern: re.Pattern, texts: list[str], most: int | None = None) -> pa.Array:
    """All matches of a pattern with their offsets, built column by column."""
    tokens, starts, edges, numbers = [], [], [0], []
    for text in texts:
        found = list(itertools.islice(pattern.finditer(text), most))
        tokens += [m[0] for m in found]
        starts += [m.start() for m in found]
        numbers += range(len(found))
        edges.append(len(tokens))
    return _lists(tokens, starts, numbers, edges)


def _words(texts: list[str]) -> pa.Array:
    """Runs without white space with their offsets: all texts in one pass over their code points."""
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = ~_SPACE[np.minimum(points, len(_SPACE) - 1)]
    starts = np.flatnonzero(np.diff(inside) == 1)
    places = np.cumsum([0, *(len(t) + 1 for t in texts)])
    edges = np.searchsorted(starts, places)
    counts = np.diff(edges)
    return _lists(joined.split(), starts - np.repeat(places[:-1], counts), np.arange(len(starts)) - np.repeat(edges[:-1], counts), edges)


def _joined(lists: list[pa.Array]) -> pa.Array:
    return pa.concat_arrays(lists) if lists else _lists([], [], [], [0])


@F.arrow_udf(_TOKENS)
def word_tokens(text: pa.Array) -> pa.Array:
    """Runs without Unicode white space and their code-point offsets. Spark has no expression that yields the positions of
    all matches; over words a fold would copy its array per word, and a window would shuffle every word."""
    return _joined([_words(texts) for texts in parts(text)])


@F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("n_tokens", "longest", "chars", "last_end")]))
def word_extents(text: pa.Array) -> pa.Array:
    """Of word_tokens(): how many, the longest, all their characters, and where the last one ends; zeros without words. The words stay in the task."""
    columns = [[], [], [], []]
    for texts in parts(text):
        found = _words(texts)
        words, edges = found.values, found.offsets.to_numpy().astype(np.int64)
        s, e = (words.field(c).to_numpy().astype(np.int64) for c in ("s", "e"))
        n = np.diff(edges)
        some = n > 0
        longest, last, total = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.concatenate([[0], np.cumsum(e - s)])
        if some.any():
            longest[some] = np.maximum.reduceat(e - s, edges[:-1][some])
            last[some] = e[edges[1:][some] - 1]
        for column, values in zip(columns, (n, longest, total[edges[1:]] - total[edges[:-1]], last), strict=True):
            column.append(values)
    return pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in columns], ["n_tokens", "longest", "chars", "last_end"])


def pieces(text: Column, most: int = 512) -> Column:
    """The first ``most`` pieces of a text with offsets: a stand-in for a model's own tokenizer, runs of letters and digits or one other
    character. A model reads no more, so the limit is the feature."""

    @F.arrow_udf(_TOKENS)
    def cut(column: pa.Array) -> pa.Array:
        return _joined([_found(_PIECE, texts, most) for texts in parts(column)])

    return cut(text)


def word_count(text: Column) -> Column:
    """How many words word_tokens() finds, in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\s\x{1c}-\x{1f}\x{85}\p{Z}]+")).cast("long"), F.lit(0).cast("long"))


def joined_offsets(tokens: Column) -> Column:
    """array<struct<s, e>> of ``tokens`` joined by single spaces."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
    return F.aggregate(
        tokens,
        start,
        lambda acc, t: F.struct((acc["at"] + F.length(t) + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("s"), (acc["at"] + F.length(t)).alias("e")))).alias("out")),
        lambda acc: acc["out"],
    )


def windows(n: Column, size: int = WINDOW, stride: int = STRIDE) -> Column:
    """array<struct<start, first, stop>>: windows over n tokens; all but the last keep only their first ``stride`` tokens, and a
    window that starts before the end is made even if the one before reached it, so it writes the tail again."""
    starts = F.when(n > size, F.sequence(F.lit(0), n - 1, F.lit(stride))).otherwise(F.array(F.lit(0)))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), s.alias("first"), F.when(s + size >= n, n).otherwise(F.least(n, s + stride)).alias("stop")))


def align(tokens: Column, spans: Column, threshold: float = 0.5) -> Column:
    """array<string>: the BIO label of each word from character ``spans`` (s, e, class), ordered by (s, e).

    A word takes the span that covers most of it, if that is at least ``threshold`` of the word, the first at ties. Its label is
    B- unless the word before took the same span, and after that repaired by class."""

    def best(t: Column) -> Column:
        scored = F.transform(spans, lambda m, i: F.struct(((F.least(m["e"], t["e"]) - F.greatest(m["s"], t["s"])) / (t["e"] - t["s"])).alias("ratio"), (-i).alias("rank"), m["class"].alias("class")))
        return F.array_max(F.filter(scored, lambda x: (x["ratio"] >= threshold) & (x["ratio"] > 0)))

    def labels(taken: Column) -> Column:
        def label(x: Column, i: Column) -> Column:
            before = F.get(taken, i - 1)
            same = (i > 0) & before.isNotNull() & (before["rank"] == x["rank"])
            return F.when(x.isNull(), "O").otherwise(F.concat(F.when(F.coalesce(same, F.lit(False)), "I-").otherwise("B-"), x["class"]))

        return F.transform(taken, label)

    # a document without spans isn't walked through
    return F.when(F.size(spans) == 0, F.transform(tokens, lambda t: F.lit("O"))).otherwise(once(F.transform(tokens, best), labels))


def repair(label: Column, previous: Column) -> Column:
    """I- without a predecessor of its class becomes B-. Only prefixes change, so the original predecessor is enough."""
    orphan = label.startswith("I-") & (previous.isNull() | (previous == "O") | (entity(previous) != entity(label)))
    return F.when(orphan, F.concat(F.lit("B-"), entity(label))).otherwise(label)


def sequence(key: str = "sample_id", order: str = "idx"):
    return W.partitionBy(key).orderBy(order)


def repair_rows(df: DataFrame, label: str = "label", key: str = "sample_id", order: str = "idx") -> DataFrame:
    return df.withColumn(label, repair(F.col(label), F.lag(label).over(sequence(key, order))))


def inside_only_to_bio(df: DataFrame, label: str = "label", key: str = "sample_id", order: str = "idx") -> DataFrame:
    """Vocabularies with I- only: the first word of a run is B-."""
    before = F.lag(label).over(sequence(key, order))
    starts = F.col(label).startswith("I-") & (before.isNull() | (before != F.col(label)))
    return df.withColumn(label, F.when(starts, F.concat(F.lit("B-"), entity(F.col(label)))).otherwise(F.col(label)))


def overlap_labels(words: DataFrame, pieces: DataFrame, mode: str = "first_non_o", key: str = "sample_id") -> DataFrame:
    """words (key, idx, s, e) with the label of the first overlapping piece (key, idx, s, e, label), or of the first that isn't O; then repaired.
    Pieces are in text order, see first_from()."""
    if mode == "first_non_o":
        pieces = pieces.where("label <> 'O'")
    found = first_from(words.select(key, "idx", "s", "e"), pieces, key, "label")
    return repair_rows(found.select(key, "idx", "s", "e", F.coalesce("found", F.lit("O")).alias("label")), key=key)


def bio_spans(df: DataFrame, key: str = "sample_id", strict: bool = False) -> DataFrame:
    """(key, class, first_idx, last_idx): chunks of a word table (key, idx, label).

    strict: only B- starts a chunk and I- of another class, or without a start, is ignored; else I- after O or another class starts one, too."""
    w = sequence(key)
    before = F.lag("label").over(w)
    cls = entity(F.col("label"))
    fresh = before.isNull() | (before == "O") | (entity(before) != cls)
    start = F.col("label").startswith("B-") | (F.col("label").startswith("I-") & fresh)
    rows = df.withColumn("_start", start.cast("int")).withColumn("_chunk", F.sum("_start").over(w)).where("label <> 'O'")
    out = rows.groupBy(key, "_chunk").agg(F.min_by("label", "idx").alias("_first"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
    if strict:
        out = out.where("_first like 'B-%'")
    return out.select(key, entity(F.col("_first")).alias("class"), "first_idx", "last_idx")


def character_spans(pieces: DataFrame, text: str = "text", key: str = "sample_id") -> DataFrame:
    """(key, class, s, e, span): character spans of a model's pieces (key, idx, s, e, label, text), whatever their prefixes: B- starts one, I- of
    the same class goes on, any other I- starts one, too."""
    spans = bio_spans(pieces, key)
    first = pieces.select(key, F.col("idx").alias("first_idx"), "s", text)
    last = pieces.select(key, F.col("idx").alias("last_idx"), "e")
    out = spans.join(first, [key, "first_idx"]).join(last, [key, "last_idx"])
    return out.select(key, "class", "s", "e", F.substring(F.col(text), F.col("s") + 1, F.col("e") - F.col("s")).alias("span"))


def expanded_vocabulary(labels: DataFrame) -> DataFrame:
    """(new_id, label, raw_id) of a vocabulary (label_id, label) of O and I- labels: each I- label becomes a B- and an I- one, ids in order.
    One row per label of a model meets here."""
    both = F.when(F.col("label") == "O", F.array(F.lit("O"))).when(F.col("label").startswith("I-"), F.array(F.concat(F.lit("B-"), entity(F.col("label"))), F.col("label"))).otherwise(F.array().cast("array<string>"))
    rows = labels.select(F.col("label_id").alias("raw_id"), F.posexplode(both).alias("k", "label"))
    return rows.select((F.row_number().over(W.orderBy("raw_id", "k")) - 1).alias("new_id"), "label", "raw_id")
