"""Span producers: models that are given a text and the labels of a dataset and return character spans. A producer is a plug-in, called
per text through a table function and a lateral join, so that Spark sees its spans as rows beside the document's columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import align_rows
from .tokens import word_tokens

#: (text, labels) -> (start, end, label, score), in code points.
Producer = Callable[[str, list[str]], Iterable[tuple[int, int, str, float]]]


def produced(docs: DataFrame, labels: list[str], producer: Producer, key: str = "sample_id", least: float = 0.0) -> DataFrame:
    """(key, s, e, class, score): spans that ``producer`` finds in ``docs`` (key, text) for ``labels``, with a score of ``least`` or more. Labels it was
    not asked for and spans that are empty or outside the text are left out; null text has none. A producer that fails ends the job."""

    @F.udtf(returnType="s int, e int, class string, score double")
    class Spans:
        def __init__(self):
            self.asked = set(labels)

        def eval(self, text: str):
            for s, e, label, score in producer(text, labels) if text else ():
                if label in self.asked and 0 <= s < e <= len(text) and score >= least:
                    yield int(s), int(e), label, float(score)

    return docs.select(key, "text").lateralJoin(Spans(F.col("text").outer())).select(key, "s", "e", "class", "score")


def without_overlaps(spans: DataFrame, key: str = "sample_id", most: int = 1000) -> DataFrame:
    """Spans of which no two overlap: of each chain of overlapping spans the best by (score, length), then those left of and right of it, and so on.

    A chain is found by a running maximum of the ends; chains are short where producers mark words, and one of over ``most`` spans is an error
    rather than a task without end."""
    from pyspark.sql.window import Window as W

    before = W.partitionBy(key).orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1)
    along = W.partitionBy(key).orderBy("s", "e").rowsBetween(W.unboundedPreceding, 0)
    fresh = F.coalesce(F.max("e").over(before) <= F.col("s"), F.lit(True)).cast("int")
    chained = spans.withColumn("_fresh", fresh).withColumn("_chain", F.sum("_fresh").over(along))
    packed = chained.groupBy(key, "_chain").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), (F.col("s") - F.col("e")).alias("n"), "s", "e", "class", "score"))).alias("x"))
    packed = packed.withColumn("x", F.when(F.size("x") <= most, F.col("x")).otherwise(F.raise_error(F.lit("too many spans overlap"))))
    none = F.slice("x", 1, 0)
    kept = F.aggregate("x", none, lambda acc, m: F.when(F.exists(acc, lambda o: (o["s"] < m["e"]) & (o["e"] > m["s"])), acc).otherwise(F.concat(acc, F.array(m))))
    return packed.select(key, F.explode(kept).alias("m")).select(key, "m.s", "m.e", "m.class", "m.score")


def word_labels(docs: DataFrame, labels: list[str], producer: Producer, key: str = "sample_id", least: float = 0.0) -> DataFrame:
    """(key, idx, token, s, e, label): BIO labels of the words of ``docs`` by a producer's spans."""
    words = docs.select(key, F.explode(word_tokens(F.col("text"))).alias("w")).select(key, "w.*")
    spans = without_overlaps(produced(docs, labels, producer, key, least), key)
    labelled = align_rows(words, spans, key).select(key, "idx", "label")
    return words.join(labelled, [key, "idx"]).select(key, "idx", "token", "s", "e", "label")


def pattern_producer(patterns: dict[str, str]) -> Producer:
    """A stand-in for a model: a pattern for each label it can be asked for; the score is the share of the match in 20 characters, 1 at most."""
    compiled = {label: re.compile(p) for label, p in patterns.items()}

    def produce(text: str, labels: list[str]):
        for label in labels:
            if label in compiled:
                yield from ((m.start(), m.end(), label, min(1.0, (m.end() - m.start()) / 20)) for m in compiled[label].finditer(text))

    return produce
