"""Structured Streaming forms of the stateless stages, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect


def redact_stream(docs: DataFrame) -> DataFrame:
    """Redacted texts of a stream of documents (doc_id, text): no state, any output mode."""
    from ..plans.pipeline import redacted

    return redacted(docs)


def match_counts(docs: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Matches by class and window of event time; windows close after the watermark."""
    found = detect.exploded(detect.with_matches(docs), F.col("matches"), time).where("m.valid")
    return found.withWatermark(time, late).groupBy(F.window(time, window), F.col("m.class").alias("class")).agg(F.count(F.lit(1)).alias("n"))


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of events per window."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_requests(requests: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """Arbiter requests of which equal ones within the watermark are asked once."""
    return requests.withWatermark(time, late).dropDuplicatesWithinWatermark(["cache_key"])


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there, to Parquet, then stop."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def read_stream(spark: SparkSession, path: str, schema, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)
