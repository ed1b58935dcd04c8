"""A bounded first-in first-out cache of answers as keyed state: it lasts as long as the query's checkpoint.

Operations (shard, seq, op, cache_key, ...) are served per shard in order of seq. ``get`` looks a key up and counts a hit or a miss; ``set`` stores
``raw``; ``ask`` is a get and, after a miss, a call of the backend and a set of what it said. A set to a full cache first drops the
entry that came first, even if its own key is there already; a key that is set again keeps its place. One shard is one
cache, as a single process has it; more shards are as many caches with ``entries`` each, served by different tasks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

OUTPUT = "shard long, seq long, op string, cache_key string, raw string, hit boolean, evicted string, size long, hits long, misses long, evictions long"


class FifoCache(StatefulProcessor):
    """Two maps of state: the entry of a key with its place in the queue, and the key at a place; and one row of counters."""

    def __init__(self, entries: int, backend: Callable[[list[dict]], list[str]] | None = None):
        if entries < 1:
            raise ValueError("a cache holds one entry or more")
        self.entries, self.backend = entries, backend

    def init(self, handle) -> None:
        self.known = handle.getMapState("known", "cache_key string", "raw string, place long")
        self.queue = handle.getMapState("queue", "place long", "cache_key string")
        self.counters = handle.getValueState("counters", "head long, tail long, hits long, misses long, evictions long")

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        self.head, self.tail, self.hits, self.misses, self.evictions = self.counters.get() if self.counters.exists() else (0, 0, 0, 0, 0)
        out = [self._serve(row) for row in frame.to_dict("records")]
        self.counters.update((self.head, self.tail, self.hits, self.misses, self.evictions))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUTPUT.split(", ")])

    def _serve(self, row: dict) -> tuple:
        name, raw, hit, evicted = row["cache_key"], None, None, None
        if row["op"] != "set":
            hit = self.known.containsKey((name,))
            self.hits, self.misses = self.hits + hit, self.misses + (not hit)
            raw = self.known.getValue((name,))[0] if hit else None
        if row["op"] == "set":
            raw = row["raw"]
            evicted = self._set(name, raw)
        elif row["op"] == "ask" and not hit and self.backend:
            try:
                raw = self.backend([row])[0]
                evicted = self._set(name, raw)
            except Exception:  # noqa: BLE001 - a call that failed leaves nothing in the cache
                raw = None
        return row["shard"], row["seq"], row["op"], name, raw, hit, evicted, self.tail - self.head, self.hits, self.misses, self.evictions

    def _set(self, name: str, raw: str) -> str | None:
        evicted = None
        if self.tail - self.head >= self.entries:
            evicted = self.queue.getValue((self.head,))[0]
            self.queue.removeKey((self.head,))
            self.known.removeKey((evicted,))
            self.head, self.evictions = self.head + 1, self.evictions + 1
        if self.known.containsKey((name,)):
            self.known.updateValue((name,), (raw, self.known.getValue((name,))[1]))
        else:
            self.known.updateValue((name,), (raw, self.tail))
            self.queue.updateValue((self.tail,), (name,))
            self.tail += 1
        return evicted

    def close(self) -> None:
        pass


def served(operations: DataFrame, entries: int, backend: Callable[[list[dict]], list[str]] | None = None) -> DataFrame:
    """One row per operation, a table's or a stream's: what it got, whether that was cached, which key it drove out, the size of its shard's
    cache then and the shard's counts so far. A stream carries the cache from batch to batch and, by its checkpoint, from run to run; over a
    table it starts empty. State needs RocksDB: spark.sql.streaming.stateStore.providerClass is set for the session."""
    spark = operations.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    _ = spark.streams  # state is found through the manager of streams, which a table's query would not start
    rows = operations.withColumn("shard", F.col("shard").cast("long")).withColumn("seq", F.col("seq").cast("long"))
    if "raw" not in rows.columns:
        rows = rows.withColumn("raw", F.lit(None).cast("string"))
    return rows.groupBy("shard").transformWithStateInPandas(FifoCache(entries, backend), OUTPUT, "Append", "None")


def totals(rows: DataFrame) -> DataFrame:
    """(shard, hits, misses, evictions, size, hit_rate) after the last operation of each shard of a table of served() rows."""
    last = rows.groupBy("shard").agg(F.max_by(F.struct("hits", "misses", "evictions", "size"), "seq").alias("x")).select("shard", "x.*")
    asked = F.col("hits") + F.col("misses")
    return last.withColumn("hit_rate", F.when(asked > 0, F.col("hits") / asked).otherwise(0.0))
