import random
import threading
import time

import pytest

from veilspark.operators import arbiter
from veilspark.streaming import cache

KIND = "shard long, seq long, op string, cache_key string, raw string"


def simulate(ops, entries, caches):
    """A dictionary in order of insertion; the first key goes when a set finds it full."""
    out = []
    for shard, seq, op, key, raw in sorted(ops, key=lambda r: (r[0], r[1])):
        held, counts = caches.setdefault(shard, ({}, [0, 0, 0]))
        hit = evicted = got = None
        if op == "get":
            hit = key in held
            counts[0 if hit else 1] += 1
            got = held.get(key)
        else:
            got = raw
            if len(held) >= entries:
                evicted = next(iter(held))
                del held[evicted]
                counts[2] += 1
            held[key] = raw
        out.append((shard, seq, op, key, got, hit, evicted, len(held), *counts))
    return sorted(out)


def operations(n=400, seed=3, first=0):
    rng = random.Random(seed)
    return [(rng.randint(0, 2), first + k, rng.choice(["get", "set"]), f"k{rng.randint(0, 14)}", f"v{k}") for k in range(n)]


def test_a_table(spark):
    ops = operations()
    rng = random.Random(1)
    got = cache.served(spark.createDataFrame(rng.sample(ops, len(ops)), KIND), 5).collect()
    assert sorted(map(tuple, got)) == simulate(ops, 5, {})
    assert any(r.evicted and r.evicted == r.cache_key for r in got)  # a key that drives itself out
    last = {r.shard: r for r in cache.totals(spark.createDataFrame(got, cache.OUTPUT)).collect()}
    assert all(last[s].hits + last[s].misses == sum(o[0] == s and o[2] == "get" for o in ops) for s in last)


def test_the_cache_outlives_a_run(spark, tmp_path):
    caches, want = {}, []
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
    for run in range(2):
        ops = operations(150, seed=run, first=1000 * run)
        want += simulate(ops, 6, caches)
        spark.createDataFrame(ops, KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = cache.served(stream, 6).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_asking_through_the_cache(spark):
    def backend(rows):
        if rows[0]["cache_key"] == "bad":
            raise RuntimeError
        return [f"said {rows[0]['seq']}"]

    keys = ["a", "b", "a", "bad", "c", "a", "b", "bad"]
    df = spark.createDataFrame([(0, k, "ask", x) for k, x in enumerate(keys)], "shard long, seq long, op string, cache_key string")
    got = [(r.raw, r.hit, r.evicted) for r in sorted(cache.served(df, 2, backend).collect(), key=lambda r: r.seq)]
    assert got == [("said 0", False, None), ("said 1", False, None), ("said 0", True, None), (None, False, None), ("said 4", False, "a"), ("said 5", False, "b"), ("said 6", False, "c"), (None, False, None)]
    with pytest.raises(ValueError):
        cache.FifoCache(0)


# --- calls in flight ------------------------------------------------------------------------------
class Slow:
    """A backend that knows how many of its calls are open."""

    def __init__(self, fail=()):
        self.open = self.most = self.calls = 0
        self.fail, self.lock = set(fail), threading.Lock()

    def __call__(self, rows):
        with self.lock:
            self.open += 1
            self.calls += 1
            self.most = max(self.most, self.open)
        time.sleep(0.02)
        with self.lock:
            self.open -= 1
        if any(r["k"] in self.fail for r in rows):
            raise RuntimeError("refused")
        return [str(r["k"]) for r in rows]


def test_calls_stay_open_and_answers_in_order():
    backend = Slow()
    began = time.time()
    assert list(arbiter.in_flight(backend, concurrency=10)({"k": k} for k in range(200))) == [str(k) for k in range(200)]
    assert backend.most == 10 and backend.calls == 200 and time.time() - began < 2


def test_calls_cross_batches():
    """Rows come in batches of two, yet eight calls are open."""
    backend, drawn = Slow(), []

    def rows():
        for batch in range(20):
            drawn.append(backend.open)
            yield from ({"k": 2 * batch + i} for i in range(2))

    assert list(arbiter.in_flight(backend, concurrency=8)(rows())) == [str(k) for k in range(40)]
    assert backend.most == 8 and max(drawn) > 2


def test_a_failed_call_fails_alone():
    backend = Slow(fail=[7, 31])
    got = list(arbiter.in_flight(backend, concurrency=4, retries=1, per_call=5)({"k": k} for k in range(40)))
    assert got == [None if k in (7, 31) else str(k) for k in range(40)]
    # eight calls of five; two fail twice, their ten rows are asked alone and the two bad ones twice
    assert backend.calls == 8 + 2 + 10 + 2


def test_waits_double():
    times = []

    def backend(rows):
        times.append(time.time())
        raise RuntimeError

    assert list(arbiter.in_flight(backend, 1, retries=3, wait=0.05)([{"k": 1}])) == [None]
    gaps = [b - a for a, b in zip(times, times[1:])]
    assert len(gaps) == 3 and all(g >= w for g, w in zip(gaps, (0.05, 0.1, 0.2)))


def test_ask_over_many_small_batches(spark):
    def backend(rows):
        if rows[0]["target"] == "t3":
            raise RuntimeError
        return [r["target"] + "!" for r in rows]

    rows = [(k, f"t{k % 50}", "c", "O", "X") for k in range(500)]
    df = spark.createDataFrame(rows, "k int, target string, context string, prev_label string, pred string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = arbiter.ask(df, backend, concurrency=5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 500 and all(r.raw == (None if r.target == "t3" else r.target + "!") for r in got)
