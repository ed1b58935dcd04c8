import random

import pytest
import xxhash
from pyspark.sql import functions as F

from veilspark.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows))


def sample():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(80)]
    rows, key = [], 0
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randint(0, 400))
        for _ in range(rng.randint(1, 12)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((key, " ".join(words)))
            key += 1
    rows += [(key, None), (key + 1, ""), (key + 2, " \t\n "), (key + 3, "Öne"), (key + 4, "A b"), (None, "a B"), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize("hot, tile", [(64, 2048), (2, 2)])
def test_against_all_pairs(spark, monkeypatch, hot, tile):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "TILE", tile)
    rows = sample()
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == brute(rows)


def test_long_text_is_cut_at_white_space(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert simhash.fingerprint(text.encode()) == whole == brute_print(text)


def test_empty_table_and_keep_one(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted(kept) == sorted({r[2] for r in brute(rows) if r[2] is not None})


def test_keep_one_loses_no_component(spark):
    words = [" ".join(f"{p}{i}" for i in range(60)) for p in "abcdefg"]
    rows = [(1, words[0], "x"), (1, words[1], "x"), (None, words[2], "x"), (None, words[3], "x"), (None, words[4], "y"), (4, words[4], "y"), (5, words[5], "z"), (5, words[5], "a"), (5, words[5], None), (6, words[6], "q"), (7, words[6], "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row_key string")
    got = sorted(map(str, (tuple(r) for r in simhash.keep_one(docs).collect())))
    want = [rows[0], rows[1], rows[2], rows[3], rows[5], rows[8], rows[9]]
    assert got == sorted(map(str, want))
