import hashlib
import random
import zlib

import numpy as np
import pytest

from veilspark.llm import runs


def brute(words, least=12):
    """All runs by trying every period and every maximal stretch of equal words at that distance."""
    n, best = len(words), {}
    for p in range(1, n // 2 + 1):
        x = 0
        while x + p < n:
            y = x
            while y + p < n and words[y] == words[y + p]:
                y += 1
            if y > x and y + p - x >= max(least, 2 * p):
                best.setdefault((x, y + p), p)
            x = y + 1
    return sorted((s, e - s, p) for (s, e), p in best.items())


def texts(seed):
    rng = random.Random(seed)
    out = ["", " \n ", "one", "a " * 11, "a " * 12, "a b " * 6, "x " + "a b c " * 4 + "y", "a a b " * 40, "ab" * 50]
    for _ in range(60):
        alphabet = rng.choice([["a", "b"], ["a"], [f"é{i}" for i in range(30)]])
        words = []
        for _ in range(rng.randint(1, 5)):
            unit = rng.choices(alphabet, k=rng.randint(1, 9))
            words += unit * rng.randint(1, 6) + rng.choices(alphabet, k=rng.randint(0, 20))
        out.append(rng.choice([" ", "\t", "\n", "\x0b "]).join(words))
    fib = ["a", "a b"]
    while len(fib[-1]) < 700:
        fib.append(f"{fib[-1]} {fib[-2]}")
    thue = "a"
    while len(thue) < 256:
        thue += "".join("b" if c == "a" else "a" for c in thue)
    return [*out, fib[-1], " ".join(thue), " ".join(rng.choices([f"w{i}" for i in range(9000)], k=3000)) + " loop it" * 900]


@pytest.mark.parametrize("seed", [1, 2])
def test_all_runs(seed):
    words = [t.encode().split() for t in texts(seed)]
    got = [[tuple(r) for r in x.tolist()] for x in runs.document_runs(words)]
    assert got == [brute(w) for w in words]
    assert sum(map(len, got)) > 50


def test_other_least_lengths():
    rng = random.Random(4)
    for least in (2, 3, 7, 20):
        words = [rng.choices([b"a", b"b", b"c"], k=rng.randint(0, 60)) for _ in range(80)]
        assert [[tuple(r) for r in x.tolist()] for x in runs.document_runs(words, least)] == [brute(w, least) for w in words]


def test_mask_keeps_every_run():
    rng = random.Random(8)
    words = rng.choices(range(50), k=300) + [1, 2, 3] * 5 + rng.choices(range(50), k=200)
    mask = runs.repeated_mask(np.array(words), np.zeros(len(words), np.int64), 6)
    assert all(mask[s : s + n].all() for s, n, _ in brute(words)) and mask.sum() < 60


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    collapsed = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *row, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())


@pytest.mark.parametrize("batch", [1 << 19, 50])
def test_query_against_plain_python(spark, batch):
    rows = [(k, t) for k, t in enumerate(texts(7) + texts(8))] + [(900, None), (None, "q " * 30), (None, None), (3, "r " * 30), (3, "r " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as runs", "2 as start", "3 as collapsed")
    got = runs.digests(runs.find_runs(runs.with_loops(docs), batch_words=batch)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(expected(*r)) for r in rows)
    assert any(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows[:120])


def test_empty(spark):
    assert runs.digests(runs.find_runs(runs.with_loops(spark.createDataFrame([], "doc_id long, text string")))).count() == 0
