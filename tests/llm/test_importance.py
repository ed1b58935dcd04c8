import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from veilspark.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, target, buckets=10_000, percent=5, min_words=20):
    def counted(texts):
        return collections.Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t)[1])

    s, t = counted(x for _, x in rows), counted(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (all_s + buckets) / ((s[k] + 1) * (all_t + buckets)))) for k in range(buckets)]
    out = []
    for doc_id, text in rows:
        words, found = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        h = int(hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    fit = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


def sample(n=400):
    rng = random.Random(3)
    words = ["the", "of", "é", "Straße", "ÄB", "x1", "42"] + [f"w{i}" for i in range(300)]
    rows = [(k, "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-", "_", "\x00"]) for _ in range(rng.randint(0, 90)))) for k in range(n)]
    rows += [(n + 1, None), (n + 2, ""), (n + 3, "--- !"), (n + 4, "one"), (n + 5, "one two"), (n + 6, "the of " * 30_000), (-7, rows[5][1]), (None, rows[6][1])]
    return rows, [t for _, t in rows[:9]] + ["Target TEXT words w1 w2 w3", None, ""]


def got(spark, rows, target, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "2 as rank", "3 as weight", "4 as p")
    out = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), **more).collect()
    return [tuple(r) for r in out]


@pytest.mark.parametrize("block", [1 << 24, 3000])
def test_against_plain_python(spark, block):
    rows, target = sample()
    assert sorted(map(str, got(spark, rows, target, block_bytes=block))) == sorted(map(str, brute(rows, target)))


def test_repeated_rows_have_ranks_of_their_own(spark):
    rows = [(1, "a b c " * 10)] * 50 + [(2, "a b d " * 10)] * 50
    out = got(spark, rows, ["a b c"], share=0.4)
    assert sorted(r[4] for r in out if r[4]) == list(range(1, 41))
    assert len({r[2:4] for r in out}) == 2


def test_empty(spark):
    assert got(spark, [], ["a b"]) == []
    assert [r[1:3] for r in got(spark, [(1, "a")], [])] == [(1, brute([(1, "a")], [])[0][2])]


def test_dictionary_hashes_each_string_once(spark, monkeypatch):
    import pyarrow as pa

    b = importance.Block(b"a b a b a\na b\n")
    assert b.words.to_pylist() == [b"a", b"b"] and [x.tolist() for x in b.counts] == [[4, 3], [3, 2], [2, 1]]
    asked = [pa.Table.from_batches(list(importance._asker(1)([pa.record_batch([pa.array([k]), pa.array([b"a b a b a\na b\n"])], ["block", "data"])]))) for k in (1, 2)]
    hashed = []
    monkeypatch.setattr(importance.zlib, "crc32", lambda x: hashed.append(x) or 7)
    told = importance._dictionary(10)(pa.concat_tables(asked)).to_pylist()
    assert sorted(hashed) == [b"a", b"a b", b"a b a", b"b", b"b a", b"b a b"]
    totals = importance.unplanes(importance._unpacked(told[-1]["totals"]), np.int64)
    assert totals.tolist() == [0] * 7 + [30, 0, 0] and [r["block"] for r in told] == [1, 2, -1]


def test_what_is_asked_is_never_on_disk_at_once(spark, monkeypatch):
    import pyarrow as pa

    batch = pa.record_batch([pa.array([1]), pa.array([b"a b c d e f g h\n" * 3 + b"h g f e d c b a\n"])], ["block", "data"])
    whole = {r.column("p")[0].as_py(): r.to_pylist() for r in importance._asker(12)(iter([batch]))}
    turns = [{r.column("p")[0].as_py(): r.to_pylist() for r in importance._asker(12, t, 3)(iter([batch]))} for t in range(3)]
    assert all(turns) and all(p % 3 == t for t in range(3) for p in turns[t]) and turns[0] | turns[1] | turns[2] == whole
    # each turn is a table of its own, and the weights are worked out once
    written, real = [], importance.materialize
    monkeypatch.setattr(importance, "materialize", lambda df, label: written.append(label) or real(df, label))
    rows, target = sample(60)
    got(spark, rows, target, block_bytes=3000)
    assert written == ["feature-buckets"] * 2 * importance.TURNS + ["scores", "draw-order", "draw"] and importance.TURNS > 1
