import itertools
import random

import pytest

from veilspark.llm import decontaminate as d


def test_masks_tolerate_two_substitutions():
    for bad in itertools.combinations(range(d.STRETCH), 2):
        assert any(not {s + o for o in m} & set(bad) for m in d.MASKS for s in range(d.STRETCH - m[-1]))


def brute(docs, items):
    out = set()
    for doc_id, text in docs:
        w = (text or "").lower().split()
        for item_id, t in items:
            v = (t or "").lower().split()
            if len(v) < d.MIN_WORDS:
                continue
            need = min(d.STRETCH, len(v))
            for shift in range(-len(v), len(w)):
                eq = [v[j] == w[j + shift] if 0 <= j + shift < len(w) else None for j in range(len(v))]
                for s in range(len(v) - need + 1):
                    part = eq[s : s + need]
                    if None not in part and sum(part) >= d.SHARE * need:
                        out.add((doc_id, item_id))
    return out


@pytest.mark.parametrize("shuffled", [False, True])
def test_against_brute_force(spark, monkeypatch, shuffled):
    if shuffled:  # no side of a join is broadcast, seeds neither
        monkeypatch.setattr(d, "BROADCAST_SEEDS", 0)
        monkeypatch.setattr("veilspark.llm.common.BROADCAST_ROWS", 0)
        monkeypatch.setattr(d, "BROADCAST_ROWS", 0)
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        compare_with_brute_force(spark)
    finally:
        if shuffled:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def compare_with_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([3, 5, 7, 9, 13, 14, 20, 35, 60] * 3)] + [(90, None), (91, "")]
    docs = []
    for i in range(150):
        words = rng.choices(vocabulary, k=rng.randint(0, 120))
        if i % 2:
            v = rng.choice(items)[1] or ""
            v = v.split()
            if len(v) >= 13:
                lo = rng.randint(0, len(v) - 13)
                v = v[lo : lo + rng.randint(10, 60)]
                for _ in range(rng.choice([0, 1, 2])):
                    v[rng.randrange(len(v))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = [x.upper() if rng.random() < 0.2 else x for x in v]
        docs.append((i, rng.choice([" ", "\n ", "\t"]).join(words)))
    docs += [(None, items[8][1]), (800, None), (801, ""), (3, docs[3][1]), (802, "z " * 3000 + items[7][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as words", "2 as item_id")
    got = d.leaks(frame, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as uid")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    clean = {r.doc_id for r in d.remove_leaking(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert clean == {x for x, _ in docs} - {r.doc_id for r in got}


def test_empty(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "doc_id long, text string")
    items = one.withColumnRenamed("doc_id", "item_id")
    assert d.leaks(none, items).count() == 0
    assert d.leaks(one, items.where("false")).count() == 0
    assert d.leaks(one, items).count() == 1


def test_whole_masks_leave_one_unharmed():
    for n in range(d.MIN_WORDS, d.STRETCH):
        for bad in itertools.combinations(range(n), int(n - d.SHARE * n + 1e-9)):
            assert any(not set(m) & set(bad) for m in d.whole_masks(n)), (n, bad)


def test_short_items_with_substitutions(spark):
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(5, 14)]
    docs, want = [], set()
    for n, text in items:
        allowed = 1 if n < 10 else 2
        for count in range(allowed + 2):
            for bad in itertools.combinations(range(n), count):
                words = ["x" if k in bad else w for k, w in enumerate(text.split())]
                docs.append((len(docs), " ".join(["before", *words, "after"])))
                if count <= allowed:
                    want.add((docs[-1][0], n))
    got = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.start == 1 and r.best_stretch == r.n_equal for r in got)
