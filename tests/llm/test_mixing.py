import collections
import random

import duckdb
import pytest

from veilspark.llm import mixing


def compare(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' as size", "1 as u")
    got = sorted(map(str, mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()))
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, source varchar)")
    if rows:
        con.executemany("insert into documents values (?, ?, ?)", rows)
    want = con.execute(mixing.ORACLE).fetchall()
    return got, sorted(f"Row(doc_id={a}, size={b}, source_size={c}, target={d}, taken={e})" for a, b, c, d, e in want)


def test_edges_and_oracle(spark):
    rows = [(i, "w " * (i % 13), ["b", "a", None, "é", "a"][i % 5]) for i in range(300)] + [(None, None, None), (None, "x y", "a"), (5, "q", "a"), (5, "q", "a"), (900, "w " * 5000, "huge"), (901, None, "empty")]
    got, want = compare(spark, rows)
    assert got == want


def reshared(sizes):
    """Targets by sharing out again and again what is above twice a source's size."""
    names = sorted(sizes)
    weight = {n: (3, 1, 2)[k % 3] for k, n in enumerate(names)}
    rest, target, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while rest > 1e-9 and open_:
        share = rest / sum(weight[n] for n in open_)
        rest = 0.0
        for n in sorted(open_):
            target[n] += share * weight[n]
            if target[n] >= 2 * sizes[n]:
                rest += target[n] - 2 * sizes[n]
                target[n] = 2.0 * sizes[n]
                open_.discard(n)
    return target


def test_targets_and_taken(spark):
    rng = random.Random(5)
    for case in range(4):
        sizes = {f"s{k:02d}": int(rng.choice([1, 10, 50, 400]) * rng.random() * 9) for k in range([3, 7, 20, 2][case])}
        sized = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
        assert got == pytest.approx(reshared(sizes), abs=1e-6), sizes
    rows = [(i, "w " * rng.randint(1, 9), f"s{i % 5}" if i % 3 else "hot") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    target = reshared({s: sum(len(t.split()) for _, t, x in rows if x == s) for s in {r[2] for r in rows}})
    for s, t in target.items():
        assert abs(sum(r.taken for r in out if r.source == s) - t) <= 9
    assert all(r.taken in (0, r.size, 2 * r.size) for r in out)
    copies = collections.Counter(r.doc_id for r in mixing.apply(docs).collect())
    assert copies == {r.doc_id: r.copies for r in out if r.copies}


def test_empty(spark):
    assert compare(spark, []) == ([], [])


def test_apply_with_clashing_columns(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 3}", i) for i in range(90)]
    names = ("passes", "threshold", "p_source", "u", "copies", "size", "s", "row", "col")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").selectExpr("*", *[f"n as {n}" for n in names])
    want = {r.doc_id: r.copies for r in mixing.mix(docs.select("doc_id", "text", "source")).collect() if r.copies}
    out = mixing.apply(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert collections.Counter(r.doc_id for r in got) == want and all(r[n] == r.doc_id for r in got for n in names)
