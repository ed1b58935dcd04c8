import collections
import random
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from veilspark.llm import mixing, quality
from veilspark.llm.common import materialize

from .test_decontaminate import brute as leaks
from .test_simhash import brute as groups
from .test_tokens import reference

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(600)]
    items = [(i, " ".join(rng.choices(vocabulary, k=20))) for i in range(4)]
    docs = []
    for i in range(160):
        words = rng.choices(vocabulary, k=rng.randint(30, 140))
        if i % 11 == 0:
            words[5:5] = items[i % 4][1].split()
        if i % 7 == 0 and docs:
            words = docs[-1][1].split()
        docs.append((i, " ".join(words), ["en", "fr"][i % 2], ["a", "b", None][i % 3], 1))
    docs += [(500, None, None, None, 0), (501, "", "en", "a", 0), (502, "spam# " * 80, "en", "b", 9)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(d[0], 1, 0) for d in docs], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), docs, items


def test_stages_against_brute_force(spark, tables):
    path, docs, items = tables
    rows, frame = docs, spark.read.parquet(f"{path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frame = materialize(stage(spark, frame, path), f"test-{k}")
        got = [tuple(r) for r in frame.collect()]
        if k == 0:
            # too few labels for any cutoff: the base rule decides
            want = [d for d in rows if (f := quality.features((d[1] or "").encode()))[0] >= 50 and 100 * f[4] <= 50 * f[0]]
        elif k == 1:
            first = {r[2] for r in groups([d[:2] for d in rows])}
            want = [d for d in rows if d[0] in first]
        elif k == 2:
            bad = {d for d, _ in leaks([d[:2] for d in rows], items)}
            want = [d for d in rows if d[0] not in bad]
        elif k == 3:
            con = duckdb.connect()
            con.execute("create table documents(doc_id bigint, text varchar, source varchar)")
            con.executemany("insert into documents values (?, ?, ?)", [(d[0], d[1], d[3]) for d in rows])
            times = {r[0]: r[4] // r[1] for r in con.execute(mixing.ORACLE).fetchall()}
            want = [d for d in rows for _ in range(times[d[0]])]
        else:
            counts = collections.Counter()
            for r in got:
                counts[r[0], r[2], r[3]] += 1
            ids = {d[0]: np.array(reference(d[1]) + [2], "<u4") for d in rows}
            assert counts == collections.Counter((d[0], len(ids[d[0]]), zlib.crc32(ids[d[0]].tobytes())) for d in rows)
            continue
        assert sorted(got) == sorted(want) and frame.columns == list(corpus_pipeline.COLUMNS), name
        assert len(got) < len(rows) or k == 3
        rows = want


def test_run_and_empty(spark, tables, tmp_path):
    path, docs, _ = tables
    assert corpus_pipeline.run(spark, path).count() > 0
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{path}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
