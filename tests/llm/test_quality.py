import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            marked |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def sample(n, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        junk = rng.random() < 0.3
        words = [rng.choice(["ab", "éa", "c,", "dd", "x y", " q", "ffff"]) + str(rng.randint(0, 60)) + ("#%" if junk else "") for _ in range(rng.randint(40, 160))]
        text = "".join(w + rng.choice([" ", "\n", "\t", "  ", "\r\n"]) for w in words)
        out.append((i, text, ["en", "de"][i % 2], 0 if junk else 1))
    return out


def test_counts():
    cases = [None, "", " \n\t", "a", "a b c", "a b c a b c", "x\nx\n x\n\nx\r\nx", "a a a a a", "é" * 9, "#*$%&|<>"] + [r[1] for r in sample(40)]
    for text in cases:
        assert quality.features((text or "").encode())[:5] == brute(text), text


@pytest.mark.parametrize("k, n, alpha", [(0, 10, 0.3), (3, 200, 0.05), (12, 5000, 0.004)])
def test_bound(k, n, alpha):
    from math import comb

    exact = sum(comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(k + 1))
    assert quality.binomial_cdf(k, n, alpha) == pytest.approx(exact, rel=1e-9)


def test_judge_against_brute_force(spark, monkeypatch):
    rows = sample(900) + [(9001, None, None, None), (9002, "", "xx", None), (3, sample(4)[3][1], "de", 1)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").selectExpr("*", "'n' as n_words", "1 as kept")
    labels = spark.createDataFrame([(r[0], r[3], 0) for r in rows if r[3] is not None] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    alpha = 0.3
    monkeypatch.setattr(quality, "ALPHA", alpha)
    cuts = {}
    from veilspark.llm.common import materialize

    featured = quality.with_features(docs)
    labelled = featured.select("doc_id", "lang", *quality._FIELDS).join(labels.where("quality is not null").select("doc_id", "quality").dropDuplicates(), "doc_id")
    for r in quality.choose_cutoffs(labelled, alpha).collect():
        cuts[r.stratum, r.rule] = r.cutoff
    # brute force of the choice for one rule
    from math import comb

    for lang in ("en", "de"):
        known = [(1000 * brute(t)[2] // brute(t)[0], q) for i, t, g, q in rows if g == lang and q is not None]
        good, bad = [s for s, q in known if q == 1], [s for s, q in known if q == 0]
        best = (0, None)
        for cut in quality.GRID:
            lost = sum(s > cut for s in good)
            p = alpha / 6
            if not (lost < len(good) * p and sum(comb(len(good), i) * p**i * (1 - p) ** (len(good) - i) for i in range(lost + 1)) <= 0.05 / (6 * 2)):
                break
            gain = sum(s > cut for s in bad) - quality.COST * lost
            if gain > best[0]:
                best = (gain, cut)
        assert cuts.get((lang, "symbols")) == best[1] is not None
    got = {(r.doc_id, r.kept, r.base_failed) for r in quality.judge(docs, labels, True).collect()}
    del materialize
    assert (9001, False, True) in got and (9002, False, True) in got
    assert quality.judge(docs, labels, True).count() == len(rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "w%d " * 3 + " ".join(f"w{i}" for i in range(60)), "en")], "doc_id long, text string, lang string")
    assert [r.kept for r in quality.judge(one, labels, False).collect()] == [True]


def test_clashing_columns_and_null_language(spark):
    names = ("_s", "_cut_symbols", "_f", "_more", "stratum", "rule", "quality", "_l", "n_words", "kept", "a`b")
    rows = [(k, "good words here " * 30 if k % 2 else "#### " * 60, [None, ""][k // 2 % 2], k * 10) for k in range(8)] + [(3, None, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n long").selectExpr("*", *[f"n as `{n.replace('`', '``')}`" for n in names])
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, quality int")
    out = quality.judge(docs, labels)
    got = out.collect()
    assert len(got) == len(rows) and sorted(r["_s"] for r in got) == sorted(r[3] for r in rows)
    assert all(r[n] == r.n for r in got for n in names if n not in ("n_words", "kept"))
    assert all(isinstance(r.kept, bool) and r.n_words == len((r.text or "").split()) for r in got)


def test_null_language_is_a_stratum_of_its_own(spark):
    rows = [(None, 1, 0)] * 800 + [(None, 0, 100)] * 100 + [("", 1, 100)] * 800
    labelled = spark.createDataFrame(rows, "lang string, quality int, n_symbols long").select("lang", "quality", *[F.col(f) if f == "n_symbols" else F.lit(100).cast("long").alias(f) for f in quality._FIELDS])
    got = {(r.stratum, r.rule) for r in quality.choose_cutoffs(labelled).collect()}
    assert (None, "symbols") in got and ("", "symbols") not in got
