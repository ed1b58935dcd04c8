import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from veilspark.llm import suffixes


def brute(rows):
    seen = {}
    texts = [(t or "").encode() for _, t in rows]
    for k, t in enumerate(texts):
        for i in range(len(t) - 399):
            seen.setdefault(t[i : i + 400], []).append((k, i))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + 400] = True
    out = []
    for (doc_id, _), t, g in zip(rows, texts, gone):
        kept = bytes(np.frombuffer(t, np.uint8)[~g])
        out.append((str(doc_id), len(t), int(g.sum()), int((np.diff(np.r_[0, g.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def sample(seed):
    rng = random.Random(seed)

    def prose(n, letters="ab cé"):
        return "".join(rng.choices(letters, k=n))

    passages = [prose(rng.choice([390, 399, 400, 401, 420, 700, 1500])) for _ in range(8)] + ["x" * 900, "abc" * 300]
    rows = []
    for i in range(60):
        text = ""
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            if rng.random() < 0.3:
                at = rng.randrange(len(p))
                p = p[:at] + "Z" + p[at + 1 :]
            text += p[rng.randint(0, 20) :] if rng.random() < 0.6 else prose(rng.randint(0, 500))
            text += rng.choice(["", "a", "b", prose(30)])
        rows.append((i, text))
    longest = max((t for _, t in rows), key=len)
    return rows + [(100, longest), (101, None), (102, ""), (103, "short"), (100, longest), (None, longest + "tail"), (104, "short")]


@pytest.mark.parametrize("seed, hot, block", [(1, 20_000, 1 << 20), (2, 2, 700)])
def test_against_all_windows(spark, monkeypatch, seed, hot, block):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "BLOCK", block)
    rows = sample(seed)
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as g"), with_bytes=True).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_suffix_sort(monkeypatch):
    rng = np.random.default_rng(4)
    rows = rng.integers(97, 99, (300, 24)).astype(np.uint8)
    lengths = rng.integers(0, 25, 300)
    group = np.sort(rng.integers(0, 9, 300))
    strings = [bytes(r[:n]) for r, n in zip(rows, lengths)]
    rows[np.arange(24) >= lengths[:, None]] = 0
    want = sorted(range(300), key=lambda k: (group[k], strings[k], k))
    order, common = suffixes.Suffixes(rows, lengths, group).sorted()
    assert order.tolist() == want
    for a, b, n in zip(want, want[1:], common[1:]):
        x, y = strings[a], strings[b]
        assert n == (-1 if group[a] != group[b] else next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y))))
    # hashes that lie are found out
    s = suffixes.Suffixes(rows, lengths, group)
    s.hashes[:] = 7
    order, _ = s.sorted()
    assert [strings[k] for k in order] == [strings[k] for k in want]


def test_empty(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_nothing_shared(spark):
    got = {r.doc_id: r.n_removed for r in suffixes.remove_repeats(spark.createDataFrame([(1, "a" * 500), (2, "bc" * 300), (3, "x")], "doc_id long, text string")).collect()}
    assert got == {1: 500, 2: 600, 3: 0}


def test_windows_around_two_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 20)
    rng = random.Random(8)

    def noise(n):
        return "".join(rng.choices("abcdefgh ", k=n))

    # every text has the passage, no text has a window of 400 bytes in common with another
    passage = noise(390)
    rows = [(i, noise(rng.randint(200, 500)) + passage + noise(rng.randint(200, 500))) for i in range(40)]
    want = brute(rows)
    assert all(n_removed == 0 for _, _, n_removed, _, _ in want)
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_contexts_that_collide_in_polynomials(spark):
    """Two texts of 700 bytes with one polynomial hash and no 400 bytes in common."""
    from veilspark.llm.textgroups import BYTE_POWERS, BYTE_VALUES, Prefix

    def zeros(x, y):
        d = int(BYTE_VALUES[x]) ^ int(BYTE_VALUES[y])
        return (d & -d).bit_length()

    one, other = max(((x, y) for x in range(33, 127) for y in range(x)), key=lambda p: zeros(*p))
    word = [one]
    while len(word) < 512:
        word += [other if x == one else one for x in word]
    turned = [other if x == one else one for x in word]
    rng = random.Random(3)
    before, after = ("".join(rng.choices("abcdefgh", k=94)) for _ in range(2))
    rows = [(k, before + bytes(w).decode() + after) for k, w in enumerate((word, turned))]
    first, second = (Prefix(BYTE_VALUES[np.frombuffer(t.encode(), np.uint8)], BYTE_POWERS).of(0, 700) for _, t in rows)
    assert first == second and all(r[2] == 0 for r in brute(rows))
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)


def test_contexts_are_dealt_over_all_buckets():
    rng = random.Random(6)
    common = rng.randbytes(30_000)
    texts = [rng.randbytes(30_000) + common, common + rng.randbytes(30_000)]
    of_key, sizes = {}, np.zeros(16)
    for g, t in enumerate(texts):
        a = suffixes.Anchors([t], suffixes.BLOCK)
        said = pa.table({"key": a.key.view(np.int64), "context": a.context.view(np.int64), "state": np.full(len(a.key), suffixes.SEND)})
        for row in suffixes._send_contexts(16, suffixes.BLOCK)(g, [b""], [0], [t], said).to_pylist():
            keys = np.frombuffer(row["keys"], np.uint64).tolist()
            sizes[row["b"]] += len(keys)
            for k in keys:
                of_key.setdefault(k, set()).add((g, row["b"]))
    met = [x for x in of_key.values() if len({g for g, _ in x}) == 2]
    assert len(met) > 50 and all(len({b for _, b in x}) == 1 for x in of_key.values())
    assert sizes.max() < sizes.sum() / 5


def brute_earlier(rows):
    """Bytes covered by windows that also start in a row before it, or further to the left; equal rows count as one."""
    order = sorted({((1 << 63) - 1 if d is None else d, hashlib.md5((t or "").encode()).digest(), (t or "").encode()) for d, t in rows})
    # only the first row of a text can have windows that are new
    seen, out = set(), {}
    for doc_id, _, t in order:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if t[i : i + 400] in seen:
                gone[i : i + 400] = True
            seen.add(t[i : i + 400])
        out[doc_id, t] = int(gone.sum())
    return sorted((str(d), len((t or "").encode()), out[(1 << 63) - 1 if d is None else d, (t or "").encode()]) for d, t in rows)


@pytest.mark.parametrize("seed, hot, block", [(1, 20_000, 1 << 20), (2, 2, 700), (3, 6, 1 << 20), (4, 30, 1 << 20)])
def test_bytes_that_repeat_earlier_ones(spark, monkeypatch, seed, hot, block):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "BLOCK", block)
    rows = sample(seed)
    # copies before and after, rows without doc_id and two texts of one doc_id
    rows += [(-5, rows[7][1]), (900, rows[7][1]), (None, rows[9][1]), (None, rows[9][1] + "end"), (200, rows[11][1] + "one"), (200, rows[11][1] + "two")]
    random.Random(seed).shuffle(rows)
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_repeat_bytes) for r in got) == brute_earlier(rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)


def test_first_holder_is_told_from_planted_passage(spark):
    rng = random.Random(5)
    prose = ["".join(rng.choices("abcdefgh ", k=900)) for _ in range(3)]
    rows = [(1, prose[0]), (2, prose[1] + prose[0][100:700] + prose[2])]
    got = {r.doc_id: r for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[2].n_removed) == (600, 600)
    assert (got[1].n_repeat_bytes, got[2].n_repeat_bytes) == (0, 600)
