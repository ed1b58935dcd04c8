import hashlib
import random

import pytest

from veilspark.llm import recompress


def brute(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0]))
    seen, out = {}, []
    for k in order:
        doc_id, text = rows[k]
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            w = tuple(words[i : i + 20])
            if seen.setdefault(w, (doc_id, i)) != (doc_id, i):
                gone[i : i + 20] = [True] * 20
        kept = b" ".join(x for x, g in zip(words, gone) if not g)
        out.append((str(doc_id), len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def sample(seed):
    rng = random.Random(seed)
    small, large = [f"a{i}" for i in range(3)], [f"é{i}x" for i in range(500)]
    passages = [rng.choices(rng.choice([small, large]), k=rng.randint(15, 70)) for _ in range(12)]
    rows = []
    for i in range(90):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else rng.choices(rng.choice([small, large]), k=rng.randint(0, 40))
            if rng.random() < 0.1:
                words += ["run"] * rng.randint(1, 60)
        if words and rng.random() < 0.3:
            words[rng.randrange(len(words))] = "edit"
        rows.append((i * 7 % 90, rng.choice([" ", "\n", " \t "]).join(words)))
    # a copy of a whole text with a smaller and a larger doc_id, odd rows
    longest = max(rows, key=lambda r: len(r[1]))[1]
    return rows + [(1000, longest), (-5, longest), (1001, None), (1002, ""), (1003, "one"), (-5, longest), (None, longest)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, seed):
    rows = sample(seed)
    got = recompress.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as g"), with_text=True).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_empty(spark):
    assert recompress.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_nothing_shared(spark):
    got = {r.doc_id: r.n_removed for r in recompress.remove_repeats(spark.createDataFrame([(1, "a b c"), (2, "q " * 9 + "x y z " * 9), (3, "x")], "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 24, 3: 0}


def thue_morse(one, other, n):
    word = [one]
    while len(word) < n:
        word += [other if x == one else one for x in word]
    return "".join(word)


def test_words_that_collide_in_polynomials(spark):
    """Two words whose polynomial hashes are equal modulo a power of two, whatever the base: no window is shared."""
    a, b = thue_morse("a", "b", 1024), thue_morse("b", "a", 1024)
    rest = [f"w{k}" for k in range(19)]
    rows = [(1, " ".join([a, *rest])), (2, " ".join([b, *rest])), (3, " ".join([*rest[:9], b, *rest[9:]])), (4, " ".join([*rest[:9], a, *rest[9:]]))]
    got = recompress.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows)
    assert all(r.n_removed == 0 for r in got)
