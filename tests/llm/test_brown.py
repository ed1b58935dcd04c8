import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from veilspark.llm import brown


def sample(n=120, seed=5):
    rng = random.Random(seed)
    nouns, verbs = [f"n{'abcdefghij'[i]}" for i in range(10)], [f"v{'abcdefghij'[i]}" for i in range(10)]
    rows = []
    for i in range(n):
        text = " ".join(f"{rng.choice(nouns)} {rng.choice(verbs)}" + rng.choice(["", ".", ","]) for _ in range(rng.randint(0, 60)))
        rows.append((i, text + " " + rng.choice(["Étoile", "x1", "#", "Rare%d" % i, ""])))
    return rows + [(None, "null id"), (5000, None), (5001, ""), (3, rows[3][1])]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(brown, "CORE", 12)
    monkeypatch.setattr(brown, "HEAD", 20)
    monkeypatch.setattr(brown, "N_CLASSES", 3)
    rows = sample()
    held = {r: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows}
    counts, ends = Counter(), 0
    for r in rows:
        if not held[r]:
            counts.update((r[1] or "").encode().lower().split())
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as uid", "2 as word")
    got = brown.score_texts(docs).collect()
    assert len(got) == len(rows)

    # the class model by dictionaries
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    top, head = ranked[:12], ranked[:20]
    symbols = brown.Symbols(top)
    pairs = np.zeros((symbols.size, symbols.size))
    texts = [[None, *(r[1] or "").encode().lower().split(), None] for r in rows if not held[r]]
    for words in texts:
        seq = [symbols.end, *symbols.of(words[1:-1]), symbols.end]
        for a, b in zip(seq, seq[1:]):
            pairs[a, b] += 1
    first = brown.exchange(pairs, len(top), 3)
    place = {w: first[k] for k, w in enumerate(top)}
    shapes = [int(first[symbols.end + 1 + j]) for j in range(len(brown.SHAPES))]

    def class_of(w):
        return int(first[symbols.end]) if w is None else place[w] if w in place else shapes[brown.shape(w)]

    def bigrams():
        grid = Counter()
        for words in texts:
            grid.update((class_of(a), class_of(b)) for a, b in zip(words, words[1:]))
        return grid

    def likelihood():
        grid = bigrams()
        left, right = Counter(), Counter()
        for (a, b), c in grid.items():
            left[a] += c
            right[b] += c
        return sum(c * math.log(c) for c in grid.values()) - sum(c * math.log(c) for c in [*left.values(), *right.values()])

    # all words beyond the core move at once: each by the likelihood if it alone moved
    for _ in range(brown.SPREAD):
        new = {}
        for w in head[12:]:
            own = class_of(w)
            tried = {}
            for c in [*range(3), own]:
                before = dict(place)
                place[w] = c
                tried[c] = likelihood()
                place.clear()
                place.update(before)
            best = max(range(3), key=lambda c: (round(tried[c], 7), -c))
            new[w] = best if tried[best] > tried[own] + 1e-6 else own
        place.update(new)
    grid = bigrams()
    classes = sorted({class_of(None), *map(class_of, counts), *shapes, *map(int, first)})
    after = {c: sum(grid[a, c] for a in classes) for c in classes}
    before = {c: sum(grid[c, b] for b in classes) for c in classes}
    used = {class_of(w) for w in head} | set(shapes) | {class_of(None)}
    uni = {c: (after[c] + 1) / (sum(after.values()) + len(used)) if c in used else 0 for c in classes}
    tail_types = Counter(brown.shape(w) for w in counts if w not in head)

    def score(words):
        total, last = 0.0, class_of(None)
        for w in [*words, None]:
            c = class_of(w)
            total += math.log10(0.9 * (grid[last, c] / before[last] if before[last] else uni[c]) + 0.1 * uni[c])
            room = after[c] + sum(tail_types[j] + 1 for j in range(len(shapes)) if shapes[j] == c)
            if w in head:
                total += math.log10(counts[w] / room)
            elif w is not None:
                total += math.log10((counts[w] + 1) / room)
            last = c
        return total

    want = []
    for r in rows:
        words = (r[1] or "").encode().lower().split()
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
        want.append((str(r[0]), held[r], len(words) + 1, sum(w in counts for w in words) + 1, n, round(base, 6), round(score(words), 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(want)


def test_exchange_finds_classes_and_beats_unigrams(spark):
    rng = np.random.default_rng(0)
    pairs = np.zeros((22, 22))
    seq = [(i % 2) * 10 + int(rng.integers(10)) for i in range(6000)]
    for a, b in zip(seq, seq[1:]):
        pairs[a, b] += 1
    label = brown.exchange(pairs, 20, 4)
    assert not set(label[:10]) & set(label[10:20])
    got = [r for r in brown.score_texts(spark.createDataFrame(sample(400), "doc_id long, text string")).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


@pytest.mark.parametrize("rows", [[], [(1, "a b")]])
def test_small(spark, rows):
    assert brown.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)
