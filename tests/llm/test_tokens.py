import functools
import random
import zlib

import numpy as np
import pytest

from veilspark.llm import tokens

tokenizers = pytest.importorskip("tokenizers")


@functools.cache
def whole():
    return tokenizers.Tokenizer.from_file(tokens.default_tokenizer())


def reference(text):
    return whole().encode(text or "", add_special_tokens=False).ids


ODD = ["", " ", "Hello, World.", "it's we'll I'd've", "ÉCOLE École école.", "İstanbul ſ ﬁ Σίσυφος ΣΑΣ", "1,234.56 a1b2", "<|endoftext|> x<|startoftext|>y", "日本語 テスト。", "a b  c", "😀😀 ok!!", "...,,.. , . ,.", "\x00\x01 q", "ǅ ǆ Ǆ", "x́ ́y", "don.t a,b. c.,", "ß SS", "Ÿ ÿ"]


def test_words_equal_whole_texts():
    encoder = tokens.WordEncoder(tokens.default_tokenizer())
    assert encoder.by_word
    rng = random.Random(1)
    alphabet = "abcXYZ éÉñ.,'!-0 \n\t\r#<|>日̈ŉ"
    for text in ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(1500)]:
        assert np.frombuffer(encoder.encode(text.encode()), encoder.kind).tolist() == reference(text), repr(text)


@pytest.mark.parametrize("seed", range(6))
def test_shard_round_trip(seed, monkeypatch):
    monkeypatch.setattr(tokens, "MIN_PAIR", 3)
    monkeypatch.setattr(tokens, "STRIDE", 16)
    rng = np.random.default_rng(seed)
    ids = rng.zipf(1.3, 5000).clip(max=[3, 50, 49407, 70000, 2, 9][seed]).astype(np.uint32) if seed else np.zeros(700, np.uint32)
    data = tokens.pack(ids)
    shard = tokens.Shard(data)
    assert shard.ids().tolist() == ids.tolist()
    for _ in range(40):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2))
        assert shard.ids(int(a), int(b)).tolist() == ids[a:b].tolist()
    lengths = tokens.lengths_of(shard.rules, shard.terminals)
    assert [len(shard._expand(np.array([shard.terminals + k], np.uint32))) for k in range(len(shard.rules))] == lengths[shard.terminals :].tolist() == shard.lengths.tolist()
    assert len(shard.seq) < len(ids)


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD_IDS", 500)
    rows = [(i * 7 % 211, t) for i, t in enumerate(ODD * 6)] + [(None, "null id"), (5000, None), (5001, "word " * 4000), (5001, "word " * 4000)]
    got = tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "'p' as part")).collect()
    want = {}
    for d, t in rows:
        ids = np.array(reference(t) + [2], "<u4")
        want.setdefault(d, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), *x) for d, v in want.items() for x in v)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])


def test_empty(spark):
    assert tokens.write_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_no_frequent_pair_is_left(seed):
    rng = np.random.default_rng(seed)
    ids = [rng.zipf(1.2, 60_000).clip(max=400), np.tile(rng.integers(0, 90, 300), 200), np.zeros(50_000, int), rng.integers(0, 50_000, 40_000)][seed].astype(np.uint32)
    seq, rules = tokens.repair(ids, int(ids.max()) + 1)
    pairs, counts = np.unique((seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:], return_counts=True)
    # a run of one symbol holds its pair half as often as it has neighbours
    same = (pairs >> np.uint64(32)) == (pairs & np.uint64(0xFFFFFFFF))
    assert not len(counts) or counts[~same].max(initial=0) < tokens.MIN_PAIR
    assert tokens.Shard(tokens.pack(ids)).ids().tolist() == ids.tolist()


def test_long_texts_in_blocks_and_a_small_cache(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 50)
    monkeypatch.setattr(tokens, "CACHE", 40)
    encoder, rng = tokens.WordEncoder(tokens.default_tokenizer()), random.Random(2)
    for _ in range(60):
        text = " ".join("".join(rng.choices("abcdeé.,1", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 60)))
        assert np.frombuffer(encoder.encode(text.encode()), encoder.kind).tolist() == reference(text)
