import random
import zlib

import numpy as np
import pytest

from veilspark.llm import langid

SYLLABLES = {"aa": ["the", "ing", "ou", "sh", "wh", "ea"], "bb": ["ü", "sch", "ei", "ung", "ch", "au"], "cc": ["é", "ou", "eau", "ç", "que", "ai"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def rows(n=900, seed=5):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        out.append((k, text(rng, lang, rng.choice([3, 20, 120])), lang if rng.random() < 0.9 else None, lang))
    return out


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    net = langid.ByteNet(["a", "b", "c"], seed=3, filters=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 256, (6, 30)).astype(np.uint8), rng.integers(0, 3, 6)
    _, g = net.gradients(x, y)
    for name, grad in g.items():
        for at in zip(*np.nonzero(np.abs(grad) > 1e-4), strict=True):
            if rng.random() > 0.05:
                continue
            before, e = net.p[name][at], 1e-6
            net.p[name][at] = before + e
            up = net.gradients(x, y)[0]
            net.p[name][at] = before - e
            down = net.gradients(x, y)[0]
            net.p[name][at] = before
            assert (up - down) / (2 * e) == pytest.approx(grad[at], rel=1e-3, abs=1e-6), name


def test_tables_give_the_network():
    rng = np.random.default_rng(2)
    net = langid.ByteNet(["a", "b"], seed=4)
    x = rng.integers(0, 256, (150, langid.WINDOW)).astype(np.uint8)
    logits = net._forward(x)[2]
    want = logits - np.log(np.exp(logits).sum(1, keepdims=True))
    assert np.allclose(net.log_probs(x), want, atol=1e-4)


def test_training_lowers_the_loss_and_is_repeatable():
    rng = random.Random(1)
    x = np.array([np.frombuffer(text(rng, lang, 80).encode()[: langid.WINDOW].ljust(langid.WINDOW), np.uint8) for lang in ("aa", "bb") for _ in range(100)])
    y = np.repeat([0, 1], 100)
    one, two = (langid.ByteNet(["aa", "bb"]) for _ in range(2))
    losses = one.fit(x, y, epochs=4)
    assert losses[-1] < 0.2 < losses[0] and two.fit(x, y, epochs=4) == losses


def test_whole_texts_are_read():
    net = langid.ByteNet(["a", "b"], seed=9)
    data = [b"x" * 1000, b"x" * 1000 + b"y" * 300, b"x", b"x" * 256]
    got = net.predict(data)
    for d, (lang, score) in zip(data, got, strict=True):
        parts = [d[k : k + langid.WINDOW] for k in range(0, len(d), langid.WINDOW)]
        logs = net.log_probs(np.array([np.frombuffer(p.ljust(langid.WINDOW, b"\0"), np.uint8) for p in parts]))
        mean = (logs * np.array([len(p) for p in parts])[:, None]).sum(0) / len(d)
        probs = np.exp(mean) / np.exp(mean).sum()
        assert lang == net.languages[int(probs.argmax())] and score == pytest.approx(float(probs.max()), abs=1e-5)
    assert net.predict(data, most=500) == got and net.predict([]) == []


def test_held_out_accuracy_and_edges(spark):
    all_rows = rows()
    odd = [(2000, None, "aa", None), (2001, "", "aa", None), (2002, "123 !? 4", "bb", None), (None, "the ing shou", None, "aa"), (2003, text(random.Random(2), "cc", 60_000), None, "cc"), (2003, "éeau queç", None, "cc")]
    docs = spark.createDataFrame(all_rows + odd, "doc_id long, text string, lang string, truth string").selectExpr("*", "'x' as lang_pred", "1.0 as score", "true as letters", "1 as h")
    net = langid.train(docs)
    assert net.languages == ["aa", "bb", "cc"]
    out = {r.doc_id: r for r in langid.identify(docs, net).collect() if r.doc_id != 2003}
    for k in (2000, 2001, 2002):
        assert (out[k].lang_pred, out[k].score) == ("und", 0.0)
    assert all(r.held_out == (zlib.crc32(str("null" if k is None else k).encode()) % 4 == 2) and 0 <= r.score <= 1 for k, r in out.items())
    tested = [(out[k].lang_pred, truth) for k, _, _, truth in all_rows if out[k].held_out]
    assert len(tested) > 150 and np.mean([a == b for a, b in tested]) > 0.97
    assert [r.lang_pred for r in langid.identify(docs, net).collect() if r.doc_id == 2003] == ["cc", "cc"]


def test_only_training_rows_are_learned_from(spark):
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    learned = [k for k in range(400) if k not in held]
    docs = spark.createDataFrame([(k, "the shou ing", "aa") for k in learned[:50]] + [(k, "ü sch ei", "zz") for k in held], "doc_id long, text string, lang string")
    net = langid.train(docs)
    assert net.languages == ["aa"] and {(r.lang_pred, r.score) for r in langid.identify(docs, net).collect()} == {("aa", 1.0)}
    assert langid.training_sample(docs).count() == 1  # copies are one text


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "the", None), (2, None, "aa")], "doc_id long, text string, lang string")
    assert langid.train(docs) is None
    assert [(r.lang_pred, r.score) for r in langid.identify(docs, None).collect()] == [("und", 0.0)] * 2
    assert langid.identify(spark.createDataFrame([], docs.schema), None).count() == 0
