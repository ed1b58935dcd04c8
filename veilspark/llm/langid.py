"""Language identification by a convolutional network over bytes.

Bytes are embedded; filters of several widths slide over fixed windows, each filter's largest response in the window goes through a
rectifier, and a softmax over the languages follows. The network is trained here, in numpy, by Adam on windows of labelled texts.
For prediction a text is cut into windows of WINDOW bytes, all of them, the last one padded with zero bytes; the windows' log
probabilities are averaged by their number of bytes, and the language with the highest average wins.

Filters are applied by tables: the response of a filter to two neighbouring bytes is one entry of a table of 65,536, so a filter of
four bytes costs two look-ups. Documents don't meet: there is no shuffle but for the sample.

The sample that is learned from is bounded: at most PER_LANGUAGE distinct texts of each of the LANGUAGES most frequent labels, those
with the smallest hash, and up to TRAIN_WINDOWS windows spread over each text. So much goes to the driver whatever the input.

Defined results: null text and text without a letter are ``und`` with score 0; so is everything if no row has a label to learn from.
A null doc_id is hashed as the text "null". Ties go to the first language in code point order. A text that is longer than any limit is
read whole. Repeated rows have equal results, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, texts

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
PER_LANGUAGE, LANGUAGES, TRAIN_WINDOWS = 1200, 64, 3
EPOCHS, BATCH, RATE, SEED = 10, 128, 0.01, 7
UNKNOWN = "und"


class ByteNet:
    """The network: ``languages`` and its parameters."""

    def __init__(self, languages: list[str], seed: int = SEED, window: int = WINDOW, filters: int = FILTERS):
        rng = np.random.default_rng(seed)
        self.languages, self.window = languages, window
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "out": rng.normal(0, 0.2, (len(WIDTHS) * filters, len(languages))), "bias": np.zeros(len(languages))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, filters))
            self.p[f"b{w}"] = np.zeros(filters)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self._tables = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    # --- training ---
    def _forward(self, x: np.ndarray):
        """(pooled responses, places of the largest ones per width, logits)."""
        pooled, places = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            h = sum((self.p["embed"] @ self.p[f"w{w}"][j])[x[:, j : j + n]] for j in range(w))
            at = h.argmax(1)
            places.append(at)
            pooled.append(np.take_along_axis(h, at[:, None], 1)[:, 0] + self.p[f"b{w}"])
        pooled = np.concatenate(pooled, 1)
        return pooled, places, np.maximum(pooled, 0) @ self.p["out"] + self.p["bias"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of windows ``x`` with languages ``y``, and its gradient."""
        pooled, places, logits = self._forward(x)
        z = logits - logits.max(1, keepdims=True)
        probs = np.exp(z)
        probs /= probs.sum(1, keepdims=True)
        rows = np.arange(len(x))
        loss = float(-np.log(probs[rows, y] + 1e-12).mean())
        d = probs
        d[rows, y] -= 1
        d /= len(x)
        g = {"out": np.maximum(pooled, 0).T @ d, "bias": d.sum(0), "embed": np.zeros_like(self.p["embed"])}
        back = (d @ self.p["out"].T) * (pooled > 0)
        n = self.p[f"b{WIDTHS[0]}"].shape[0]
        for k, w in enumerate(WIDTHS):
            own, weight = back[:, k * n : (k + 1) * n], self.p[f"w{w}"]
            g[f"b{w}"], g[f"w{w}"] = own.sum(0), np.zeros_like(weight)
            for j in range(w):
                # only the place of the largest response of each filter counts
                bytes_at = x[rows[:, None], places[k] + j]
                g[f"w{w}"][j] = np.einsum("bf,bfe->ef", own, self.p["embed"][bytes_at])
                np.add.at(g["embed"], bytes_at, own[:, :, None] * weight[j].T[None])
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> list[float]:
        """Adam over the windows ``x`` (n, window) of languages ``y``; mean loss of each epoch. A part of each batch is cut short, as texts may be."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step, losses, span = 0, [], np.arange(x.shape[1])
        for epoch in range(epochs):
            order, total = rng.permutation(len(x)), 0.0
            rate = RATE * (1 - epoch / epochs) + RATE / 20
            for a in range(0, len(x), BATCH):
                at = order[a : a + BATCH]
                part = x[at].copy()
                short = rng.random(len(at)) < 0.4
                part[short[:, None] & (span >= rng.integers(12, x.shape[1], len(at))[:, None])] = 0
                loss, g = self.gradients(part, y[at])
                total += loss * len(at)
                step += 1
                for k, grad in g.items():
                    m[k] += 0.1 * (grad - m[k])
                    v[k] += 0.001 * (grad * grad - v[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(total / max(1, len(x)))
        self._tables = None
        return losses

    # --- prediction ---
    def _table(self, w: int, j: int) -> np.ndarray:
        """Response of width ``w`` to bytes j and j + 1 of its stretch, or to the last byte alone."""
        one = self.p["embed"] @ self.p[f"w{w}"][j]
        if j + 1 == w:
            return np.ascontiguousarray(one, np.float32)
        two = self.p["embed"] @ self.p[f"w{w}"][j + 1]
        return np.ascontiguousarray((one[:, None] + two[None]).reshape(65_536, -1), np.float32)

    def log_probs(self, x: np.ndarray, block: int = 64) -> np.ndarray:
        """Log probabilities (windows, languages) of windows ``x``."""
        if self._tables is None:
            self._tables = {w: [self._table(w, j) for j in range(0, w, 2)] for w in WIDTHS}
        out = np.empty((len(x), len(self.languages)), np.float32)
        for a in range(0, len(x), block):
            # places first: the maximum over them then runs along whole rows of windows and filters
            single = x[a : a + block].T.astype(np.intp)
            double = (single[:-1] << 8) | single[1:]
            pooled = []
            for w in WIDTHS:
                n, h = len(single) - w + 1, None
                for k, table in enumerate(self._tables[w]):
                    found = table.take((double if 2 * k + 1 < w else single)[2 * k : 2 * k + n], axis=0)
                    h = found if h is None else np.add(h, found, out=h)
                pooled.append(h.max(0) + self.p[f"b{w}"])
            logits = np.maximum(np.concatenate(pooled, 1), 0) @ self.p["out"] + self.p["bias"]
            logits -= logits.max(1, keepdims=True)
            out[a : a + block] = logits - np.log(np.exp(logits).sum(1, keepdims=True))
        return out

    def predict(self, data: list[bytes], most: int = 1 << 22) -> list[tuple[str, float]]:
        """(language, score) of each text: texts of some MB are windowed together, a longer one by itself."""
        out, a = [], 0
        while a < len(data):
            b, size = a, 0
            while b < len(data) and (b == a or size + len(data[b]) <= most):
                size += len(data[b])
                b += 1
            out += self._predict(data[a:b])
            a = b
        return out

    def _predict(self, data: list[bytes]) -> list[tuple[str, float]]:
        size = np.array([len(x) for x in data], np.int64)
        count = np.maximum(1, -(-size // self.window))
        first = np.r_[0, np.cumsum(count)]
        buf = np.zeros(first[-1] * self.window, np.uint8)
        for x, at in zip(data, (first[:-1] * self.window).tolist(), strict=True):
            buf[at : at + len(x)] = np.frombuffer(x, np.uint8)
        logs = self.log_probs(buf.reshape(-1, self.window))
        weight = np.full(first[-1], self.window, np.float64)
        weight[first[1:] - 1] = np.maximum(1, size - (count - 1) * self.window)
        mean = np.add.reduceat(logs * weight[:, None], first[:-1], axis=0) / np.add.reduceat(weight, first[:-1])[:, None]
        mean -= mean.max(1, keepdims=True)
        probs = np.exp(mean)
        probs /= probs.sum(1, keepdims=True)
        best = probs.argmax(1)
        return [(self.languages[k], float(p)) for k, p in zip(best.tolist(), probs[np.arange(len(best)), best].tolist(), strict=True)]


def windows(data: bytes, window: int = WINDOW, most: int = TRAIN_WINDOWS) -> list[bytes]:
    """Up to ``most`` windows spread over a text, the last one padded."""
    count = max(1, -(-len(data) // window))
    picked = range(count) if count <= most else [k * (count - 1) // (most - 1) for k in range(most)]
    return [data[k * window : (k + 1) * window].ljust(window, b"\0") for k in picked]


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id's text is 2 modulo 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 4 == 2


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> DataFrame:
    """(lang, h, data): at most ``languages`` labels with about ``per_language`` distinct texts each, their windows end to end. Rows are picked by
    a hash of the text, so copies are picked or left together and are one text; the windows, not the texts, are shuffled."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    share = F.broadcast(counts.select(F.col("lang").alias("_l"), (F.lit(2.0 * per_language) / F.col("count")).alias("_share")))
    rows = usable.select("lang", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("h"))
    rows = rows.join(share, F.col("lang") == F.col("_l")).where(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < F.col("_share"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array([b"".join(windows(x)) for x in texts(batch.column("text"))], pa.binary())], ["lang", "h", "data"])

    return rows.select("lang", "h", "text").mapInArrow(run, "lang string, h long, data binary").groupBy("lang", "h").agg(F.min("data").alias("data"))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES, seed: int = SEED) -> ByteNet | None:
    """The network learned from rows (doc_id, text, lang) that aren't held out; None if there is no labelled text."""
    sample = training_sample(docs, per_language, languages).orderBy(F.shiftrightunsigned("h", 11), "h", "lang", "data").limit(2 * per_language * languages)
    taken: dict[str, list[bytes]] = {}
    for row in sample.toLocalIterator():
        own = taken.setdefault(row.lang, [])
        if len(own) < per_language:
            own.append(bytes(row.data))
    if not taken:
        return None
    names = sorted(taken)
    x, y = [], []
    for k, name in enumerate(names):
        for data in taken[name]:
            own = np.frombuffer(data, np.uint8).reshape(-1, WINDOW)
            x.append(own)
            y += [k] * len(own)
    net = ByteNet(names, seed)
    net.fit(np.concatenate(x), np.array(y), seed=seed)
    return net


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of ``docs`` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            fit = batch.column("letters").to_pylist()
            found = iter(net.predict([x for x, f in zip(texts(batch.column("text")), fit, strict=True) if f]) if net else ())
            rows = [next(found) if f and net else (UNKNOWN, 0.0) for f in fit]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, train(docs))
