"""Class-based language model (Brown): exchange clustering, class transitions, word emissions.

The HEAD most frequent training words are clustered by exchange, which moves a word to the class that raises the likelihood
of the class bigrams most. The first CORE of them are dealt to N_CLASSES classes one word at a time, on their full bigram matrix;
the others start in a class by their shape (SHAPES) and are exchanged in SPREAD sweeps over the corpus, in which all words
move at once against the class counts of the sweep before (distributed exchange; Uszkoreit and Brants 2008). Words beyond
HEAD stay in the classes by shape, the end of a text is a class of its own. A token's probability is P(class | class before)
times P(word | class); transitions are interpolated with class frequencies, emissions of the open shape classes are smoothed by
one unseen word.

All counts are over all training texts. Texts are cut into words twice, to count them and to write their ids; all else reads
the ids. The table of words grows with the corpus and is never broadcast: the HEAD most frequent words go to the tasks, the
counts of the others reach their texts by a join. What the driver is handed is of HEAD and CORE words, whatever the size of the corpus.

Null text is empty: only its end is scored. Training texts are those with crc32(doc_id as text) mod 7 other than 2; a null
doc_id counts as the text "". Repeated rows are texts of their own, in counts and results. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, row_key, texts

N_CLASSES, CORE, SWEEPS, SPREAD = 32, 512, 6, 2
#: Words with an id of their own; ids have 16 bits, with the shapes behind the words.
HEAD = 65_520
#: Words whose neighbours are summed up together.
PART = 1024
#: Weight of the class bigram against the class frequency.
BIGRAM = 0.9
FOLDS, HELD_OUT = 7, 2
#: Words a task counts before it hands them on.
FLUSH = 400_000
BLOCK = 1 << 20

#: Shape classes, first match counts: sentence end, comma or the like, digit, symbol, not ASCII, plain.
SHAPES = tuple(re.compile(p) for p in (rb"[.!?]$", rb"[,;:]$", rb"[0-9]", rb"[^a-z\x80-\xff]", rb"[\x80-\xff]", rb""))


def shape(word: bytes) -> int:
    return next(k for k, p in enumerate(SHAPES) if p.search(word))


def _blocks(data: bytes):
    """Lower-cased words, block by block of whole words."""
    at, data = 0, data.lower()
    while at < len(data):
        end = at + BLOCK
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end].split()
        at = end


def _count_words(batches):
    counts: Counter = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
        counts.clear()
        return out

    for batch in batches:
        for data in texts(batch.column("text")):
            for words in _blocks(data):
                counts.update(words)
                if len(counts) > FLUSH:
                    yield flush()
    yield flush()


def count_words(train: DataFrame) -> DataFrame:
    """(word, c) over all texts of ``train``."""
    return train.select("text").mapInArrow(_count_words, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Symbols:
    """The symbols of the core model: core words, then the end of text, then the shapes."""

    def __init__(self, core: list[bytes]):
        self.index = {w: k for k, w in enumerate(core)}
        self.end = len(core)
        self.size = self.end + 1 + len(SHAPES)

    def of(self, words: list[bytes]) -> list[int]:
        index, base = self.index, self.end + 1
        return [k if (k := index.get(w)) is not None else base + shape(w) for w in words]


_IDS = "uid binary, doc_id long, held_out boolean, ids binary, words array<string>, counts array<long>"


def _write_ids(shared):
    """Each text as 16-bit ids: a head word's rank, or the number of head words plus a shape; and the words beyond the head with counts."""

    def run(batches):
        head: list[bytes] = shared.value
        known = {w: k for k, w in enumerate(head)}
        n_head = len(head)
        for batch in batches:
            rows = []
            for uid, doc_id, held, data in zip(*(batch.column(k).to_pylist() for k in ("uid", "doc_id", "held_out")), texts(batch.column("text")), strict=True):
                rest: Counter = Counter()
                ids = []
                for words in _blocks(data):
                    got = list(map(known.get, words))
                    if None in got:
                        missing = [w for w, k in zip(words, got, strict=True) if k is None]
                        rest.update(missing)
                        shapes = {w: n_head + shape(w) for w in set(missing)}
                        got = [shapes[w] if k is None else k for w, k in zip(words, got, strict=True)]
                    ids.append(np.array(got, np.uint16).tobytes())
                rows.append((uid, doc_id, held, b"".join(ids), list(rest), list(rest.values())))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.binary(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            arrays[4] = arrays[4].cast(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in _IDS.split(", ")])

    return run


def _sequences(batches, end: int):
    """The ids of several texts on end, an end before each text and after the last, as one array of about 2^20 ids."""
    held, size = [], 0
    stop = np.array([end], np.int64)
    for batch in batches:
        for data in batch.column("ids").to_pylist():
            ids = np.frombuffer(data, np.uint16)
            held += [stop, ids]
            size += len(ids) + 1
            if size > 1 << 20:
                yield np.concatenate([*held, stop])
                held, size = [], 0
    if held:
        yield np.concatenate([*held, stop])


def _count_pairs(table: np.ndarray, size: int):
    """(pair, c): bigrams of the symbols that ``table`` gives for ids, the end of text last; the end of one text starts the next."""

    def run(batches):
        counts = np.zeros(size * size, np.int64)
        for ids in _sequences(batches, len(table) - 1):
            seq = table[ids]
            counts += np.bincount(seq[:-1] * size + seq[1:], minlength=len(counts))
        at = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.tolist(), pa.int64()), pa.array(counts[at].tolist(), pa.int64())], ["pair", "c"])

    return run


def count_pairs(train: DataFrame, table: np.ndarray, size: int) -> np.ndarray:
    """The matrix of symbol bigrams of ``train`` (ids)."""
    rows = train.select("ids").mapInArrow(_count_pairs(table, size), "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    pairs = np.zeros(size * size)
    pairs[rows["pair"].to_numpy()] = rows["c"].to_numpy()
    return pairs.reshape(size, size)


def _count_neighbours(label: np.ndarray, core: int, n_head: int, n: int):
    """(part, data): for PART head words a row, how often each has a word of each class before and after it, and itself after it."""

    def run(batches):
        before, after, twice = np.zeros((n_head, n), np.int32), np.zeros((n_head, n), np.int32), np.zeros(n_head, np.int32)
        for ids in _sequences(batches, len(label) - 1):
            cls = label[ids]
            at = np.nonzero((ids >= core) & (ids < n_head))[0]
            w = ids[at]
            # ids of texts are inside the array: an end is before the first and after the last
            before += np.bincount(w * n + cls[at - 1], minlength=n_head * n).astype(np.int32).reshape(n_head, n)
            after += np.bincount(w * n + cls[at + 1], minlength=n_head * n).astype(np.int32).reshape(n_head, n)
            twice += np.bincount(w[ids[at + 1] == w], minlength=n_head).astype(np.int32)
        rows = np.concatenate([before, after, twice[:, None]], 1)
        for part in range(core // PART, -(-n_head // PART)):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([rows[part * PART : (part + 1) * PART].tobytes()], pa.binary())], ["part", "data"])

    return run


def _move(grid: np.ndarray, label: np.ndarray, core: int, k: int):
    """(part, classes): sums the rows of each part, one after the other, and exchanges its words."""
    n = len(grid)

    def moved(part: int, total: np.ndarray):
        rows = total.reshape(-1, 2 * n + 1)
        out = []
        for w, row in enumerate(rows, part * PART):
            into, after, own = row[:n].astype(float), row[n : 2 * n].astype(float), int(label[w])
            out.append(best_class(grid, own, after, into, float(row[-1]), k) if w >= core and row.any() else own)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.array(out, np.uint8).tobytes()], pa.binary())], ["part", "classes"])

    def run(batches):
        at, total = None, None
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if part != at and at is not None:
                    yield moved(at, total)
                row = np.frombuffer(data, np.int32).astype(np.int64)
                total = row if part != at else total + row
                at = part
        if at is not None:
            yield moved(at, total)

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, n_words: int, n_classes: int = N_CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of every symbol, given the matrix of symbol bigrams. Symbols from ``n_words`` on keep classes of their own.

    The likelihood of class bigrams is sum N(a,b) log N(a,b) - sum N(a,.) log N(a,.) - sum N(.,b) log N(.,b), up to what
    classes can't change."""
    size = len(pairs)
    k = min(n_classes, max(1, n_words))
    label = np.r_[np.arange(n_words) % k, k + np.arange(size - n_words)]
    total = k + size - n_words
    member = np.zeros((size, total))
    member[np.arange(size), label] = 1
    grid = member.T @ pairs @ member
    for _ in range(sweeps):
        moved = 0
        for w in range(n_words):
            if not pairs[w].any() and not pairs[:, w].any():
                continue
            own, twice = label[w], pairs[w, w]
            out, into = np.bincount(label, pairs[w], total), np.bincount(label, pairs[:, w], total)
            best = best_class(grid, own, out, into, twice, k)
            if best != own:
                _take(grid, own, out, into, twice, own, -1)
                _take(grid, best, out, into, twice, own, 1)
                moved += 1
            label[w] = best
        if not moved:
            break
    return label


def _take(grid: np.ndarray, cls: int, out: np.ndarray, into: np.ndarray, twice: float, own: int, sign: int) -> None:
    """Add a word to class ``cls`` of the class bigrams, or take it out: its neighbours' counts are those of a word in class ``own``."""
    out, into = out.copy(), into.copy()
    out[own] -= twice
    into[own] -= twice
    grid[cls] += sign * out
    grid[:, cls] += sign * into
    grid[cls, cls] += sign * twice


def best_class(grid: np.ndarray, own: int, out: np.ndarray, into: np.ndarray, twice: float, k: int) -> int:
    """The class, of the first ``k`` or its ``own``, in which a word makes the class bigrams likeliest. ``out``, ``into``: how often a word of
    each class follows and precedes it, itself (``twice`` times) included."""
    grid = grid.copy()
    _take(grid, own, out, into, twice, own, -1)
    out, into = out.copy(), into.copy()
    out[own] -= twice
    into[own] -= twice
    rows, cols = grid.sum(1), grid.sum(0)
    gain = (_xlogx(grid + out) - _xlogx(grid)).sum(1) + (_xlogx(grid.T + into) - _xlogx(grid.T)).sum(1)
    d = np.diagonal(grid)
    gain += _xlogx(d + out + into + twice) - _xlogx(d + out) - _xlogx(d + into) + _xlogx(d)
    n_out, n_in = out.sum() + twice, into.sum() + twice
    gain -= _xlogx(rows + n_out) - _xlogx(rows) + _xlogx(cols + n_in) - _xlogx(cols)
    best = int(np.argmax(gain[:k]))
    return own if gain[best] <= gain[own] + 1e-9 else best


class Model:
    """Log10 probabilities by id, and what the tasks need to score with them. ``label``: the class of each id, the end's last."""

    def __init__(self, label: np.ndarray, grid: np.ndarray, counts: np.ndarray, shapes: np.ndarray, n_texts: int, n_tokens: int, n_types: int):
        n_head, self.label, self.end = len(counts), label, len(label) - 1
        before, after = grid.sum(1), grid.sum(0)
        used = np.zeros(len(grid), bool)
        used[label] = True
        unigram = np.where(used, (after + 1) / (after.sum() + used.sum()), 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            bigram = np.where(before[:, None] > 0, grid / before[:, None], unigram[None, :])
            self.step = np.log10(BIGRAM * bigram + (1 - BIGRAM) * unigram[None, :])
            # one unseen word's worth is set aside in the classes of the shapes; head words that stay there belong to them
            room = after + np.bincount(label[n_head : n_head + len(SHAPES)], shapes[:, 1] + 1.0, len(grid))
            self.emit = np.log10(np.r_[counts, np.ones(len(SHAPES)), 1.0] / np.r_[room[label[:-1]], 1.0])
        self.known = np.r_[np.ones(n_head, np.int64), np.zeros(len(SHAPES), np.int64), np.int64(n_texts > 0)]
        self.base = np.r_[np.log10(counts + 1.0), np.zeros(len(SHAPES)), np.log10(n_texts + 1.0)] - np.log10(n_tokens + n_types + 1.0)


_SCORED = "uid binary, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _score(shared):
    """Scores all but the counts of the words beyond the head, which the task doesn't have."""

    def run(batches):
        m: Model = shared.value
        for batch in batches:
            rows = []
            for data in batch.column("ids").to_pylist():
                ids = np.r_[np.frombuffer(data, np.uint16), m.end].astype(np.int64)
                classes = m.label[ids]
                score = m.emit[ids].sum() + m.step[np.r_[m.label[m.end], classes[:-1]], classes].sum()
                rows.append((len(ids), int(m.known[ids].sum()), float(m.base[ids].sum()), float(score)))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            arrays = [batch.column(c) for c in ("uid", "doc_id", "held_out")] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in _SCORED.split(", ")])

    return run


def _class_grid(train: DataFrame, label: np.ndarray) -> np.ndarray:
    return count_pairs(train, label, int(label.max()) + 1)


def fit(train: DataFrame, head: list[bytes], counts: np.ndarray, vocabulary: DataFrame, core: int, n_classes: int) -> tuple[Model, int]:
    """The model and the number of training tokens; ``train`` (ids) are the training texts, ``vocabulary`` (word, c) their words."""
    n_head, core = len(head), min(core, len(head))
    kinds = np.array([shape(w) for w in head] + list(range(len(SHAPES))), np.int64)
    # symbols of the core: words, the end, the shapes
    table = np.r_[np.arange(core), core + 1 + kinds[core:], core]
    pairs = count_pairs(train, table, core + 1 + len(SHAPES))
    n_texts = int(pairs[:, core].sum())
    of_symbol = exchange(pairs, core, n_classes)
    k, label = int(of_symbol[core]), of_symbol[table]
    grid = _class_grid(train, label)
    n_parts = max(1, int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for _ in range(SPREAD if n_head > core else 0):
        parts = train.select("ids").mapInArrow(_count_neighbours(label, core, n_head, len(grid)), "part int, data binary")
        moved = parts.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(_move(grid, label, core, k), "part int, classes binary").toArrow()
        label = label.copy()
        for part, classes in zip(moved["part"].to_pylist(), moved["classes"].to_pylist(), strict=True):
            new = np.frombuffer(classes, np.uint8)
            low = max(core, part * PART)
            label[low : part * PART + len(new)] = new[low - part * PART :]
        grid = count_pairs(train, label, len(grid))
    # tokens and types of the words beyond the head, by shape
    shaped = F.lit(len(SHAPES) - 1)
    for j in reversed(range(len(SHAPES) - 1)):
        pattern = ("[.!?]$", "[,;:]$", "[0-9]", "[^a-z\\u0080-\\x{10FFFF}]", "[\\u0080-\\x{10FFFF}]")[j]
        shaped = F.when(F.col("word").rlike(pattern), j).otherwise(shaped)
    counted = vocabulary.groupBy(shaped.alias("shape")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    shapes = np.zeros((len(SHAPES), 2))
    for r in counted:
        shapes[r["shape"]] = r["n"], r["v"]
    n_words, n_types = int(shapes[:, 0].sum()), int(shapes[:, 1].sum())
    np.subtract.at(shapes, (kinds[:n_head], 0), counts)
    np.subtract.at(shapes, (kinds[:n_head], 1), 1)
    n_tokens = n_words + n_texts
    return Model(label, grid, counts, shapes, n_texts, n_tokens, n_types + (n_texts > 0)), n_tokens


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) per row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS) == HELD_OUT
    docs = docs.select("doc_id", "text", held.alias("held_out"), row_key().alias("uid"))
    vocabulary = materialize(count_words(docs.where(~F.col("held_out"))), "lm-words")
    # the head: a bounded table, whatever the corpus
    top = vocabulary.orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    head, counts = [w.encode() for w in top["word"].to_pylist()], top["c"].to_numpy().astype(float)
    ids = materialize(docs.mapInArrow(_write_ids(spark.sparkContext.broadcast(head)), _IDS), "lm-ids")
    model, n_tokens = fit(ids.where(~F.col("held_out")), head, counts, vocabulary, CORE, N_CLASSES)
    shared = spark.sparkContext.broadcast(model)
    scored = materialize(ids.select("uid", "doc_id", "held_out", "ids").mapInArrow(_score(shared), _SCORED), "lm-scored")
    rest = ids.select("uid", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("uid", F.col("x.words").alias("word"), F.col("x.counts").alias("k"))
    rest = rest.join(vocabulary, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    added = rest.select("uid", (F.col("k") * F.log10(F.col("c") + 1.0)).alias("more"), F.when(F.col("c") > 0, F.col("k")).otherwise(0).alias("also"))
    own = scored.select("uid", F.struct("doc_id", "held_out", "n_tokens", "n_known", "base", "score").alias("s"), F.lit(0.0).alias("more"), F.lit(0).cast("long").alias("also"), F.lit(1).alias("n"))
    both = own.unionByName(added.select("uid", F.lit(None).cast(own.schema["s"].dataType).alias("s"), "more", F.col("also").cast("long").alias("also"), F.lit(0).alias("n")))
    # rows of equal doc_id and text share a uid: their sums are those of one times their number
    per = both.groupBy("uid").agg(F.max("s").alias("s"), F.sum("more").alias("more"), F.sum("also").alias("also"), F.sum("n").alias("n"))
    per = per.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    more = F.col("more") / F.col("n")
    return per.select(
        "s.doc_id", "s.held_out", "s.n_tokens", (F.col("s.n_known") + (F.col("also") / F.col("n")).cast("long")).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"), (F.col("s.base") + more).alias("base_score"), (F.col("s.score") + more).alias("score"),
    )


def lm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"))
