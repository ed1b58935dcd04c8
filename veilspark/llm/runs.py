"""Periodic runs of words: stretches that repeat themselves, such as looping output, found exactly and collapsed to one period.

A run is a stretch of consecutive words with smallest period q and at least max(MIN_LENGTH, 2 q) words that can't be extended to
either side. Its words and the same words q later overlap in at least half its length, so in MIN_LENGTH / 2 words or more: every word
of a run lies in a k-gram, k = ceil(MIN_LENGTH / 2), that occurs twice in the document. Words outside such k-grams are masked
first; most documents end there. k-grams are compared by hash for the mask, which can only let too many words through.

What survives is cut into segments, and Main and Lorentz's divide and conquer runs over them: a run across the middle of a segment
shows, for its period p, as a stretch of equal words at distance p around the middle or p before it. All middles of one depth,
of all segments of a batch, and all their periods are looked at together. Common extensions come from names of 2^j-grams
(pairs of names of half the length, ranked by sorting), so they are exact; nothing rests on a hash.

Defined results: null text and texts without words have no runs. Very long texts are held whole, with about 8 bytes a surviving
word for each doubling of its longest segment. Repeated rows have equal results, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, texts
from .textgroups import mix

MIN_LENGTH = 12
#: Words of documents that are looked at together; a document is never cut.
BATCH_WORDS = 1 << 19
_U = np.uint64


def repeated_mask(ids: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that occurs twice in its document, perhaps with some more that don't."""
    n = len(ids)
    out = np.zeros(n, bool)
    if n < k + 1:
        return out
    values = mix(ids.astype(np.uint64) + _U(0x9E3779B97F4A7C15))
    h = mix(doc[: n - k + 1].astype(np.uint64) ^ _U(0xD6E8FEB86659FD93))
    for j in range(k):
        h = mix(h * _U(0xA0761D6478BD642F) + values[j : n - k + 1 + j])
    at = np.nonzero(doc[: n - k + 1] == doc[k - 1 :])[0]
    order = np.argsort(h[at])
    ordered = h[at][order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + k, -1)
    return np.cumsum(change[:n]) > 0


class Extensions:
    """Longest common extensions of any two places of a sequence by names of its 2^j-grams."""

    def __init__(self, values: np.ndarray, longest: int):
        self.n, self.names = len(values), [values]
        while (2 << len(self.names) - 1) <= min(longest, self.n):
            width, last = 1 << len(self.names) - 1, self.names[-1]
            pairs = last[: len(last) - width].astype(np.int64) * (int(last.max()) + 1) + last[width:]
            order = np.argsort(pairs)
            ordered = pairs[order]
            named = np.empty(len(pairs), np.int64)
            named[order] = np.r_[0, np.cumsum(ordered[1:] != ordered[:-1])]
            self.names.append(named)

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from a and from b > a on."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            names = self.names[j]
            fits = b < len(names)
            equal = fits & (names[np.where(fits, a, 0)] == names[np.where(fits, b, 0)])
            step = equal.astype(np.int64) << j
            a, b, total = a + step, b + step, total + step
        return total

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree before a and before b > a."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            names, width = self.names[j], 1 << j
            fits = (a >= width) & (b - width < len(names))
            equal = fits & (names[np.where(fits, a - width, 0)] == names[np.where(fits, b - width, 0)])
            step = equal.astype(np.int64) << j
            a, b, total = a - step, b - step, total + step
        return total


def _ranges(counts: np.ndarray) -> np.ndarray:
    """1..count for each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + 1


def main_lorentz(values: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, end, period) of all runs of ``least`` words or more in the segments [begin, end) of ``values``; between two segments stands
    a value that occurs nowhere else."""
    found = []
    if len(begin):
        extensions = Extensions(values, int((end - begin).max()))
    while len(begin):
        middle = (begin + end) // 2
        for size, before in ((end - middle, False), (middle - begin, True)):
            period = _ranges(size)
            b = np.repeat(middle, size)
            a = b - period if before else b
            b = a + period
            # s[x] == s[x + period] for x from a - left to a + right
            inside = b < extensions.n
            a, b, period = a[inside], b[inside], period[inside]
            low, high = a - extensions.left(a, b), b + extensions.right(a, b)
            good = high - low >= np.maximum(least, 2 * period)
            found.append(np.stack([low[good], high[good], period[good]], 1))
        begin, end = np.r_[begin, middle], np.r_[middle, end]
        deep = end - begin >= least
        begin, end = begin[deep], end[deep]
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # a multiple of the smallest period has the same stretch
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[first]


def document_runs(all_words: list[list[bytes]], least: int = MIN_LENGTH) -> list[np.ndarray]:
    """Per document its runs, rows (start, length, period) by start, then period."""
    counts = np.array([len(x) for x in all_words], np.int64)
    first = np.r_[0, np.cumsum(counts)]
    out = [np.zeros((0, 3), np.int64)] * len(all_words)
    if not first[-1]:
        return out
    coded = pa.array([w for x in all_words for w in x], pa.binary()).dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(all_words)), counts)
    alive = repeated_mask(ids, doc, -(-least // 2))
    edge = np.diff(np.r_[False, alive, False].astype(np.int8))
    begin, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    # a stretch of surviving words may go on into the next document
    cuts = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(ids))]
    cuts = np.unique(cuts[alive[cuts] & alive[cuts - 1]]) if len(cuts) else cuts
    begin, end = np.sort(np.r_[begin, cuts]), np.sort(np.r_[end, cuts])
    long = end - begin >= least
    begin, end = begin[long], end[long]
    if not len(begin):
        return out
    size = end - begin
    new_begin = np.cumsum(size + 1) - (size + 1)
    values = np.empty(int((size + 1).sum()), np.int64)
    place = np.repeat(new_begin, size) + _ranges(size) - 1
    source = np.repeat(begin, size) + _ranges(size) - 1
    values[place] = np.unique(ids[source], return_inverse=True)[1]
    values[new_begin + size] = values[place].max() + 1 + np.arange(len(size))
    rows = main_lorentz(values, new_begin, new_begin + size, least)
    segment = np.searchsorted(new_begin, rows[:, 0], side="right") - 1
    start = rows[:, 0] - new_begin[segment] + begin[segment]
    of = doc[start]
    table = np.stack([start - first[of], rows[:, 1] - rows[:, 0], rows[:, 2]], 1)
    order = np.lexsort((table[:, 2], table[:, 0], of))
    table, of = table[order], of[order]
    edges = np.searchsorted(of, np.arange(len(all_words) + 1))
    for k in np.unique(of).tolist():
        out[k] = table[edges[k] : edges[k + 1]]
    return out


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int32)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.nonzero(np.cumsum(change[:-1]) == 0)[0].tolist()]


def _runs_of(least: int, batch_words: int):
    kinds = [("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())]
    schema = pa.schema(kinds)

    def rows(ids, words):
        found = document_runs(words, least)
        runs = [[{"start": s, "length": n, "period": q} for s, n, q in x.tolist()] for x in found]
        collapsed = [b" ".join(kept_words(w, x)).decode() for w, x in zip(words, found, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, runs, collapsed), schema, strict=True)], schema=schema)

    def run(batches):
        ids, words, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
                ids.append(doc_id)
                words.append(text.split())
                size += len(words[-1])
                if size >= batch_words:
                    yield rows(ids, words)
                    ids, words, size = [], [], 0
        if ids:
            yield rows(ids, words)

    return run


def find_runs(docs: DataFrame, least: int = MIN_LENGTH, batch_words: int = BATCH_WORDS) -> DataFrame:
    """doc_id, runs (start, length, period by start, then period), collapsed (the words of the text without the repeats of its runs, joined by
    one space), one row per row of ``docs`` (doc_id, text). Each document by itself: no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_runs_of(least, batch_words), "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _looped(batches):
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
            h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
            if h % 10 == 0 and (words := text.split()):
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                text = b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)])
            out.append(text.decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])


def with_loops(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a known loop in a tenth of the documents, by crc32 of the id: words from a on repeat with period p. Rows without
    a doc_id stay as they are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_looped, "doc_id long, text string")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, runs_sha256 and collapsed_sha256 of the rows of find_runs()."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_b"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = F.col("_b.length"), -F.col("_b.period")
    return found.select("doc_id", "n_runs", (-F.col("_b.start")).alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * _b.length div -_b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_runs(with_loops(read(spark, sf_dir, "documents"))))
