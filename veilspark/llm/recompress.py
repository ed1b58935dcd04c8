"""Long repeats of words by recompression.

Words get 64-bit names. Each round of recompression splits the names into left and right ones by a hash of the name and
replaces every neighbouring pair (left, right) by a new name, the hash of the two: the same on every executor without a
shared table of names. Whether a pair is replaced depends on nothing but the pair, so two occurrences of a string are cut
alike but for a few words at their ends. Equal neighbours, the runs of a name, are both left or both right, so they never
form a pair and stay cut as single names.

Rounds 1 and 2 join single words, rounds 3 to 5 symbols of up to two words; each loses at most the longest symbol it
may join at either end, 1 + 1 + 2 + 2 + 2 = 8 words together. So in a window of 20 words the symbol over word 10 is the
same in all occurrences. A symbol of n words is keyed with the 11 - n words before and 10 - n words after it, which lie in
every window around it. Keys that several groups have reveal repeats; all windows around them are exchanged by 128 bits of
hashes and checked for the first occurrence in order of (doc_id, start). Each half of a window's hash is a polynomial of its own
over its own 64-bit XXH3 hashes of the words; words themselves are not compared.

Defined results: null text has no words; of rows with one doc_id and text (repeated rows) none is earlier than another;
of rows with one doc_id and other texts the order is that of the groups; rows without doc_id come last. Texts of fewer than
20 words lose nothing. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read
from .textgroups import WORD_POWERS, WORD_POWERS_2, Groups, Prefix, bucket_of, cut, mix, parts, planes, unplanes, words_of

WINDOW, CENTER = 20, 10
#: Longest symbol that a round may join, per round.
ROUNDS = (1, 1, 2, 2, 2)
_U = np.uint64
_LOW = _U((1 << 40) - 1)


def parse(names: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, name) of the symbols of all texts; symbols never cross texts."""
    start, length, names = np.arange(len(names)), np.ones(len(names), np.int8), names.copy()
    for k, most in enumerate(ROUNDS):
        left = (mix(names + _U(0x632BE59BD9B4E019 * (k + 1) % (1 << 64))) & _U(1)).astype(bool)
        short = length <= most
        at = np.nonzero(left[:-1] & ~left[1:] & short[:-1] & short[1:] & (text_of[start[:-1]] == text_of[start[1:]]))[0]
        names[at] = mix(names[at] * _U(0x9FB21C651E98DF25) + mix(names[at + 1] ^ _U(0x8EBC6AF09C88C6E3)))
        length[at] += length[at + 1]
        keep = np.ones(len(names), bool)
        keep[at + 1] = False
        start, length, names = start[keep], length[keep], names[keep]
    return start, length, names


class Windows:
    """The windows and keyed symbols of the texts of a group."""

    def __init__(self, all_texts: list[bytes]):
        self.hashes, self.second, self.first = words_of(all_texts)
        self.counts = np.diff(self.first)
        text_of = np.repeat(np.arange(len(all_texts)), self.counts)
        self.prefix = Prefix(self.hashes, WORD_POWERS)
        n = len(self.hashes)
        #: whether a window starts at a word
        self.starts = (self.first[1:][text_of] - np.arange(n)) >= WINDOW if n else np.zeros(0, bool)
        self.text_of = text_of

    def symbols(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, first window, windows) of every symbol that is the center of a window."""
        start, length, names = parse(self.hashes, self.text_of)
        length = length.astype(np.int64)
        begin, end = self.first[:-1][self.text_of[start]], self.first[1:][self.text_of[start]]
        low = np.maximum(begin, start - CENTER)
        high = np.minimum(end - WINDOW, start - CENTER + length - 1)
        at = np.nonzero(low <= high)[0]
        start, length, names, low, high = start[at], length[at], names[at], low[at], high[at]
        around = self.prefix.of(start + length - CENTER - 1, start + WINDOW - CENTER)
        return mix(around ^ mix(names)), low, high - low + 1

    def window_hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.prefix.of(at, at + WINDOW), Prefix(self.second, WORD_POWERS_2).of(at, at + WINDOW)


def _rows(schema, rows):
    return pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


_KEYS = pa.schema([("b", pa.int64()), ("g", pa.int64()), ("data", pa.binary())])


def _send_keys(n: int):
    def run(g, keys, ids, data):
        symbols = np.unique(Windows(data).symbols()[0])
        return _rows(_KEYS, [(b, g, symbols[s].view(np.uint8).reshape(-1, 8)[:, :5].tobytes()) for b, s in cut(bucket_of(symbols, n), n)])

    return run


def _five(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def _shared_keys(table: pa.Table) -> pa.Table:
    """Keys that two groups or more have, to each of these."""
    groups, data = table["g"].to_pylist(), [_five(x) for x in table["data"].to_pylist()]
    values = np.concatenate(data)
    values.sort()
    twice = np.unique(values[1:][values[1:] == values[:-1]])
    b, out = table["b"][0].as_py(), []
    for g, own in zip(groups, data, strict=True):
        found = own[np.isin(own, twice)] if len(twice) else own[:0]
        if len(found):
            out.append((b, g, found.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()))
    return _rows(_KEYS, out)


_WINDOWS = pa.schema([("b", pa.int64()), ("g", pa.int64()), ("h1", pa.binary()), ("h2", pa.binary()), ("ids", pa.binary())])


def _send_windows(n: int):
    def run(g, keys, ids, data, said):
        if not len(said) or not data:
            return _rows(_WINDOWS, [])
        w = Windows(data)
        key, low, count = w.symbols()
        wanted = np.sort(np.concatenate([_five(x) | _U(b << 40) for b, x in zip(said["b"].to_pylist(), said["data"].to_pylist(), strict=True)]))
        own = (key & _LOW) | (bucket_of(key, n).astype(np.uint64) << _U(40))
        at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
        hit = wanted[at] == own
        low, count = low[hit], count[hit]
        starts = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        h1, h2 = w.window_hashes(starts)
        first_ids = np.array(ids, np.int64)[w.text_of[starts]]
        # texts are in order: the first of equal windows is the earliest
        order = np.lexsort((starts, h2, h1))
        h1, h2, first_ids = h1[order], h2[order], first_ids[order]
        new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])] if len(h1) else np.zeros(0, bool)
        h1, h2, first_ids = h1[new], h2[new], first_ids[new]
        return _rows(_WINDOWS, [(b, g, h1[s].tobytes(), h2[s].tobytes(), planes(first_ids[s])) for b, s in cut(bucket_of(h1, n), n)])

    return run


_LATER = pa.schema([("g", pa.int64()), ("h1", pa.binary()), ("h2", pa.binary())])


def _later_windows(table: pa.Table) -> pa.Table:
    """To each group the windows that another group has earlier."""
    h1 = [np.frombuffer(x, np.uint64) for x in table["h1"].to_pylist()]
    g = np.repeat(np.array(table["g"].to_pylist()), [len(x) for x in h1])
    h1, h2 = np.concatenate(h1), np.concatenate([np.frombuffer(x, np.uint64) for x in table["h2"].to_pylist()])
    ids = np.concatenate([unplanes(x, np.int64) for x in table["ids"].to_pylist()])
    order = np.lexsort((g, ids, h2, h1))
    h1, h2, g = h1[order], h2[order], g[order]
    later = np.r_[False, (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])]
    h1, h2, g = h1[later], h2[later], g[later]
    order = np.argsort(g, kind="stable")
    h1, h2, g = h1[order], h2[order], g[order]
    return _rows(_LATER, [(k, h1[s].tobytes(), h2[s].tobytes()) for k, s in parts(g)])


_RESULT = pa.schema([("key", pa.binary()), ("first_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def _remove(with_text: bool):
    def run(g, keys, ids, data, said):
        if not data:
            return _rows(_RESULT, [])
        w = Windows(data)
        at = np.nonzero(w.starts)[0]
        h1, h2 = w.window_hashes(at)
        order = np.argsort(h1, kind="stable")
        s1, s2 = h1[order], h2[order]
        again = np.zeros(len(at), bool)
        if len(at):
            again[order[1:]] = (s1[1:] == s1[:-1]) & (s2[1:] == s2[:-1])
            f1 = np.concatenate([np.frombuffer(x, np.uint64) for x in said["h1"].to_pylist()] or [np.zeros(0, np.uint64)])
            f2 = np.concatenate([np.frombuffer(x, np.uint64) for x in said["h2"].to_pylist()] or [np.zeros(0, np.uint64)])
            if len(f1):
                o = np.argsort(f1)
                f1, f2 = f1[o], f2[o]
                k = np.minimum(np.searchsorted(f1, h1), len(f1) - 1)
                again |= (f1[k] == h1) & (f2[k] == h2)
        change = np.zeros(len(w.hashes) + WINDOW + 1, np.int32)
        np.add.at(change, at[again], 1)
        np.add.at(change, at[again] + WINDOW, -1)
        gone = np.cumsum(change)[: len(w.hashes)] > 0
        total = np.r_[0, np.cumsum(gone)]
        removed = total[w.first[1:]] - total[w.first[:-1]]
        out = []
        for k, (key, doc_id, text) in enumerate(zip(keys, ids, data, strict=True)):
            words = text.split()
            if removed[k]:
                mask = gone[w.first[k] : w.first[k + 1]]
                words = [x for x, m in zip(words, mask.tolist(), strict=True) if not m]
            kept = b" ".join(words)
            out.append((key, doc_id, int(w.counts[k]), int(removed[k]), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        return _rows(_RESULT, out)

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row of ``docs`` (doc_id, text); ``with_text``: kept, the kept words, too."""
    groups = Groups(docs, "substrings")
    n = groups.buckets

    def ddl(schema):
        return ", ".join(f"{f.name} {({pa.int64(): 'long', pa.binary(): 'binary', pa.string(): 'string'})[f.type]}" for f in schema)

    keys = groups.look(_send_keys(n), ddl(_KEYS))
    shared = keys.groupBy("b").applyInArrow(_shared_keys, ddl(_KEYS))
    windows = groups.look_with(shared, _send_windows(n), ddl(_WINDOWS))
    later = windows.groupBy("b").applyInArrow(_later_windows, ddl(_LATER))
    per_text = materialize(groups.look_with(later, _remove(with_text), ddl(_RESULT)), "substrings-texts")
    groups.close()
    out = groups.rows.withColumnRenamed("first_id", "own_id").join(per_text, "key")
    # a later copy of a whole text: all its windows are in the first copy
    copy = (F.col("own_id") != F.col("first_id")) & (F.col("n_words") >= WINDOW)
    empty = hashlib.sha256(b"").hexdigest()
    columns = ["doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(copy, F.lit(empty)).otherwise(F.col("kept_sha256")).alias("kept_sha256")]
    return out.select(*columns, *([F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept")] if with_text else []))


def substring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


