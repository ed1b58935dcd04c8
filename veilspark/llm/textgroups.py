"""Distinct texts in hash groups, and vectorised polynomial hashes over them.

The repeat operators look at all texts several times and exchange only hashes between looks. ``build`` writes the
distinct texts once, bucketed by a group number, so that no later look shuffles texts: a look is applyInArrow on the groups,
or a cogroup with what other groups have said. Groups hold about GROUP_BYTES of text, whatever the input's size.
Exact copies are one text from the start; copies are told apart again at the end by (doc_id, key).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, delete_at_exit, materialize, shared_dir

#: Bytes of text of a group, and Spark's own limit of buckets; a task works through its groups one after the other.
GROUP_BYTES, MOST_BUCKETS = 1 << 24, 100_000
#: doc_id of rows without one: after all others.
NO_ID = (1 << 63) - 1
_U = np.uint64
_TEXTS = "g long, key binary, first_id long, text binary"


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = (np.multiply.accumulate(np.r_[_U(1), np.full(n - 1, b, np.uint64)]) for b in (self.base, self.inverse))


class Prefix:
    """Hashes of any range of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, powers: Powers):
        powers.need(len(values) + 1)
        self.powers = powers
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers.up[: len(values)], out=self.sums[1:])

    def of(self, start, stop) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.powers.down[start])


BYTE_POWERS, WORD_POWERS, WORD_POWERS_2 = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F)
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xE7037ED1A0B428DB))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two hashes of every word of ``data``, starts of the words): XXH3 with two seeds, 128 bits together, once per distinct word."""
    buf = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[buf], [True]]).astype(np.int8))
    start, stop = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(stop - start, out=offsets[1:])
    letters = np.ascontiguousarray(buf[~_SPACE[buf]])
    coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    words, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
    one, two = (np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))[at] for seed in (0, 0x9E3779B97F4A7C15))
    return one, two, start


def words_of(all_texts: list[bytes], block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(both hashes of all words, first word of each text and the end): texts are hashed some MB at a time."""
    parts, counts = [], np.zeros(len(all_texts) + 1, np.int64)
    at = 0
    while at < len(all_texts):
        end, size = at, 0
        while end < len(all_texts) and (end == at or size + len(all_texts[end]) <= block):
            size += len(all_texts[end]) + 1
            end += 1
        if end == at + 1:  # perhaps a very long one: cut it at white space
            data, pos = all_texts[at], 0
            while pos < len(data):
                cut = pos + block
                while cut < len(data) and data[cut] not in b" \t\n\x0b\x0c\r":
                    cut += 1
                parts.append(word_hashes(data[pos:cut])[:2])
                counts[at + 1] += len(parts[-1][0])
                pos = cut
        else:
            one, two, starts = word_hashes(b"\n".join(all_texts[at:end]))
            offsets = np.cumsum([0, *(len(x) + 1 for x in all_texts[at:end])])
            counts[at + 1 : end + 1] = np.diff(np.searchsorted(starts, offsets))
            parts.append((one, two))
        at = end
    one, two = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    return one, two, np.cumsum(counts)


def _map_side(batches):
    """Drops copies within the task. A copy with a smaller doc_id than the one handed on leaves a row without text."""
    seen: dict[bytes, int] = {}
    less: dict[bytes, tuple[int, int]] = {}
    names = [x.split()[0] for x in _TEXTS.split(", ")]
    for batch in batches:
        groups, keys, ids = (batch.column(k).to_pylist() for k in ("g", "key", "first_id"))
        keep = []
        for k, (g, key, doc_id) in enumerate(zip(groups, keys, ids, strict=True)):
            if key not in seen:
                seen[key] = doc_id
                keep.append(k)
            elif doc_id < seen[key]:
                seen[key] = doc_id
                less[key] = (g, doc_id)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(k).take(at) for k in names], names)
    if less:
        rows = [(g, key, doc_id, None) for key, (g, doc_id) in less.items()]
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _first_of_key(batches):
    """One row per key of rows sorted by (g, key, whether there is no text): its text and smallest doc_id."""
    names = [x.split()[0] for x in _TEXTS.split(", ")]
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary())
    held: list | None = None
    for batch in batches:
        out = []
        for row in zip(*(batch.column(k).to_pylist() for k in names), strict=True):
            if held is not None and held[1] == row[1]:
                held[2] = min(held[2], row[2])
                continue
            if held is not None:
                out.append(held)
            held = list(row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(held, kinds, strict=True)], names)


class Groups:
    """``texts`` (g, key, first_id, text), bucketed by g; ``rows`` (doc_id, key), one per row of the input."""

    def __init__(self, docs: DataFrame, label: str):
        spark = docs.sparkSession
        text = F.coalesce(F.col("text"), F.lit(""))
        key = F.unhex(F.md5(text.cast("binary")))
        rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("first_id"), key.alias("key"), text.cast("binary").alias("text"))
        self.rows = materialize(rows.select("doc_id", "first_id", "key", F.octet_length("text").alias("n")), f"{label}-rows")
        size = self.rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        least = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.groups = max(2 * least, -(-size // GROUP_BYTES))
        self.buckets = min(MOST_BUCKETS, max(least, -(-self.groups // 2)))
        rows = rows.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(self.groups)))
        dealt = rows.select("g", "key", "first_id", "text").mapInArrow(_map_side, _TEXTS).repartition(self.buckets, "g")
        texts = dealt.sortWithinPartitions("g", "key", F.col("text").isNull()).mapInArrow(_first_of_key, _TEXTS)
        name = f"veil_{label}_{uuid.uuid4().hex}".replace("-", "_")
        path = f"{shared_dir(spark)}/veilspark/{name}"
        texts.write.bucketBy(self.buckets, "g").option("path", path).option("compression", "zstd").saveAsTable(name)
        delete_at_exit(spark, path)
        self.texts, self._table = spark.table(name), (name, path)

    def close(self) -> None:
        """Drop the texts: nothing looks at them any more. The rows stay, results read them."""
        name, path = self._table
        spark = self.texts.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)

    def look(self, function, schema: str) -> DataFrame:
        """function(group number, keys, first_ids, texts in order of (first_id, key)) -> Arrow table, for every group."""

        def run(table: pa.Table) -> pa.Table:
            return function(*_in_order(table))

        return self.texts.groupBy("g").applyInArrow(run, schema)

    def look_with(self, said: DataFrame, function, schema: str) -> DataFrame:
        """The same with the rows of ``said`` (g, more) of the group as last argument."""

        def run(table: pa.Table, more: pa.Table) -> pa.Table:
            return function(*_in_order(table), more)

        return self.texts.groupBy("g").cogroup(said.groupBy("g")).applyInArrow(run, schema)


def _in_order(table: pa.Table):
    g = table["g"][0].as_py() if len(table) else None
    keys, ids = table["key"].to_pylist(), table["first_id"].to_pylist()
    order = sorted(range(len(keys)), key=lambda k: (ids[k], keys[k]))
    data = table["text"].to_pylist()
    return g, [keys[k] for k in order], [ids[k] for k in order], [data[k] for k in order]


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Buckets 0..n-1 by the top 32 bits: sorted hashes have sorted buckets."""
    return ((hashes >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def cut(buckets: np.ndarray, n: int):
    """(bucket, slice) of every bucket that occurs in the sorted ``buckets``."""
    edges = np.searchsorted(buckets, np.arange(n + 1))
    return [(k, slice(edges[k], edges[k + 1])) for k in np.nonzero(np.diff(edges))[0].tolist()]


def planes(values: np.ndarray) -> bytes:
    """Byte planes: the unused high bytes of small numbers end up together and compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T).tobytes()


def unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def parts(g: np.ndarray) -> list[tuple[int, slice]]:
    """(value, slice) of every run of the sorted ``g``."""
    if not len(g):
        return []
    edges = [0, *(np.nonzero(g[1:] != g[:-1])[0] + 1).tolist(), len(g)]
    return [(int(g[a]), slice(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
