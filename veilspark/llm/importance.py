"""Importance resampling towards a target distribution, with a dictionary of distinct features.

A feature is a run of one to three words. Texts are packed into blocks of some MB, and every block lists its distinct features.
These strings are dealt by a hash of their first two words to dictionary partitions, where equal strings of all blocks meet: there
each distinct string is counted and hashed once, and its bucket goes back to the blocks that have it. Bucket totals are sums
over the dictionary, gains compare them with the target's, and a block adds up the gains of its documents' features.
Only distinct features per block travel, never one row for each occurrence, and texts are shuffled nowhere: the table of blocks is
bucketed by block, and replies come to it. Dictionary partitions have TURNS turns, one after the other: what a turn asks is deleted with
its job, so that no more than its share is on disk at once. A block lists its features anew in each turn.

The draw adds Gumbel noise to the weights and takes the highest scores: sampling without replacement in proportion to exp(weight / 1000).
Ranks come from a sort by ranges and the number of rows in the ranges before, so that no task holds all documents.

Defined results: null text has no words, weight 0, and is drawn only if min_words is 0. A null doc_id is hashed as the text "null" and is
last among equal scores. Repeated rows are documents of their own, with consecutive ranks. An empty table, of documents or of the
target, has no features: gains are then those of zero counts. Other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import delete, delete_at_exit, drop_table, materialize, read, shared_dir, shuffles_dropped, small_batches
from .textgroups import mix, planes, unplanes

BUCKETS, SEED, SHARE, MIN_WORDS = 10_000, 42, 0.05, 20
#: Bytes of text of a block, and of text per dictionary partition.
BLOCK_BYTES, PART_BYTES = 12 << 20, 1 << 23
#: Turns in which the dictionary partitions are asked.
TURNS = 2
_U = np.uint64
#: Lower case for A-Z; whatever is neither a letter a-z, a digit nor beyond ASCII ends a word.
_NORMAL = bytes((k + 32 if 65 <= k <= 90 else k) if (48 <= k <= 57 or 65 <= k <= 90 or 97 <= k <= 122 or k >= 128) else 32 for k in range(256))
_BLOCKS = "block long, ids array<long>, size long, data binary"


def _packer(block_bytes: int):
    """Rows (doc_id, text) to blocks: the ids, and the normalised texts with a line feed after each."""

    def run(batches):
        task, n, ids, parts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + n], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([b"".join(parts)], pa.binary())], ["block", "ids", "size", "data"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = (text or b"").translate(_NORMAL)
                if ids and size + len(data) > block_bytes:
                    yield row()
                    n, ids, parts, size = n + 1, [], [], 0
                ids.append(doc_id)
                parts += [data, b"\n"]
                size += len(data) + 1
        if ids:
            yield row()

    return run


def _binary(buf: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The binary array of ``lengths`` over the bytes ``buf``."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf))])


def _objects(strings: pa.Array) -> Iterator[bytes]:
    """The values of an array, 65,536 objects at a time; to_pylist() makes a scalar of each."""
    for at in range(0, len(strings), 1 << 16):
        yield from strings.slice(at, 1 << 16).to_numpy(zero_copy_only=False).tolist()


def _ranked(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct codes in order, place of each code among them, how often each occurs)."""
    order = np.argsort(codes)
    ordered = codes[order]
    new = np.ones(len(codes), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    distinct = ordered[new]
    del ordered
    place, run = np.empty(len(codes), np.int32), np.cumsum(new, dtype=np.int32)
    run -= 1
    place[order] = run
    at = np.nonzero(new)[0]
    return distinct, place, np.diff(np.r_[at, len(codes)]).astype(np.int32)


def _codes(high: np.ndarray, n: int, low: np.ndarray) -> np.ndarray:
    """high * n + low, in one array of its own."""
    codes = high.astype(np.int64)
    codes *= n
    codes += low
    return codes


class Block:
    """The distinct features of a block, in string order of their words: ``words``; ``first`` and ``second`` word of each pair; ``pair`` and
    ``third`` word of each triple; ``counts`` of the three kinds. ``ids``, ``pairs`` and ``triples`` number the features along the text."""

    def __init__(self, data: bytes):
        buf = np.frombuffer(data, np.uint8)
        inside = (buf != 32) & (buf != 10)
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        start, stop = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        ends = np.nonzero(buf == 10)[0]
        self.n_words = np.diff(np.r_[0, np.searchsorted(start, ends)])
        doc = np.repeat(np.arange(len(ends), dtype=np.int32), self.n_words)
        self.docs, self.doc = len(ends), doc
        coded = _binary(buf[inside], stop - start).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int32)
        rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
        self.words = coded.dictionary.take(order)
        self.ids = rank[coded.indices.to_numpy()] if len(start) else np.zeros(0, np.int32)
        del buf, inside, edge, start, stop, ends, coded
        n = max(1, len(self.words))
        # the last word of a document starts no pair, the last two no triple
        self.at_2 = np.nonzero(doc[:-1] == doc[1:])[0].astype(np.int32)
        pairs, self.pairs, count_2 = _ranked(_codes(self.ids[self.at_2], n, self.ids[self.at_2 + 1]))
        self.first, self.second = (pairs // n).astype(np.int32), (pairs % n).astype(np.int32)
        del pairs
        more = doc[self.at_2] == doc[np.minimum(self.at_2 + 2, len(doc) - 1)]
        more &= self.at_2 + 2 < len(doc)
        self.at_3 = self.at_2[more]
        triples, self.triples, count_3 = _ranked(_codes(self.pairs[more], n, self.ids[self.at_3 + 2]))
        self.pair, self.third = (triples // n).astype(np.int32), (triples % n).astype(np.int32)
        self.counts = np.bincount(self.ids, minlength=len(self.words)), count_2, count_3

    def dealt(self, n_parts: int) -> list[np.ndarray]:
        """The dictionary partition of each word, pair and triple: a triple is where its pair is."""
        h = np.fromiter(map(xxhash.xxh64_intdigest, _objects(self.words)), np.uint64, len(self.words))
        pair = (mix(h[self.first] * _U(3) + mix(h[self.second])) % _U(n_parts)).astype(np.int32)
        return [(mix(h) % _U(n_parts)).astype(np.int32), pair, pair[self.pair]]

    def weights(self, gains: list[np.ndarray]) -> np.ndarray:
        """Sum of gains per document; gains of the words, pairs and triples."""
        total = np.zeros(self.docs, np.int64)
        for at, along, gain in zip((np.arange(len(self.ids)), self.at_2, self.at_3), (self.ids, self.pairs, self.triples), gains, strict=True):
            sums = np.zeros(len(along) + 1, np.int64)
            np.cumsum(gain[along], out=sums[1:])
            upto = np.searchsorted(self.doc[at], np.arange(self.docs + 1))
            total += sums[upto[1:]] - sums[upto[:-1]]
        return total


def _packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(3).compress(data)


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _joined(strings: pa.Array) -> bytes:
    """Strings with a line feed after each."""
    if not len(strings):
        return _packed(b"")
    return _packed(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(strings)], pa.int32()), strings), b"\n")[0].as_py() + b"\n")


def _strings(data: bytes) -> pa.Array:
    buf = np.frombuffer(_unpacked(data), np.uint8)
    ends = np.nonzero(buf == 10)[0]
    return _binary(buf[buf != 10], np.diff(np.r_[-1, ends]) - 1)


def _small(values: np.ndarray) -> bytes:
    return _packed(planes(np.ascontiguousarray(values, np.uint32)))


def _numbers(data: bytes) -> np.ndarray:
    return unplanes(_unpacked(data), np.uint32)


#: words; distinct first words of pairs, pairs of each, second words; triples of each pair, third words; counts of the three kinds
_PARTS = ("words", "firsts", "per_first", "seconds", "per_pair", "thirds", "c1", "c2", "c3")
_ASKED = pa.schema([("p", pa.int32()), ("block", pa.int64()), *[(x, pa.binary()) for x in _PARTS]])
_ASKED_DDL = "p int, block long, " + ", ".join(f"{x} binary" for x in _PARTS)


def _cuts(dealt: np.ndarray, n: int, turn: int = 0, turns: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(places by partition in their own order, where each partition's begin); only of the partitions of ``turn``, of every ``turns`` one."""
    mine = np.nonzero(dealt % turns == turn)[0].astype(np.int32) if turns > 1 else np.arange(len(dealt), dtype=np.int32)
    dealt = dealt[mine]
    # few partitions fit two bytes, which are sorted by counting
    order = np.argsort(dealt.astype(np.uint16) if n <= 1 << 16 else dealt, kind="stable")
    return mine[order], np.searchsorted(dealt[order], np.arange(n + 1))


def _asker(n_parts: int, turn: int = 0, turns: int = 1):
    def run(batches):
        for batch in batches:
            for number, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                b = Block(data.as_py())
                # the places along the text serve the weights alone
                del b.ids, b.pairs, b.triples, b.at_2, b.at_3, b.doc
                (w, w_at), (p, p_at), (t, t_at) = (_cuts(x, n_parts, turn, turns) for x in b.dealt(n_parts))
                triples_of = np.bincount(b.pair, minlength=len(b.first))
                for k in range(turn, n_parts, turns):
                    ws, ps, ts = w[w_at[k] : w_at[k + 1]], p[p_at[k] : p_at[k + 1]], t[t_at[k] : t_at[k + 1]]
                    if not len(ws) and not len(ps):
                        continue
                    firsts, _, per_first = _ranked(b.first[ps])
                    row = [_joined(b.words.take(pa.array(ws))), _joined(b.words.take(pa.array(firsts))), _small(per_first), _joined(b.words.take(pa.array(b.second[ps]))), _small(triples_of[ps])]
                    row += [_joined(b.words.take(pa.array(b.third[ts]))), *[_small(c[x]) for c, x in zip(b.counts, (ws, ps, ts), strict=True)]]
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([k, number, *row], _ASKED, strict=True)], schema=_ASKED)

    return run


_TOLD = pa.schema([("block", pa.int64()), ("p", pa.int32()), ("buckets", pa.binary()), ("totals", pa.binary())])
_TOLD_DDL = "block long, p int, buckets binary, totals binary"


def _dictionary(n_buckets: int):
    """The features of a partition: every distinct string is hashed once. A row for each block that asked, with its features' buckets in
    the order it listed them, and one row with the totals of all buckets."""

    def run(table: pa.Table) -> pa.Table:
        rows, sizes, kinds = table.to_pylist(), [], ([], [], [])
        counts = ([], [], [])
        for r in rows:
            words = _strings(r["words"])
            per_first = _numbers(r["per_first"])
            firsts = _strings(r["firsts"]).take(pa.array(np.repeat(np.arange(len(per_first)), per_first)))
            pairs = pc.binary_join_element_wise(firsts, _strings(r["seconds"]), b" ")
            repeat = np.repeat(np.arange(len(pairs)), _numbers(r["per_pair"]))
            triples = pc.binary_join_element_wise(pairs.take(pa.array(repeat)), _strings(r["thirds"]), b" ")
            sizes.append([len(x) for x in (words, pairs, triples)])
            for kind, strings, held, c in zip(kinds, (words, pairs, triples), counts, ("c1", "c2", "c3"), strict=True):
                kind.append(strings)
                held.append(_numbers(r[c]))
        p, totals, told = rows[0]["p"], np.zeros(n_buckets, np.int64), []
        del rows
        for strings, count in zip(kinds, counts, strict=True):
            # strings of one, two and three words are never equal: a dictionary for each
            coded = pa.chunked_array(strings, pa.binary()).combine_chunks().dictionary_encode()
            strings.clear()
            distinct = (np.fromiter(map(zlib.crc32, _objects(coded.dictionary)), np.uint32, len(coded.dictionary)) % n_buckets).astype(np.uint16)
            per_string = np.bincount(coded.indices.to_numpy(), np.concatenate(count), len(distinct)).astype(np.int64)
            totals += np.bincount(distinct, per_string, n_buckets).astype(np.int64)
            told.append(distinct[coded.indices.to_numpy()] if len(distinct) else np.zeros(0, np.uint16))
        at = [0, 0, 0]
        out = []
        for number, size in zip(table["block"].to_pylist(), sizes, strict=True):
            out.append({"block": number, "p": p, "buckets": _packed(planes(np.concatenate([x[a : a + s] for x, a, s in zip(told, at, size, strict=True)]))), "totals": None})
            at = [a + s for a, s in zip(at, size, strict=True)]
        return pa.Table.from_pylist([*out, {"block": -1, "p": p, "buckets": None, "totals": _packed(planes(totals))}], _TOLD)

    return run


def _summed(table: pa.Table) -> pa.Table:
    total = sum(unplanes(_unpacked(x), np.int64) for x in table["totals"].to_pylist())
    return pa.table({"p": pa.array([table["p"][0].as_py()], pa.int32()), "totals": pa.array([_packed(planes(total))], pa.binary())})


def _by_bucket(batches):
    for batch in batches:
        for data in batch.column("totals").to_pylist():
            total = unplanes(_unpacked(data), np.int64)
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])


_SCORED_DDL = "doc_id long, n_words long, n_features long, weight long"


def _weigher(n_parts: int, gains: np.ndarray):
    gains = gains.astype(np.int32)

    def run(blocks: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        replies = dict(zip(told["p"].to_pylist(), told["buckets"].to_pylist(), strict=True))
        for ids, data in zip(blocks["ids"].to_pylist(), blocks["data"].to_pylist(), strict=True):
            b = Block(data)
            cuts = [_cuts(x, n_parts) for x in b.dealt(n_parts)]
            del b.words, b.first, b.second, b.pair, b.third, b.counts
            found = [np.zeros(len(order), np.int32) for order, _ in cuts]
            for k, reply in replies.items():
                buckets, a = unplanes(_unpacked(reply), np.uint16), 0
                for gain, (order, at) in zip(found, cuts, strict=True):
                    mine = order[at[k] : at[k + 1]]
                    gain[mine] = gains[buckets[a : a + len(mine)]]
                    a += len(mine)
            n = b.n_words
            features = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
            out.append(pa.table([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(features, pa.int64()), pa.array(b.weights(found))], names=["doc_id", "n_words", "n_features", "weight"]))
        names = [x.split()[0] for x in _SCORED_DDL.split(", ")]
        return pa.concat_tables(out) if out else pa.table({x: pa.array([], pa.int64()) for x in names})

    return run


class Features:
    """The blocks of a table (doc_id, text) and what the dictionary has said about them."""

    def __init__(self, docs: DataFrame, n_buckets: int = BUCKETS, block_bytes: int = BLOCK_BYTES):
        spark = docs.sparkSession
        self.name = f"veil_features_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(spark)}/veilspark/{self.name}"
        least = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        with small_batches(spark):
            rows.mapInArrow(_packer(block_bytes), _BLOCKS).write.bucketBy(least, "block").option("path", self.path).option("compression", "zstd").saveAsTable(self.name)
        delete_at_exit(spark, self.path)
        self.blocks = spark.table(self.name)
        size = self.blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        self.n_parts, self.n_buckets = max(2 * least, -(-size // PART_BYTES)), n_buckets
        self.tables = []
        for turn in range(TURNS):
            asked = self.blocks.select("block", "data").mapInArrow(_asker(self.n_parts, turn, TURNS), _ASKED_DDL)
            # what is asked is the largest exchange, and it has gone when the next turn or the replies follow
            with shuffles_dropped(spark):
                self.tables.append(materialize(asked.groupBy("p").applyInArrow(_dictionary(n_buckets), _TOLD_DDL), "feature-buckets"))
        self.told = functools.reduce(DataFrame.unionByName, self.tables)

    def totals(self) -> DataFrame:
        """(bucket, n): features of all documents in each bucket that has any. The partitions' totals are summed as they are, about
        the square root of their number at a time."""
        each = self.told.where("totals is not null").select("p", "totals")
        for groups in (math.isqrt(self.n_parts) + 1, 1):
            each = each.withColumn("p", F.pmod("p", F.lit(groups)).cast("int")).groupBy("p").applyInArrow(_summed, "p int, totals binary")
        return each.mapInArrow(_by_bucket, "bucket long, n long")

    def weights(self, gains: np.ndarray) -> DataFrame:
        """(doc_id, n_words, n_features, weight), one row per row of the table."""
        told = self.told.where("totals is null").select("block", "p", "buckets")
        return self.blocks.select("block", "ids", "data").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_weigher(self.n_parts, gains), _SCORED_DDL)

    def close(self) -> None:
        spark = self.blocks.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(spark, self.path)
        for table in self.tables:
            drop_table(table)


def bucket_gains(corpus: DataFrame, target: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of shares) of every bucket; both are (bucket, n). One number per bucket, whatever the input."""
    s, t = np.zeros(n_buckets, np.int64), np.zeros(n_buckets, np.int64)
    for counts, table in ((s, corpus), (t, target)):
        for r in table.collect():
            counts[r.bucket] = r.n
    all_s, all_t = int(s.sum()), int(t.sum())
    return np.array([math.floor(1000 * math.log(((y + 1) * (all_s + n_buckets)) / ((x + 1) * (all_t + n_buckets)))) for x, y in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def resample(docs: DataFrame, target: DataFrame, share: float = SHARE, min_words: int = MIN_WORDS, seed: int = SEED, n_buckets: int = BUCKETS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_features, weight, score, rank per row of ``docs`` (doc_id, text): the floor(share * N) highest scores of the N documents with
    at least ``min_words`` words are ranked 1, 2, 3...; others have no rank. ``target``: (text) of the distribution wanted."""
    wanted = Features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n_buckets)
    features = Features(docs, n_buckets, block_bytes)
    gains = bucket_gains(features.totals(), wanted.totals(), n_buckets)
    wanted.close()
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = features.weights(gains).withColumn("score", F.col("weight") + noise)
    fit = (F.col("n_words") >= min_words).alias("fit")
    # the sort by ranges reads its rows twice, once for the ranges: the weights are written before
    with shuffles_dropped(docs.sparkSession):
        scores = materialize(scored.select("doc_id", "n_features", "weight", "score", fit), "scores")
    features.close()
    # documents that can't be drawn come after all others, so that positions are ranks
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = materialize(numbered(scores, order, "place", lambda df: materialize(df, "draw-order")), "draw")
    drop_table(scores)
    n = placed.agg(F.coalesce(F.sum(F.col("fit").cast("long")), F.lit(0))).first()[0]
    drawn = math.floor(round(share * 1_000_000) * n / 1_000_000)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))


def importance_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
