"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint is the bitwise majority of the XXH64 (seed 42) of its word 3-shingles. Texts link where fingerprints
differ in at most 3 of 64 bits. Of two such fingerprints, one 32-bit half differs in at most one bit, so each fingerprint
asks both half tables for the 33 values of the Hamming ball of radius 1 around its own half, and what comes back is
compared over all 64 bits.

Copies share a fingerprint and are one row from the start. A half value with more than HOT fingerprints isn't joined: its
members are dealt in tiles of TILE, and each pair of tiles is compared in one task of bounded memory, which returns a
spanning forest of the links and not the links. Components come from rounds of star contraction with written tables.

Null and empty texts have fingerprint zero and link like any other. Lower-casing is A-Z only. Repeated rows give repeated
results. A null doc_id never is the smallest of a component that has another; alone, its component is null. ``keep_one`` keeps
one row of every component: the smallest doc_id's (null last), of several such rows one text's, the smallest by MD5, and of
repeated rows the one whose other columns are smallest. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_table, free_name, materialize, read, row_key, small_side, texts

MAX_BITS = 3
#: Fingerprints that share a half value and are still joined pair by pair.
HOT = 64
#: Fingerprints a task compares with as many others, where a half value is shared by more.
TILE = 2048
#: Bytes of a text that are cut into words at once.
BLOCK = 1 << 22

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _word_blocks(data: bytes):
    """The words of a text, block by block; blocks end at white space."""
    at = 0
    while at < len(data):
        end = at + BLOCK
        if end < len(data):
            while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
                end += 1
        yield data[at:end].split()
        at = end


def fingerprint(data: bytes) -> int:
    """The unsigned 64-bit fingerprint of a text in UTF-8."""
    counts, total, carry, words = np.zeros(64, np.int64), 0, [], []
    digest = xxhash.xxh64_intdigest

    def add(hashes: np.ndarray) -> None:
        nonlocal total
        total += len(hashes)
        if len(hashes) < 400:
            counts[:] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            octets = hashes.view(np.uint8).reshape(-1, 8)
            for k in range(8):
                counts[8 * k : 8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS

    for block in _word_blocks(data.lower()):
        words = carry + block
        if len(words) >= 3:
            add(np.array([digest(b"%b %b %b" % x, 42) for x in zip(words, words[1:], words[2:])], np.uint64))
        carry = words[-2:]
    if not total:
        if not words:
            return 0
        add(np.array([digest(b" ".join(words), 42)], np.uint64))
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


@F.arrow_udf(T.LongType())
def fingerprints(column: pa.Array) -> pa.Array:
    """Fingerprints as signed longs."""
    return pa.array(np.array([fingerprint(x) for x in texts(column)], np.uint64).view(np.int64))


def _halves(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, half, value, far): the values within ``radius`` (0 or 1) bits of each 32-bit half."""
    masks = [0] + ([1 << k for k in range(32)] if radius else [])
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    halves = F.array(F.struct(F.lit(0).alias("half"), low.alias("own")), F.struct(F.lit(1).alias("half"), high.alias("own")))
    out = prints.select("fp", F.explode(halves).alias("h")).select("fp", "h.half", "h.own")
    if not radius:
        return out.withColumnRenamed("own", "value")
    mask = F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))
    return out.select("fp", "half", "own", mask.alias("mask")).select("fp", "half", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between two sets of fingerprints; one row of comparisons is held at a time."""
    nodes = np.unique(np.concatenate([a, b]))
    label, right = np.arange(len(nodes)), nodes.view(np.uint64)
    out_a, out_b = [], []
    for i in np.searchsorted(nodes, np.unique(a)):
        near = np.nonzero(np.bitwise_count(right ^ right[i]) <= MAX_BITS)[0]
        others, at = np.unique(label[near], return_index=True)
        if len(others) > 1:
            for other, j in zip(others, near[at], strict=True):
                if other != label[i]:
                    out_a.append(int(nodes[i]))
                    out_b.append(int(nodes[j]))
            label[np.isin(label, others)] = label[i]
    return out_a, out_b


def _tile_links(key, frame: pd.DataFrame) -> pd.DataFrame:
    first, second = (frame.loc[frame.side == s, "fp"].to_numpy(np.int64) for s in (0, 1))
    a, b = _forest(first, second if len(second) else first)
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) of the distinct fingerprints ``prints`` (fp) that connect what MAX_BITS connects."""
    index = _halves(prints, 0)
    probes = _halves(prints, 1)
    size = index.groupBy("half", "value").agg(F.count(F.lit(1)).alias("n"))
    hot = materialize(size.where(F.col("n") > HOT), "simhash-hot")
    n_hot = hot.count()
    # by a shuffle whatever Spark thinks of the sizes: it takes the probes for as many rows as there are fingerprints
    near = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("i.fp"))) <= MAX_BITS
    same = (F.col("p.half") == F.col("i.half")) & (F.col("p.value") == F.col("i.value")) & (F.col("p.fp") < F.col("i.fp")) & near
    if n_hot:
        cold = index.join(hot, ["half", "value"], "left_anti")
        found = probes.alias("p").join(cold.alias("i").hint("shuffle_hash"), same).select(F.col("p.fp").alias("a"), F.col("i.fp").alias("b"))
        # whoever asks a hot value is compared with its members, tile by tile
        asking = probes.join(hot.select("half", "value"), ["half", "value"], "left_semi")
        tiles = F.greatest(F.lit(1), F.ceil(F.col("asked") / F.lit(TILE))).cast("int")
        asked = asking.groupBy("half", "value").agg(F.count(F.lit(1)).alias("asked")).select("half", "value", tiles.alias("tiles"))
        dealt = asking.join(asked, ["half", "value"]).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
        pairs = dealt.select("fp", "half", "value", "tile", other.alias("other")).select(
            "fp", "half", "value", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), (F.col("tile") > F.col("other")).cast("int").alias("side")
        )
        hot_links = pairs.groupBy("half", "value", "t1", "t2").applyInPandas(_tile_links, "a long, b long")
        found = found.unionByName(hot_links)
    else:
        found = probes.alias("p").join(index.alias("i").hint("shuffle_hash"), same).select(F.col("p.fp").alias("a"), F.col("i.fp").alias("b"))
    return found.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root: the component's smallest node.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): each links a node's neighbours to the smallest of
    them; they end when every node hangs on its root. Each round is a written table."""
    spark = edges.sparkSession
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "cc-edges")

    def signature(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "cc-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = materialize(small, "cc-small")
        after = signature(small)
        drop_table(edges)
        drop_table(large)
        edges, before, done = small, after, after == before
        if done:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct() if before[0] else spark.createDataFrame([], "node long, root long")


def cluster(marked: DataFrame) -> DataFrame:
    """(fp, root, component_id) of the fingerprints in ``marked`` (doc_id, fp): the smallest fingerprint and the smallest doc_id of the component."""
    prints = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-prints")
    roots = components(links(prints.select("fp")))
    per = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = per.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return per.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs`` (doc_id, text)."""
    marked = materialize(docs.select("doc_id", fingerprints(F.col("text")).alias("fp")), "simhash-docs")
    out = marked.join(cluster(marked), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component; rows are told apart by doc_id and text. Texts are read twice and
    never copied: what is written is keys and fingerprints."""
    key = free_name(docs, "_row_key")
    light = materialize(docs.select(row_key().alias("rk"), "doc_id", fingerprints(F.col("text")).alias("fp")), "simhash-marked")
    rows = light.join(cluster(light.select("doc_id", "fp")), "fp").groupBy("rk", "root").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    rows = materialize(rows, "simhash-rows")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")).alias("f")).select(F.col("f.rk").alias("rk"), F.lit(True).alias("stays"))
    rows = materialize(rows.join(first, "rk", "left").select("rk", "n", F.coalesce("stays", F.lit(False)).alias("stays")), "simhash-stays")
    gone = rows.where("not stays").select(F.col("rk").alias(key))
    kept = docs.withColumn(key, row_key()).join(small_side(gone, gone.count()), key, "left_anti")
    twice = rows.where("stays and n > 1").select(F.col("rk").alias(key))
    n_twice = twice.count()
    if not n_twice:
        return kept.drop(key)
    twice = small_side(twice, n_twice)
    packed = F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("r")
    one = kept.join(twice, key, "left_semi").groupBy(key).agg(packed).select("r.*")
    return kept.join(twice, key, "left_anti").drop(key).unionByName(one)


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
