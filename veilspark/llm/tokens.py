"""Token ids in a grammar-compressed binary format (Re-Pair).

Texts are encoded by a tokenizer file of the ``tokenizers`` library. Words repeat, so each task keeps the ids of the words
it has met (words never join across white space in such a tokenizer; ``WordEncoder`` checks that it has this form and
falls back to whole texts otherwise). Ids travel in doc_id order to range partitions; each task packs its documents into
shards of about SHARD_IDS ids. In a shard, frequent pairs of ids are replaced by nonterminals round by round, a round taking
the pairs that occur at least a sixteenth as often as the most frequent one, until no pair occurs MIN_PAIR times. A shard holds the
rules, the expansion length of every nonterminal, the sequence, and a running length every STRIDE symbols, so that any id range
is decoded without the rest.

Null and empty texts are just the end id. Rows of one doc_id (repeated rows) keep an arbitrary but fixed order among
themselves; null doc_ids come first. An empty table gives no shards and no rows. Other columns are ignored.
"""

from __future__ import annotations

import codecs
import gc
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, read, small_side

END_ID = 2
SHARD_IDS = 1 << 19
#: Occurrences from which on a pair is replaced; slots in which pairs are counted.
MIN_PAIR, SLOTS = 64, 1 << 18
STRIDE = 1024
#: Bytes of a text that are cut into words at once.
BLOCK = 1 << 20
#: Words a task keeps.
CACHE = 250_000
MAGIC = b"RPR1"
#: Pieces of a lower-case word of Latin letters and printed ASCII, as the tokenizer's own pattern cuts it.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w]|_)+")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters that NFC leaves alone and whose lower case is one letter, whoever computes it (A to Z, U+00C0 to U+024F but the signs and
#: U+0130), perhaps before a full stop or comma; and words of these and printed ASCII.
_LATIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,]?)")
_PRINTED = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")


def _byte_alphabet() -> str:
    """By byte, the character that byte-level BPE writes for it: itself if printable in Latin-1, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    written = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return "".join(written[b] for b in range(256))


class _Known(dict):
    """Ids by word; a word met for the first time is encoded."""

    def __init__(self, encode, older: dict):
        self.encode, self.older = encode, older

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        self[word] = ids
        return ids


class WordEncoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False).ids`` does, word by word where that is the same."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        steps = [x.get("type") for x in ((spec["normalizer"] or {}).get("normalizers") or [])]
        cut = [x.get("type") for x in ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [])]
        special = [x["content"] for x in spec["added_tokens"]]
        # white space is dropped by the pre-tokenizer and no step joins what it separates
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and cut == ["Split", "ByteLevel"] and spec["model"]["type"] == "BPE"
        self.by_word = self.by_word and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": _SPLIT}
        self.by_word &= all(not x["lstrip"] and not x["rstrip"] and not x["single_word"] for x in spec["added_tokens"]) and all(x.startswith("<|") and not any(c.isspace() for c in x) for x in special)
        self.model, self.known = self.tokenizer.model, _Known(self._word, {})
        self.alphabet = _byte_alphabet()
        #: how an id is written
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.tails = {ord(c): self._ids(c) for c in ".,"} if self.by_word else {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _ids(self, piece: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _letters(self, body: bytes) -> bytes:
        """The ids of Latin letters in lower case, in UTF-8."""
        return self._ids(codecs.charmap_decode(body, "strict", self.alphabet)[0])

    def _piece(self, piece: str) -> bytes:
        """The ids of letters, a digit or symbols that the pre-tokenizer leaves together, in lower case."""
        data = piece.encode()
        ids = self.known.get(data)
        if ids is None:
            self.known[data] = ids = self._letters(data)
        return ids

    def _word(self, word: bytes) -> bytes:
        """Pieces of Latin letters and printed ASCII go straight to the model, in lower case."""
        if word.isalpha():
            return self._ids(word.lower().decode())
        tail = self.tails.get(word[-1])
        if tail and (body := word[:-1]).isalpha():
            return (self.known.get(body) or self._ids(body.lower().decode())) + tail
        if b"<|" in word:
            return self._encode(word.decode())
        text = word.decode()
        latin = _LATIN.fullmatch(text)
        if latin:
            if not tail:
                return self._letters(text.lower().encode())
            return (self.known.get(word[:-1]) or self._letters(latin[1].lower().encode())) + tail
        if _PRINTED.fullmatch(text):
            return b"".join(map(self._piece, _PIECES.findall(text.lower())))
        return self._encode(text)

    def encode(self, data: bytes) -> bytes:
        """The ids of a text in UTF-8, as little-endian unsigned integers of self.kind."""
        if not self.by_word:
            return self._encode(data.decode())
        # ASCII letters may be lowered first but before combining marks (U+0300 to U+037F), which NFC joins to some small letters
        # only, and in special tokens
        plain = b"<|" not in data and b"\xcc" not in data and b"\xcd" not in data
        out, at = [], 0
        while at < len(data):  # a block of a long text at a time
            end = at + BLOCK
            while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
                end += 1
            if len(self.known) > CACHE:  # the words of the last CACHE first meetings stay within reach
                self.known.older = {}
                self.known = _Known(self._word, self.known)
            block = data[at:end]
            out.append(b"".join(map(self.known.__getitem__, (block.lower() if plain else block).split())))
            at = end
        return b"".join(out)


def repair(seq: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, rules): rule k replaces the pair rules[k] by the symbol terminals + k; in the end no pair occurs MIN_PAIR times.

    A round throws the pairs into hash slots, counts one pair of each slot exactly, without sorting, and replaces those that
    occur at least a sixteenth as often as the most frequent one; pairs that share a slot with another have their turn under a later
    hash. Pairs are replaced left to right, never overlapping: of a run of positions that could all be replaced, every second one is."""
    seq, rules, n_rules, turn = seq.astype(np.uint32), [], 0, 0
    held, symbol = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32)
    while len(seq) > 1:
        # odd factors that differ from turn to turn
        slot = (seq[:-1] * np.uint32(0x9E3779B1 + 0x10932 * turn) + seq[1:] * np.uint32(0x85EBCA6B + 0x20C64 * turn)) >> np.uint32(14)
        turn += 1
        # a slot has at least as many as any of its pairs
        where = np.nonzero((np.bincount(slot, minlength=SLOTS) >= MIN_PAIR)[slot])[0]
        if not len(where):
            break
        slot = slot[where].astype(np.int64)
        pairs = (seq[where].astype(np.uint64) << np.uint64(32)) | seq[where + 1]
        held[slot] = pairs
        own = held[slot] == pairs
        counts = np.bincount(slot[own], minlength=SLOTS)
        most = int(counts.max())
        if most < MIN_PAIR:
            if np.unique(pairs, return_counts=True)[1].max() < MIN_PAIR:
                break
            continue
        chosen = np.nonzero(counts >= max(MIN_PAIR, most // 16))[0]
        symbol[chosen] = np.arange(len(chosen), dtype=np.int32)
        at = symbol[slot]
        symbol[chosen] = -1
        good = own & (at >= 0)
        hits, at = where[good], at[good]
        # in a run of neighbouring hits those at even distance from its start are replaced
        start = np.r_[True, hits[1:] != hits[:-1] + 1]
        first = np.maximum.accumulate(np.where(start, np.arange(len(hits)), 0))
        even = (np.arange(len(hits)) - first) % 2 == 0
        hits, at = hits[even], at[even]
        used = np.bincount(at, minlength=len(chosen)) >= 2
        hits, at = hits[used[at]], (np.cumsum(used) - 1)[at[used[at]]]
        seq[hits] = (terminals + n_rules + at).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[hits + 1] = False
        seq = seq[keep]
        chosen = held[chosen[used]]
        rules.append(np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        n_rules += len(chosen)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def lengths_of(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Expansion lengths of the nonterminals; rules only name earlier symbols."""
    out = np.ones(terminals + len(rules), np.uint32)
    at = 0
    while at < len(rules):
        end = at + 1
        inner = rules[at:].max(axis=1) < terminals + at
        end = at + (int(np.argmin(inner)) if not inner.all() else len(inner))
        end = max(end, at + 1)
        out[terminals + at : terminals + end] = out[rules[at:end, 0]] + out[rules[at:end, 1]]
        at = end
    return out


def pack(ids: np.ndarray) -> bytes:
    """A shard: magic, counts, then zstd sections: rules, expansion lengths, sequence, running length every STRIDE symbols."""
    terminals = int(ids.max()) + 1 if len(ids) else 1
    seq, rules = repair(ids, terminals)
    lengths = lengths_of(rules, terminals)
    running = np.r_[np.uint64(0), np.cumsum(lengths[seq], dtype=np.uint64)][::STRIDE]
    squeeze = zstandard.ZstdCompressor(level=1).compress
    wide = "<u4" if terminals + len(rules) > 65535 else "<u2"
    parts = [squeeze(x.tobytes()) for x in (rules.astype("<u4"), lengths[terminals:].astype("<u4"), seq.astype(wide), running.astype("<u8"))]
    return struct.pack("<4sIIQQB4Q", MAGIC, terminals, len(rules), len(seq), len(ids), int(wide[-1]), *map(len, parts)) + b"".join(parts)


class Shard:
    """Decodes a shard, whole or by range."""

    def __init__(self, data: bytes):
        size = struct.calcsize("<4sIIQQB4Q")
        magic, self.terminals, n_rules, n_seq, self.n_ids, width, *sizes = struct.unpack("<4sIIQQB4Q", data[:size])
        if magic != MAGIC:
            raise ValueError("not a shard")
        kinds, parts = ("<u4", "<u4", f"<u{width}", "<u8"), []
        for kind, n in zip(kinds, sizes, strict=True):
            parts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[size : size + n]), kind))
            size += n
        self.rules, self.lengths, self.seq, self.running = parts[0].reshape(n_rules, 2), parts[1], parts[2].astype(np.uint32), parts[3]
        if len(self.seq) != n_seq:
            raise ValueError("a section is cut off")

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        while len(at := np.nonzero(seq >= self.terminals)[0]):
            rule = self.rules[seq[at] - self.terminals]
            where = at + np.arange(len(at))
            out = np.empty(len(seq) + len(at), np.uint32)
            second = np.zeros(len(out), bool)
            second[where + 1] = True
            out[~second] = seq
            out[where], out[where + 1] = rule[:, 0], rule[:, 1]
            seq = out
        return seq

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids [start, stop): only the symbols that cover them are expanded."""
        stop = self.n_ids if stop is None else stop
        if start >= stop:
            return np.zeros(0, np.uint32)
        a = (int(np.searchsorted(self.running, start, "right")) - 1) * STRIDE
        b = min(len(self.seq), (int(np.searchsorted(self.running, stop, "left"))) * STRIDE)
        before = int(self.running[a // STRIDE])
        return self._expand(self.seq[a:b])[start - before : stop - before]


#: By file; a Python worker keeps them, and the words they know, for all its tasks.
_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _bytes(x: pa.Scalar) -> bytes:
    """One text in UTF-8, null as empty: texts of a batch are taken out one at a time."""
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def _encoder_udf(path: str):

    @F.arrow_udf(T.BinaryType())
    def encode(column: pa.Array) -> pa.Array:
        encoder = encoder_of(path)
        end = np.array([END_ID], encoder.kind).tobytes()
        # the first byte tells the bytes of an id
        width = encoder.kind[-1].encode().translate(bytes.maketrans(b"24", b"\2\4"))
        # words make no cycles: the collector would only walk through those that are known
        collecting = gc.isenabled()
        gc.disable()
        try:
            return pa.array([b"".join((width, encoder.encode(_bytes(x)), end)) for x in column], pa.binary())
        finally:
            if collecting:
                gc.enable()

    return encode


_SHARDS = "part int, seq int, before long, doc_ids array<long>, counts array<long>, n_ids long, data binary"


def _pack_shards(batches):
    _ENCODERS.clear()  # all texts are encoded: a worker's memory of words isn't needed any more
    part = TaskContext.get().partitionId()
    seq = before = 0
    doc_ids: list = []
    chunks: list = []
    size = 0

    def flush():
        nonlocal seq, before, doc_ids, chunks, size
        counts = [len(x) for x in chunks]
        row = [[part], [seq], [before], [doc_ids], [counts], [size], [pack(np.concatenate(chunks))]]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary())
        seq, before, doc_ids, chunks, size = seq + 1, before + size, [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], [x.split()[0] for x in _SHARDS.split(", ")])

    for batch in batches:
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            chunks.append(np.frombuffer(raw, "<u2" if raw[0] == 2 else "<u4", offset=1).astype(np.uint32))
            doc_ids.append(doc_id)
            size += len(chunks[-1])
            if size >= SHARD_IDS:
                yield flush()
    if chunks:
        yield flush()


def encode_shards(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The shards of ``docs`` (doc_id, text) in doc_id order: (part, seq) order them, ``before`` counts the part's ids before a shard."""
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select("doc_id", _encoder_udf(tokenizer_path)(F.col("text")).alias("ids"))
    ids = materialize(ids, "token-ids")
    return ids.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32("ids")).mapInArrow(_pack_shards, _SHARDS)


_DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read_shards(batches):
    for batch in batches:
        for data, doc_ids, counts, first in zip(*(batch.column(k).to_pylist() for k in ("data", "doc_ids", "counts", "first")), strict=True):
            ids = Shard(data).ids().astype("<u4", copy=False)
            ends = np.cumsum(counts)
            crcs = [zlib.crc32(ids[e - n : e]) for n, e in zip(counts, ends, strict=True)]
            starts = first + ends - counts
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], [x.split()[0] for x in _DOCS.split(", ")])


def decode_shards(shards: DataFrame) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    from pyspark.sql.window import Window as W

    # one row per part, as many as the range partitioning has
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    n_parts = shards.sparkSession.conf.get("spark.sql.shuffle.partitions")
    joined = shards.join(small_side(parts, int(n_parts)), "part").withColumn("first", F.col("offset") + F.col("before"))
    return joined.select("doc_ids", "counts", "data", "first").mapInArrow(_read_shards, _DOCS)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_tokens(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Writes the shards of ``docs`` and returns what the files say of each document."""
    return decode_shards(materialize(encode_shards(docs, tokenizer_path or default_tokenizer()), "token-shards"))


def tokens_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_tokens(read(spark, sf_dir, "documents"))
