"""Repeated byte strings by a hash-compared suffix sort.

Every window of MATCH bytes has an anchor, its leftmost K-byte string of smallest hash; occurrences of one window have the
same anchor at the same place. So only anchors meet: those with equal K bytes. What can matter to an anchor is its context,
from REACH bytes before it to MATCH bytes after its start, within its text.

A context that occurs twice, by 64 bits of XXH3 of its bytes beside the key, is repeated as a whole. Of the others, the suffixes (from the anchor on) and the reversed
prefixes are sorted by mergesort: two of them compare by a binary search for their common extension over prefix polynomial
hashes, then by one byte. The common extensions of neighbours are checked byte by byte; if a hash lied, the rows are sorted
by their bytes instead. For every offset of a window around the anchor, neighbours whose extensions reach far enough form
classes on either side, and windows with both classes in common are equal; classes only change at the extensions that
occur, so an anchor group costs its size times those.

Keys with more than HOT distinct contexts don't meet in one task: their windows are exchanged one by one, by 128-bit hashes
that each group sends once, beside the contexts to sort.

What is repeated is cut at every place, the first included, so n_removed can't tell a text that repeats an earlier one from the one it was
taken from. n_repeat_bytes does: it counts the bytes covered by windows that also start earlier, in a row of smaller doc_id (null: after all
others; rows of one doc_id by the MD5 of their texts, equal rows as one) or further to the left. So contexts and windows carry the place where they occur first, and the
first holder of a context that occurs twice compares it with the other contexts of its key all the same.

Defined results: null text has no bytes; every row counts as a text of its own, so repeated rows are repeats of each other.
Texts of fewer than MATCH bytes lose nothing. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, materialize, read, small_side
from .textgroups import BYTE_POWERS, BYTE_VALUES, WORD_POWERS, Groups, Prefix, bucket_of, cut, mix, parts

MATCH, K = 400, 100
REACH = MATCH - K
#: Contexts of a key that are sorted in one task.
HOT = 2_000
#: Rows sorted at once, but for the contexts of one key.
ROWS = 4096
#: Bytes whose hashes are held at once, at most 2^24 - MATCH.
BLOCK = 1 << 20
_U = np.uint64
_POSITION = _U((1 << 24) - 1)
_SECOND = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of every ``width`` neighbours: the lesser of a running minimum from the left and one from the right, restarted every ``width``."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, ~_U(0), np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _context_hashes(data: bytes, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """XXH3 of the bytes of each context, seeded by where the anchor is in it: a context that occurs twice is removed without another
    look at its bytes, and polynomials modulo a power of two collide on Thue-Morse words."""
    each = zip((at - left).tolist(), (at + right).tolist(), (left * 1024 + right).tolist(), strict=True)
    return np.fromiter((xxhash.xxh3_64_intdigest(data[a:b], seed) for a, b, seed in each), np.uint64, len(at))


class Anchors:
    """Anchors of the texts of a group, in order: text, at (byte of the text), left, right (bytes of context), key, context."""

    def __init__(self, all_texts: list[bytes], block: int):
        parts = []
        at = 0
        while at < len(all_texts):
            end, size = at, 0
            while end < len(all_texts) and (end == at or size + len(all_texts[end]) <= block):
                size += len(all_texts[end])
                end += 1
            # a very long text is looked at in pieces that overlap by a context on either side
            piece = block if end == at + 1 else size
            for start in range(0, max(1, size), max(1, piece)):
                parts.append(self._block(all_texts[at:end], at, start, piece))
            at = end
        self.text, self.at, self.left, self.right, self.key, self.context = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
        # a window start in two pieces can give an anchor twice
        if len(self.text) > 1:
            order = np.lexsort((self.at, self.text))
            new = np.r_[True, (np.diff(self.text[order]) != 0) | (np.diff(self.at[order]) != 0)]
            self._take(order[new])

    def _take(self, at) -> None:
        self.text, self.at, self.left, self.right, self.key, self.context = (x[at] for x in (self.text, self.at, self.left, self.right, self.key, self.context))

    @staticmethod
    def _block(block: list[bytes], number: int, start: int, piece: int):
        """Anchors of the windows that start in bytes [start, start + piece) of the joined texts."""
        offsets = np.cumsum([0, *map(len, block)])
        low, high = max(0, start - REACH), min(int(offsets[-1]), start + piece + MATCH + REACH + MATCH)
        data = b"".join(block)[low:high] if len(block) > 1 else block[0][low:high]
        none = tuple([np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2)
        if len(data) < MATCH:
            return none
        prefix = Prefix(BYTE_VALUES[np.frombuffer(data, np.uint8)], BYTE_POWERS)
        index = np.arange(len(data) - K + 1)
        hashes = prefix.of(index, index + K)
        least = _sliding_min((hashes & ~_POSITION) | index.astype(np.uint64), REACH + 1)
        # windows within one text, starting in the piece
        first = np.arange(len(least)) + low
        text = np.searchsorted(offsets, first, "right") - 1
        valid = (first + MATCH <= offsets[text + 1]) & (first >= start) & (first < start + piece)
        at = np.unique((least[valid] & _POSITION).astype(np.int64))
        text = np.searchsorted(offsets, at + low, "right") - 1
        left = np.minimum(REACH, at + low - offsets[text])
        right = np.minimum(MATCH, offsets[text + 1] - at - low)
        context = _context_hashes(data, at, left, right)
        return text + number, at + low - offsets[text], left, right, hashes[at], context


def _table(schema: pa.Schema, rows: list) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


_ANCHORS = pa.schema([("g", pa.int64()), ("key", pa.int64()), ("context", pa.int64()), ("n", pa.int64()), ("first_id", pa.int64()), ("tie", pa.int64())])
#: States of a (key, context): it is repeated as a whole; it is to be sent for sorting; its windows are to be sent; the group has its first occurrence.
FULL, SEND, SEND_WINDOWS, FIRST = 1, 2, 4, 8


def _places(keys: list[bytes], ids: list[int]) -> np.ndarray:
    """(first_id, tie) of each text: texts are in this order, within a group and between groups."""
    ties = [int.from_bytes(k[:8].ljust(8, b"\0"), "big") - (1 << 63) for k in keys]
    return np.array([ids, ties], np.int64).reshape(2, -1).T


def _send_keys(block: int):
    """Distinct (key, context) of a group as rows, how often the group has them and the first of its texts that does."""

    def run(g, keys, ids, data):
        a = Anchors(data, block)
        order = np.lexsort((a.context, a.key))
        key, context = a.key[order], a.context[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (context[1:] != context[:-1])] if len(key) else np.zeros(0, bool)
        at = np.nonzero(new)[0]
        n = np.diff(np.r_[at, len(key)])
        first = _places(keys, ids)[a.text[order][at]]
        columns = [np.full(len(at), g if g is not None else 0), key[at].view(np.int64), context[at].view(np.int64), n, first[:, 0], first[:, 1]]
        return pa.table([pa.array(c) for c in columns], _ANCHORS)

    return run


def states(anchors: DataFrame, most: int) -> DataFrame:
    """(g, key, context, state) of what each group has to do with its ``anchors`` (g, key, context, n, first_id, tie): nothing comes back for keys that
    occur once. Contexts are counted first, then the contexts of a key, both with partial sums on the map side; so a key that
    many texts have is spread over all tasks but for one row a task, and the join back has one row a key on its other side."""
    per = materialize(anchors.groupBy("key", "context").agg(F.sum("n").alias("n"), F.min(F.struct("first_id", "tie")).alias("least")), "suffixes-contexts")
    of_key = per.groupBy("key").agg(F.count(F.lit(1)).alias("contexts"))
    mixed = F.col("contexts") > 1
    # written first: an aggregation and the join in one stage would keep AQE from splitting a key's rows
    of_key = materialize(of_key.where(mixed).select("key", (F.col("contexts") > most).alias("hot")), "suffixes-keys")
    per = per.join(small_side(of_key, of_key.count()), "key", "left").where("n > 1 or hot is not null")
    full, hot = F.col("n") > 1, F.coalesce(F.col("hot"), F.lit(False))
    # one group sends a context for sorting: the one with its first occurrence
    per = per.select("key", "context", "least", full.alias("full"), (full.cast("int") * FULL + hot.cast("int") * SEND_WINDOWS).alias("base"), (F.col("hot").isNotNull() & ~hot).alias("sorted"))
    out = anchors.select("g", "key", "context", "first_id", "tie").join(per, ["key", "context"])
    first = (F.col("first_id") == F.col("least.first_id")) & (F.col("tie") == F.col("least.tie"))
    state = F.col("base") + (F.col("sorted") & first).cast("int") * SEND + (F.col("full") & first).cast("int") * FIRST
    return out.select("g", "key", "context", state.cast("long").alias("state")).where("state > 0")


def _runs(*columns) -> np.ndarray:
    """Number of the run of equal rows that each row of sorted columns is in."""
    change = np.zeros(len(columns[0]), bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.cumsum(change)


def _said(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, contexts, states) of rows of states()."""
    return *(rows[c].to_numpy().view(np.uint64) for c in ("key", "context")), rows["state"].to_numpy()


def _finder(keys, contexts, states):
    """A function that gives the state of each (key, context), 0 where none is said."""
    said = mix(keys ^ mix(contexts))
    order = np.argsort(said, kind="stable")
    said = said[order]

    def find(key, context) -> np.ndarray:
        if not len(said):
            return np.zeros(len(key), np.int64)
        at = order[np.minimum(np.searchsorted(said, mix(key ^ mix(context))), len(said) - 1)]
        return np.where((keys[at] == key) & (contexts[at] == context), states[at], 0).astype(np.int64)

    return find


def _find(key, context, keys, contexts, states) -> np.ndarray:
    return _finder(keys, contexts, states)(key, context)


#: What groups send: contexts (kind 1), or windows around hot anchors (kind 2: two hashes, and in ``lengths`` whether the group has it twice).
_SENT = pa.schema([("b", pa.int64()), ("kind", pa.int64()), ("g", pa.int64()), ("keys", pa.binary()), ("contexts", pa.binary()), ("lengths", pa.binary()), ("places", pa.binary()), ("bytes", pa.binary())])


def _send_contexts(n: int, block: int):
    import zstandard

    def run(g, keys, ids, data, said):
        if not data or not len(said):
            return _table(_SENT, [])
        a = Anchors(data, block)
        k, c, s = _said(said)
        state, places = _find(a.key, a.context, k, c, s), _places(keys, ids)
        windows = _windows(a, np.nonzero(state & SEND_WINDOWS)[0], data, places, g, n)
        a._take(np.nonzero(state & SEND)[0])
        order = np.lexsort((a.context, a.key))
        a._take(order)
        a._take(np.nonzero(np.r_[True, (a.key[1:] != a.key[:-1]) | (a.context[1:] != a.context[:-1])])[0] if len(order) else order)
        # keys are minima, all in the lowest buckets unless mixed again
        buckets = bucket_of(mix(a.key), n)
        order = np.argsort(buckets, kind="stable")
        a._take(order)
        pack, out = zstandard.ZstdCompressor(level=1).compress, []
        for b, part in cut(buckets[order], n):
            raw = b"".join(data[t][p - left : p + right] for t, p, left, right in zip(a.text[part].tolist(), a.at[part].tolist(), a.left[part].tolist(), a.right[part].tolist(), strict=True))
            lengths = np.stack([a.left[part], a.right[part]], 1).astype(np.uint16)
            first = np.c_[places[a.text[part]], a.at[part]]
            out.append((b, 1, g, a.key[part].tobytes(), a.context[part].tobytes(), lengths.tobytes(), first.tobytes(), pack(raw)))
        return _table(_SENT, out + windows)

    return run


class Suffixes:
    """Byte strings (rows of a matrix, padded) with prefix polynomial hashes, sorted within groups."""

    def __init__(self, rows: np.ndarray, lengths: np.ndarray, group: np.ndarray):
        self.rows, self.lengths, self.group = rows, lengths, group
        BYTE_POWERS.need(rows.shape[1] + 1)
        self.hashes = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
        np.cumsum(BYTE_VALUES[rows] * BYTE_POWERS.up[: rows.shape[1]], axis=1, out=self.hashes[:, 1:])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix, by binary search over the prefix hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.lengths[i], self.lengths[j]).astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.hashes[i, middle] == self.hashes[j, middle]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether row i sorts before row j, an end before any byte, equal rows by number."""
        n = self.common(i, j)
        a = np.where(n < self.lengths[i], self.rows[i, np.minimum(n, self.rows.shape[1] - 1)].astype(np.int64), -1)
        b = np.where(n < self.lengths[j], self.rows[j, np.minimum(n, self.rows.shape[1] - 1)].astype(np.int64), -1)
        return np.where(self.group[i] != self.group[j], self.group[i] < self.group[j], np.where(a != b, a < b, i < j))

    def order(self) -> np.ndarray:
        """Mergesort from below: every row finds its place in the run beside its own by binary search, all rows at once."""
        n = len(self.rows)
        order, width = np.arange(n), 1
        while width < n:
            place = np.arange(n)
            run = place // width
            other = np.where(run % 2 == 0, run + 1, run - 1) * width
            low, high = np.minimum(other, n), np.minimum(other + width, n)
            start = low.copy()
            while (low < high).any():
                middle = np.minimum((low + high) // 2, n - 1)
                less = self.before(order[middle], order) & (low < high)
                low, high = np.where(less, middle + 1, low), np.where(less | (low >= high), high, middle)
            target = (run // 2 * 2) * width + (place - run * width) + (low - start)
            merged = np.empty(n, np.int64)
            merged[target] = order
            order, width = merged, 2 * width
        return order

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """(order, common prefix of each row with the one before it in the order; -1 for the first of a group)."""
        order = self.order()
        common = self.common(order[:-1], order[1:])
        limit = np.minimum(self.lengths[order[:-1]], self.lengths[order[1:]])
        differ = (self.rows[order[:-1]] != self.rows[order[1:]]) | (np.arange(self.rows.shape[1]) >= limit[:, None])
        exact = np.where(differ.any(axis=1), differ.argmax(axis=1), self.rows.shape[1])
        same = self.group[order[:-1]] == self.group[order[1:]]
        if (exact != common)[same].any():  # two strings with one hash
            columns = [np.where(np.arange(self.rows.shape[1]) < self.lengths[:, None], self.rows.astype(np.int16), -1)[:, k] for k in range(self.rows.shape[1])]
            order = np.lexsort((*columns[::-1], self.group))
            limit = np.minimum(self.lengths[order[:-1]], self.lengths[order[1:]])
            differ = (self.rows[order[:-1]] != self.rows[order[1:]]) | (np.arange(self.rows.shape[1]) >= limit[:, None])
            exact = np.where(differ.any(axis=1), differ.argmax(axis=1), self.rows.shape[1])
            same = self.group[order[:-1]] == self.group[order[1:]]
        return order, np.r_[-1, np.where(same, exact, -1)] if len(order) else exact


def _covers(prefix_order, prefix_common, suffix_order, suffix_common, rank) -> np.ndarray:
    """Rows before, after: bytes around the anchor that windows in common with another row cover, for the rows of one key; then the same
    for windows in common with a row of lower ``rank``."""
    n = len(prefix_order)
    out = np.zeros((4, n), np.int64)
    by_rank = np.argsort(rank)
    # offsets of the anchor in a window, cut where a class changes
    steps = np.unique(np.r_[0, REACH + 1, prefix_common[1:] + 1, MATCH - suffix_common[1:]])
    steps = steps[(steps >= 0) & (steps <= REACH + 1)]
    for low, high in zip(steps[:-1].tolist(), (steps[1:] - 1).tolist(), strict=True):
        p, s = np.empty(n, np.int64), np.empty(n, np.int64)
        p[prefix_order] = np.cumsum(prefix_common < low)
        s[suffix_order] = np.cumsum(suffix_common < MATCH - low)
        both = (p * (n + 1) + s)[by_rank]
        _, first, inverse, counts = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
        for k, which in ((0, counts[inverse] > 1), (2, first[inverse] != np.arange(n))):
            at = by_rank[which]
            out[k, at] = np.maximum(out[k, at], high)
            out[k + 1, at] = np.maximum(out[k + 1, at], MATCH - low)
    return out


def covers(rights, lefts, group, rank) -> np.ndarray:
    """_covers() of contexts given as suffixes ``rights`` and reversed prefixes ``lefts`` (Suffixes) of the keys ``group``, in order of group."""
    suffix_order, suffix_common = rights.sorted()
    prefix_order, prefix_common = lefts.sorted()
    out = np.zeros((4, len(group)), np.int64)
    edges = np.r_[np.nonzero(np.r_[True, group[1:] != group[:-1]])[0], len(group)]
    sizes = np.diff(edges)
    # pairs at once
    two = edges[:-1][sizes == 2]
    left, right = np.minimum(prefix_common[two + 1], REACH), suffix_common[two + 1]
    good = left + right >= MATCH
    for k in (0, 1):
        later = good & (rank[two + k] > rank[two + 1 - k])
        out[:, two + k] = np.where(good, left, 0), np.where(good, right, 0), np.where(later, left, 0), np.where(later, right, 0)
    for a, size in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        part = slice(a, a + size)
        out[:, part] = _covers(prefix_order[part] - a, prefix_common[part], suffix_order[part] - a, suffix_common[part], rank[part])
    return out


_COVER = pa.schema([("g", pa.int64()), ("kind", pa.int64()), ("keys", pa.binary()), ("contexts", pa.binary()), ("cover", pa.binary())])


def _sort_contexts(table: pa.Table) -> pa.Table:
    import zstandard

    groups, keys, contexts, lengths, places, raw = (table[c].to_pylist() for c in ("g", "keys", "contexts", "lengths", "places", "bytes"))
    keys = [np.frombuffer(x, np.uint64) for x in keys]
    g = np.repeat(np.array(groups, np.int64), [len(x) for x in keys])
    key, context = np.concatenate(keys), np.concatenate([np.frombuffer(x, np.uint64) for x in contexts])
    lengths = np.concatenate([np.frombuffer(x, np.uint16) for x in lengths]).reshape(-1, 2).astype(np.int64)
    places = np.concatenate([np.frombuffer(x, np.int64) for x in places]).reshape(-1, 3)
    rank = np.empty(len(key), np.int64)
    rank[np.lexsort(places.T[::-1])] = np.arange(len(key))
    data = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(x) for x in raw), np.uint8)
    start = np.r_[0, np.cumsum(lengths.sum(axis=1))]
    order = np.argsort(key, kind="stable")
    key_run = _runs(key[order])
    cover = np.zeros((len(key), 4), np.uint16)
    edges = np.r_[np.nonzero(np.r_[True, np.diff(key_run) > 0])[0], len(order)]
    at = 0
    while at < len(order):  # whole keys, about ROWS rows
        end = int(edges[np.searchsorted(edges, min(at + ROWS, len(order)), "left")])
        part = order[at:end]
        left, right = lengths[part, 0], lengths[part, 1]
        middle = start[part] + left
        columns = np.arange(MATCH)
        rights = np.where(columns < right[:, None], data[np.minimum(middle[:, None] + columns, len(data) - 1)], 0).astype(np.uint8)
        columns = np.arange(REACH)
        lefts = np.where(columns < left[:, None], data[np.maximum(middle[:, None] - 1 - columns, 0)], 0).astype(np.uint8)
        run = key_run[at:end]
        cover[part] = covers(Suffixes(rights, right, run), Suffixes(lefts, left, run), run, rank[part]).T
        at = end
    found = np.nonzero(cover[:, 1])[0]
    found = found[np.argsort(g[found], kind="stable")]
    g, key, context, cover = g[found], key[found], context[found], cover[found]
    return _table(_COVER, [(k, 1, key[s].tobytes(), context[s].tobytes(), cover[s].tobytes()) for k, s in parts(g)])


def _hot_windows(a: Anchors, hot: np.ndarray, data: list[bytes]):
    """(anchor, offset of the anchor, two hashes) of all windows around the anchors ``hot``."""
    for k in hot.tolist():
        left, right, at = int(a.left[k]), int(a.right[k]), int(a.at[k])
        offsets = np.arange(max(0, MATCH - right), left + 1)
        if not len(offsets):
            continue
        raw = np.frombuffer(data[a.text[k]][at - left : at + right], np.uint8)
        begin = left - offsets
        yield k, offsets, Prefix(BYTE_VALUES[raw], BYTE_POWERS).of(begin, begin + MATCH), Prefix(_SECOND[raw], WORD_POWERS).of(begin, begin + MATCH)


def _windows(a: Anchors, hot: np.ndarray, data: list[bytes], places: np.ndarray, g: int, n: int) -> list[tuple]:
    """Rows of _SENT: the distinct windows around the anchors ``hot``."""
    parts = [(np.full(len(offsets), a.text[k]), a.at[k] - offsets, h1, h2) for k, offsets, h1, h2 in _hot_windows(a, hot, data)]
    if not parts:
        return []
    text, start, h1, h2 = (np.concatenate(x) for x in zip(*parts, strict=True))
    # a window around several hot anchors is still one occurrence
    order = np.lexsort((start, text))
    text, start, h1, h2 = text[order], start[order], h1[order], h2[order]
    own = np.r_[True, (text[1:] != text[:-1]) | (start[1:] != start[:-1])]
    h1, h2 = h1[own], h2[own]
    order = np.lexsort((h2, h1))
    h1, h2 = h1[order], h2[order]
    at = np.nonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])[0]
    more = (np.diff(np.r_[at, len(h1)]) > 1).astype(np.uint8)
    first = places[text[own][order][at]]
    h1, h2 = h1[at], h2[at]
    return [(b, 2, g, h1[s].tobytes(), h2[s].tobytes(), more[s].tobytes(), first[s].tobytes(), b"") for b, s in cut(bucket_of(h1, n), n)]


def _repeated_windows(table: pa.Table) -> pa.Table:
    h1, h2, more, places = (np.concatenate([np.frombuffer(x, t) for x in table[c].to_pylist()]) for c, t in (("keys", np.uint64), ("contexts", np.uint64), ("lengths", np.uint8), ("places", np.int64)))
    g = np.repeat(np.array(table["g"].to_pylist(), np.int64), [len(x) // 8 for x in table["keys"].to_pylist()])
    first_id, tie = places.reshape(-1, 2).T
    order = np.lexsort((tie, first_id, h2, h1))
    g, h1, h2, more = g[order], h1[order], h2[order], more[order]
    run = _runs(h1, h2)
    first = np.r_[True, run[1:] != run[:-1]]
    said = (np.bincount(run, 1 + (more > 0)) > 1)[run]
    g, h1, h2, first = g[said], h1[said], h2[said], first[said]
    order = np.argsort(g, kind="stable")
    g, h1, h2, first = g[order], h1[order], h2[order], first[order].astype(np.uint8)
    return _table(_COVER, [(k, 2, h1[s].tobytes(), h2[s].tobytes(), first[s].tobytes()) for k, s in parts(g)])


def _meet(table: pa.Table) -> pa.Table:
    """What the contexts and windows of a bucket say to their groups."""
    kinds = table["kind"].to_numpy()
    rows = [(answer, table.filter(pa.array(kinds == kind))) for kind, answer in ((1, _sort_contexts), (2, _repeated_windows))]
    return pa.concat_tables([answer(x) for answer, x in rows if len(x)])


def _first_here(*columns) -> np.ndarray:
    """Whether each row is the first with its values."""
    out = np.zeros(len(columns[0]), bool)
    order = np.lexsort(columns)
    run = _runs(*(c[order] for c in columns))
    out[order[np.r_[True, run[1:] != run[:-1]][: len(order)]]] = True
    return out


def _again(a: Anchors, hot: np.ndarray, data: list[bytes], windows: pa.Table):
    """(anchor, offsets, whether each also starts earlier) of the windows around ``hot`` that _repeated_windows() told of."""
    h1, h2 = (np.concatenate([np.frombuffer(x, np.uint64) for x in windows[c].to_pylist()]) for c in ("keys", "contexts"))
    first = np.concatenate([np.frombuffer(x, np.uint8) for x in windows["cover"].to_pylist()]) > 0
    find, base = _finder(h1, h2, np.arange(1, len(h1) + 1)), np.cumsum([0, *map(len, data)])
    # of the group that has a window first, all its occurrences but one are later: one turn to find it, one to tell
    least = np.full(len(h1), np.iinfo(np.int64).max)
    for turn in (1, 2):
        for k, offsets, w1, w2 in _hot_windows(a, hot, data):
            at = find(w1, w2) - 1
            offsets, at = offsets[at >= 0], at[at >= 0]
            place = base[a.text[k]] + a.at[k] - offsets
            if turn == 1:
                np.minimum.at(least, at, place)
            elif len(at):
                yield k, offsets, ~first[at] | (place != least[at])


def _lengths_of_unions(text: np.ndarray, start: np.ndarray, stop: np.ndarray, sizes: list[int]) -> list[int]:
    """Bytes of each text, of which ``sizes`` are the lengths, that intervals cover."""
    base = np.cumsum([0, *sizes])[text]
    order = np.argsort(base + start, kind="stable")
    start, stop, text = (base + start)[order], (base + stop)[order], text[order]
    before = np.r_[0, np.maximum.accumulate(stop)[:-1]][: len(stop)]
    return np.bincount(text, np.maximum(0, stop - np.maximum(start, before)), len(sizes)).astype(np.int64).tolist()


_RESULT = pa.schema([("key", pa.binary()), ("text_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_repeat_bytes", pa.int64()), ("kept", pa.binary())])


def _remove(with_bytes: bool, block: int):
    def run(g, keys, ids, data, said):
        if not data:
            return _table(_RESULT, [])
        spans: list[list] = [[] for _ in data]
        repeats = [0] * len(data)
        if len(said):
            a = Anchors(data, block)
            kinds = np.array(said["kind"].to_pylist())
            full = said.filter(pa.array(kinds == 0))  # rows of states()
            # bytes around the anchor that are repeated anywhere, and earlier
            before, after, left, right = np.zeros((4, len(a.key)), np.int64)
            hot = whole = later = np.zeros(len(a.key), bool)
            if len(full):
                k, c, s = _said(full)
                state = _find(a.key, a.context, k, c, s)
                whole = (state & FULL) > 0
                later = whole & ~((state & FIRST > 0) & _first_here(a.context, a.key))
                before[whole], after[whole] = a.left[whole], a.right[whole]
                left[later], right[later] = a.left[later], a.right[later]
                hot = ((state & SEND_WINDOWS) > 0) & ~later
            part = said.filter(pa.array(kinds == 1))
            if len(part):
                k, c = (np.concatenate([np.frombuffer(x, np.uint64) for x in part[n].to_pylist()]) for n in ("keys", "contexts"))
                cover = np.concatenate([np.frombuffer(x, np.uint16) for x in part["cover"].to_pylist()]).reshape(-1, 4).astype(np.int64)
                at = _find(a.key, a.context, k, c, np.arange(1, len(k) + 1)) - 1
                got = (at >= 0) & ~whole
                before[got], after[got] = cover[at[got], :2].T
                got = (at >= 0) & ~later
                left[got], right[got] = cover[at[got], 2:].T
            windows = said.filter(pa.array(kinds == 2))
            if hot.any() and len(windows):
                for k, offsets, earlier in _again(a, np.nonzero(hot)[0], data, windows):
                    if not whole[k]:
                        before[k], after[k] = offsets.max(), MATCH - offsets.min()
                    if earlier.any():
                        left[k], right[k] = offsets[earlier].max(), MATCH - offsets[earlier].min()
            for k in np.nonzero(after)[0].tolist():
                spans[a.text[k]].append((int(a.at[k] - before[k]), int(a.at[k] + after[k])))
            at = np.nonzero(right)[0]
            repeats = _lengths_of_unions(a.text[at], a.at[at] - left[at], a.at[at] + right[at], [len(x) for x in data])
        out = []
        for key, text_id, text, found, repeat in zip(keys, ids, data, spans, repeats, strict=True):
            kept, at, runs, removed = [], 0, 0, 0
            end = -1
            for x, y in sorted(found):
                if x > end:
                    runs += 1
                    kept.append(text[max(at, 0) : x])
                    removed += y - x
                    at = end = y
                elif y > end:
                    removed += y - end
                    at = end = y
            kept.append(text[at:])
            rest = b"".join(kept)
            out.append((key, text_id, len(text), removed, runs, hashlib.sha256(rest).hexdigest(), repeat, rest if with_bytes else None))
        return _table(_RESULT, out)

    return run


def remove_repeats(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeat_bytes per row of ``docs`` (doc_id, text); ``with_bytes``: kept, too."""
    groups = Groups(docs, "suffixes")
    n = groups.buckets
    anchors = materialize(groups.look(_send_keys(BLOCK), _ddl(_ANCHORS)), "suffixes-anchors")
    stated = materialize(states(anchors, HOT), "suffixes-states")
    sent = groups.look_with(stated, _send_contexts(n, BLOCK), _ddl(_SENT))
    covers_ = sent.groupBy("b").applyInArrow(_meet, _ddl(_COVER))
    none = F.lit(None)
    said = stated.select("g", F.lit(0).cast("long").alias("kind"), "key", "context", "state", *[none.cast("binary").alias(c) for c in ("keys", "contexts", "cover")])
    said = said.unionByName(covers_.select("*", *[none.cast("long").alias(c) for c in ("key", "context", "state")]))
    per_text = materialize(groups.look_with(said, _remove(with_bytes, BLOCK), _ddl(_RESULT)), "suffixes-texts")
    groups.close()
    drop_table(anchors)
    copies = groups.rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    per_text = per_text.join(copies, "key", "left")
    gone = F.col("copies").isNotNull() & (F.col("n_bytes") >= MATCH)
    empty = hashlib.sha256(b"").hexdigest()
    per_text = per_text.select(
        "key", "text_id", "n_repeat_bytes", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(gone, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(gone, F.lit(empty)).otherwise(F.col("kept_sha256")).alias("kept_sha256"), F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
    # a later copy of a whole text: all its windows are in the first copy
    copy = (F.col("first_id") != F.col("text_id")) & (F.col("n_bytes") >= MATCH)
    repeats = F.when(copy, F.col("n_bytes")).otherwise(F.col("n_repeat_bytes")).alias("n_repeat_bytes")
    return groups.rows.select("doc_id", "first_id", "key").join(per_text, "key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", repeats, *["kept"] * with_bytes)


def suffix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))
