"""Subwords of a model's own tokenizer with their places in the text, in windows that a model can read, and back."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.registry import STRIDE, WINDOW
from .tokens import bounded_batches, overlap_labels, parts, windows, word_tokens

#: A public tokenizer's file; every operator here takes a path.
DEFAULT = "/opt/tokenizers/word_bpe_49k.json"
_PIECES = T.ArrayType(T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("id", T.IntegerType()), T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))
#: Bytes of text that are encoded together: an encoding takes some hundred bytes a subword.
PART = 1 << 18
_loaded: dict = {}


def _tokenizer(path: str):
    """The tokenizer of a worker, read once."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def _pieces(encoded: list) -> pa.Array:
    """The encodings of some texts as lists of pieces, built column by column."""
    edges = np.cumsum([0, *(len(x.ids) for x in encoded)])
    ids = np.concatenate([np.zeros(0, np.int32), *(np.asarray(x.ids, np.int32) for x in encoded)])
    places = np.concatenate([np.zeros((0, 2), np.int32), *(np.asarray(x.offsets, np.int32).reshape(-1, 2) for x in encoded)])
    numbers = np.arange(len(ids)) - np.repeat(edges[:-1], np.diff(edges))
    columns = [pa.array(np.ascontiguousarray(x), pa.int32()) for x in (numbers, ids, places[:, 0], places[:, 1])]
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(columns, ["idx", "id", "s", "e"]))


def subwords(text: Column, path: str) -> Column:
    """array<struct<idx, id, s, e>>: the subwords of a whole text by the tokenizer file ``path``, without special tokens, offsets in code points."""

    @F.arrow_udf(_PIECES)
    def cut(column: pa.Array) -> pa.Array:
        lists = [_pieces(_tokenizer(path).encode_batch(texts, add_special_tokens=False)) for texts in parts(column, PART)]
        return pa.concat_arrays(lists) if lists else _pieces([])

    return cut(text)


def windowed(docs: DataFrame, path: str, key: str = "sample_id", size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """(key, window, first, stop, pieces): the subwords of ``docs`` (key, text) in windows of at most ``size``, a new one every ``stride``; first and
    stop are the places of the text that the window decides. Texts of ``size`` subwords or fewer are one window, empty ones none."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(key, subwords(F.col("text"), path).alias("_p"))
    # outer, then without nulls: of a filter before, or of a plain explode, Catalyst encodes the texts once more
    cut = F.when(F.size("_p") > 0, windows(F.size("_p"), size, stride))
    rows = rows.select(key, "_p", F.posexplode_outer(cut).alias("window", "_w")).where("window is not null")
    return rows.select(key, "window", F.col("_w.first").alias("first"), F.col("_w.stop").alias("stop"), F.slice("_p", F.col("_w.start") + 1, size).alias("pieces"))


def decided(windows_: DataFrame, label: Column | Callable[[Column], Column], key: str = "sample_id") -> DataFrame:
    """(key, idx, id, s, e, label): every subword once, with the label of the last window that decides it. ``label`` gives an array of labels for
    a window's pieces; the windows may have been judged anywhere, in any order."""
    labels = label(F.col("pieces")) if callable(label) else label
    rows = windows_.select(key, "window", "first", "stop", F.explode(F.arrays_zip("pieces", labels.alias("label"))).alias("x"))
    rows = rows.select(key, "window", "first", "stop", "x.pieces.*", "x.label").where((F.col("idx") >= F.col("first")) & (F.col("idx") < F.col("stop")))
    last = F.max_by(F.struct("id", "s", "e", "label"), "window").alias("x")
    return rows.groupBy(key, "idx").agg(last).select(key, "idx", "x.*")


def word_verdicts(docs: DataFrame, path: str, label, key: str = "sample_id", size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """(key, idx, s, e, label): the words of ``docs`` with the label of their first subword that isn't O, repaired."""
    pieces = decided(windowed(docs, path, key, size, stride), label, key)
    words = docs.select(key, F.explode(word_tokens(F.col("text"))).alias("w")).select(key, "w.idx", "w.s", "w.e")
    return overlap_labels(words, pieces, key=key)


def limits(windows_: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, n_windows, n_pieces, longest): how a text was cut."""
    return windows_.groupBy(key).agg(F.count(F.lit(1)).alias("n_windows"), F.max("stop").cast("long").alias("n_pieces"), F.max(F.size("pieces")).cast("long").alias("longest"))
