"""Pattern matches with code-point offsets, all inside the JVM and inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import VALIDATORS, once
from ..functions.registry import PATTERNS

_OPEN, _CLOSE = "\u0001", "\u0002"


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct<s, e, match>> of a pattern's matches, left to right.

    Matches are wrapped in two control characters and the text is cut at the first: each piece but the first is a match and
    the gap after it, so a fold over the (few) pieces gives the positions."""
    return once(F.translate(text, _OPEN + _CLOSE, "  "), lambda clean: _spans_of(clean, pattern))


def _spans_of(clean: Column, pattern: str) -> Column:
    """spans_of() of a text without the two control characters."""
    kind = "array<struct<s:int,e:int,match:string>>"

    def step(acc: Column, piece: Column) -> Column:
        match = F.substring_index(piece, _CLOSE, 1)
        end = acc["at"] + F.length(match)
        one = F.struct(acc["at"].alias("s"), end.alias("e"), match.alias("match"))
        return F.struct((acc["at"] + F.length(piece) - 1).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def of(pieces: Column) -> Column:
        start = F.struct(F.length(F.element_at(pieces, 1)).alias("at"), F.array().cast(kind).alias("out"))
        return F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), start, step, lambda acc: acc["out"])

    def cut(marked: Column) -> Column:
        return F.when(F.contains(marked, F.lit(_OPEN)), once(F.split(marked, _OPEN), of)).when(marked.isNotNull(), F.array().cast(kind))

    return once(F.regexp_replace(clean, f"(?i){pattern}", f"{_OPEN}$0{_CLOSE}"), cut)


def with_matches(docs: DataFrame, text: str = "text", patterns=PATTERNS) -> DataFrame:
    """``docs`` with ``matches``: array<struct<priority, class, s, e, match, valid, force>> in order of (priority, s).

    Every pattern needs a digit or an at sign, so texts without either are not searched ten times. The matches are computed once, as the
    one element of an array that is exploded: Catalyst copies an expression, but not a generator, into what uses it."""
    source = F.coalesce(F.col(text), F.lit(""))

    def tagged(clean: Column, priority: int, cls: str, pattern: str, validator, force: bool) -> Column:
        return F.transform(
            _spans_of(clean, pattern),
            lambda m: F.struct(
                F.lit(priority).alias("priority"), F.lit(cls).alias("class"), m["s"].alias("s"), m["e"].alias("e"), m["match"].alias("match"), VALIDATORS[validator](m["match"]).alias("valid"), F.lit(force).alias("force")
            ),
        )

    kind = "array<struct<priority:int,class:string,s:int,e:int,match:string,valid:boolean,force:boolean>>"
    none = F.array().cast(kind)
    if not patterns:
        return docs.withColumn("matches", none)
    found = F.when(source.rlike("[0-9@]"), once(F.translate(source, _OPEN + _CLOSE, "  "), lambda clean: F.concat(*[tagged(clean, k, *p) for k, p in enumerate(patterns, 1)]))).otherwise(none)
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "matches"], F.explode_outer(F.array(found)).alias("matches"))


def matches(docs: DataFrame, key: str = "doc_id", text: str = "text", patterns=PATTERNS) -> DataFrame:
    """One row per match: key, priority, class, s, e, match, valid, force."""
    return exploded(with_matches(docs.select(key, text), text, patterns), F.col("matches"), key).select(key, "m.*")


def exploded(df: DataFrame, found: Column, *keep: str) -> DataFrame:
    """(keep, m): one row per element. Outer, then without nulls: of a plain explode Catalyst infers a filter on the array and
    computes the array, here the pattern search, once more for it."""
    return df.select(*keep, F.explode_outer(found).alias("m")).where("m is not null")


def hints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Validated matches in priority order."""
    return matches(docs, key, text).where("valid").select(key, "priority", "class", "s", "e")


def resolve(found: Column) -> Column:
    """Validated matches of which no two overlap: by priority, then place, the first to claim a range keeps it."""
    ordered = F.array_sort(F.transform(F.filter(found, lambda m: m["valid"]), lambda m: F.struct(m["priority"].alias("priority"), m["s"].alias("s"), m["e"].alias("e"), m["class"].alias("class"), m["match"].alias("match"))))
    start = F.array().cast("array<struct<priority:int,s:int,e:int,class:string,match:string>>")

    def step(acc: Column, m: Column) -> Column:
        taken = F.exists(acc, lambda o: (o["s"] < m["e"]) & (o["e"] > m["s"]))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(m)))

    by_place = F.transform(F.aggregate(ordered, start, step), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), m["class"].alias("class"), m["match"].alias("match")))
    return F.array_sort(by_place)


def redact(text: Column, spans: Column, mask: Column) -> Column:
    """``text`` with each of the disjoint, ordered ``spans`` (s, e, class) replaced; ``mask`` is a column or a function of the span's class."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        piece = mask(m["class"]) if callable(mask) else mask
        return F.struct(m["e"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, m["s"] - acc["at"]), piece).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])))
