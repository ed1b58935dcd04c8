"""Column functions: checksums, labels, uncertainty, contexts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# --- checksums ---------------------------------------------------------------------------------
def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def luhn(text: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten; anything but digits is ignored."""
    d = F.reverse(digits(text))
    doubled = F.transform(
        F.split(d, "(?<=.)(?=.)"),
        lambda c, i: F.when(i % 2 == 1, c.try_cast("int") * 2 - F.when(c.try_cast("int") > 4, 9).otherwise(0)).otherwise(c.try_cast("int")),
    )
    return F.length(d).between(13, 19) & (F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0)


def card(text: Column) -> Column:
    """A known network prefix with its length, or else Luhn."""
    d = digits(text)
    n = F.length(d)

    def head(k: int) -> Column:
        return F.substring(d, 1, k).try_cast("int")

    network = (
        ((n == 16) & ((head(1) == 4) | head(2).between(51, 55) | head(4).between(2221, 2720) | (head(4) == 6011) | (head(2) == 65)))
        | ((n == 15) & head(2).isin(34, 37))
        | ((n == 14) & (head(3).between(300, 305) | head(2).isin(36, 38)))
    )
    return n.between(13, 19) & (network | luhn(text))


def ssn(text: Column) -> Column:
    d = digits(text)
    return (F.length(d) == 9) & ~d.rlike("^000|^...00|0000$")


def iban(text: Column) -> Column:
    """ISO 13616: the rearranged number is 1 modulo 97, folded character by character."""
    s = F.upper(F.regexp_replace(text, "[ -]", ""))
    moved = F.concat(F.substring(s, 5, 34), F.substring(s, 1, 4))

    def step(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.coalesce(s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (F.aggregate(F.split(moved, "(?<=.)(?=.)"), F.lit(0), step) == 1), F.lit(False))


VALIDATORS = {"card": card, "ssn": ssn, "iban": iban, None: lambda text: F.lit(True)}


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once however often ``use`` names it. Spark shares what is repeated neither in branches nor in
    lambdas; a lambda's argument is a value."""
    return F.get(F.transform(F.array(value), use), 0)


# --- labels ------------------------------------------------------------------------------------
def entity(label: Column) -> Column:
    """A label without its B- or I-."""
    return F.regexp_replace(label, "^[BI]-", "")


def rebuild(label: Column, new: Column) -> Column:
    return F.when(label.startswith("B-"), F.concat(F.lit("B-"), new)).when(label.startswith("I-"), F.concat(F.lit("I-"), new)).otherwise(new)


def class_to_bio(cls: Column, previous: Column) -> Column:
    """I- if the label before is of the same class, else B-."""
    return F.when(cls == "O", F.lit("O")).when(previous.isin("O") | (entity(previous) != cls), F.concat(F.lit("B-"), cls)).otherwise(F.concat(F.lit("I-"), cls))


def bio_consistent(previous: Column, label: Column) -> Column:
    return ~label.startswith("I-") | ((previous != "O") & (entity(previous) == entity(label)))


# --- uncertainty -------------------------------------------------------------------------------
def softmax_stats(logits: Column) -> Column:
    """struct(entropy, confidence, pred): natural-log entropy and maximum of the softmax, index of the largest logit."""

    def of(top: Column) -> Column:
        total = F.aggregate(logits, F.lit(0.0), lambda a, z: a + F.exp(z - top))
        weighted = F.aggregate(logits, F.lit(0.0), lambda a, z: a + (z - top) * F.exp(z - top))
        return F.struct((F.log(total) - weighted / total).alias("entropy"), (1 / total).alias("confidence"), (F.array_position(logits, top) - 1).try_cast("int").alias("pred"))

    return once(F.array_max(logits), of)


@F.arrow_udf(T.StructType([T.StructField("entropy", T.DoubleType()), T.StructField("confidence", T.DoubleType()), T.StructField("pred", T.IntegerType())]))
def softmax_rows(logits: pa.Array) -> pa.Array:
    """softmax_stats() for very many rows: a batch's logits as one matrix for each number of them, instead of element by element."""
    n = len(logits)
    sizes = pc.fill_null(pc.list_value_length(logits), 0).to_numpy(zero_copy_only=False)
    flat = logits.flatten()
    values, gone = flat.to_numpy(zero_copy_only=False).astype(float), flat.is_null().to_numpy(zero_copy_only=False)
    first = np.cumsum(sizes) - sizes
    entropy, confidence, pred = np.zeros(n), np.zeros(n), np.zeros(n, np.int32)
    no_pred, no_value = np.ones(n, bool), np.ones(n, bool)
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        at = first[rows][:, None] + np.arange(size)
        z = np.where(gone[at], -np.inf, values[at])
        best = z.argmax(axis=1)
        with np.errstate(all="ignore"):
            apart = z - z[np.arange(len(rows)), best][:, None]
            power = np.exp(apart)
            total = power.sum(axis=1)
            entropy[rows], confidence[rows] = np.log(total) - (apart * power).sum(axis=1) / total, 1 / total
        pred[rows], no_pred[rows], no_value[rows] = best, gone[at].all(axis=1), gone[at].any(axis=1)
    return pa.StructArray.from_arrays([pa.array(entropy, mask=no_value), pa.array(confidence, mask=no_value), pa.array(pred, mask=no_pred)], ["entropy", "confidence", "pred"])


def normalized_entropy(entropy: Column, n_classes: Column) -> Column:
    return F.when(n_classes > 1, entropy / F.log(n_classes.cast("double"))).otherwise(0.0)


def uncertain(entropy: Column, confidence: Column, entropy_above, confidence_below) -> Column:
    """Both: entropy above and confidence below, strictly."""
    return (entropy > entropy_above) & (confidence < confidence_below)


# --- text --------------------------------------------------------------------------------------
def context(text: Column, start: Column, end: Column, window: int = 400) -> Column:
    """The text up to ``window`` characters on either side of [start, end), grown outwards to the next blank, line feed or full stop,
    on one line between dots, with the target marked and left as it is.

    A left side that is cut starts behind its boundary; if there is none the first character of the text is left out."""
    reach = 256
    before = F.greatest(F.lit(0), start - window - reach)
    size = end - before + window + reach

    def of(x: Column) -> Column:
        # what lies around the target is enough if both boundaries are in it; a long text isn't walked through for each
        left = (x["before"] == 0) | F.substring(x["near"], 1, reach + 1).rlike(r"[ \n.]")
        right = (F.length(x["near"]) < size) | F.substring(x["near"], end - x["before"] + window + 1, F.lit(reach)).rlike(r"[ \n.]")
        return F.when(left & right, _context(x["near"], start - x["before"], end - x["before"], window)).otherwise(_context(text, start, end, window))

    return once(F.struct(before.alias("before"), F.substring(text, before + 1, size).alias("near")), of)


def _context(text: Column, start: Column, end: Column, window: int) -> Column:
    low = F.greatest(F.lit(0), start - window)
    tail = F.length(F.regexp_extract(F.substring(text, F.lit(1), low + 1), r"[^ \n.]*\z", 0))
    first = F.when(low > 0, F.greatest(F.lit(1), low - tail + 1)).otherwise(low)
    high = F.least(F.length(text), end + window)
    last = high + F.length(F.regexp_extract(F.substring(text, high + 1, F.length(text)), r"\A[^ \n.]*", 0))

    def line(a: Column, b: Column) -> Column:
        return F.replace(F.substring(text, a + 1, b - a), F.lit("\n"), F.lit(" "))

    return F.concat(F.lit("..."), line(first, start), F.lit(">>> "), F.substring(text, start + 1, end - start), F.lit(" <<<"), line(end, last), F.lit("..."))


def length_bucket(n_chars: Column) -> Column:
    return F.when(n_chars < 128, "short").when(n_chars < 512, "medium").otherwise("long")


def frequency_bucket(n_tokens: Column) -> Column:
    return F.when(n_tokens < 50, "tail").when(n_tokens < 500, "mid").otherwise("head")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def clean_wordpiece(pieces: Column) -> Column:
    """Word pieces joined to text: a low line block starts a word, a double hash continues one."""
    return F.trim(F.array_join(F.transform(pieces, lambda p: F.replace(F.regexp_replace(p, "^##", ""), F.lit("▁"), F.lit(" "))), ""))


def safe_name(name: Column) -> Column:
    return F.translate(F.lower(name), " /()", "__")


def short_name(system: Column) -> Column:
    """A display name: of "Family Hybrid V2 (model)" or "Family Hybrid (model)" the version and the model, else the name."""
    version = F.regexp_extract(system, r"(Hybrid V2|Hybrid) \((.*)\)$", 1)
    model = F.regexp_extract(system, r"(Hybrid V2|Hybrid) \((.*)\)$", 2)
    return F.when(version == "", system).otherwise(F.concat(F.replace(version, F.lit("Hybrid V2"), F.lit("V2")), F.lit(" ("), model, F.lit(")")))


def display_order(system: Column, names) -> Column:
    """The place of a system in ``names``; others come after all of them."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), system), F.lit(0)) - 1, F.lit(len(names)).cast("long"))


def is_hybrid(system: Column) -> Column:
    """Systems with an arbiter, by their name; folders of summaries are none."""
    return F.lower(system).contains("hybrid") & ~F.lower(system).contains("summary")


def model_name(system: Column) -> Column:
    """What stands in parentheses in a system's name, or the name."""
    inside = F.regexp_extract(system, r"\(([^)]*)\)", 1)
    return F.when(inside == "", system).otherwise(inside)
