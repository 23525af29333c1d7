"""Text and number columns shared by ingest, signals and rules.

Everything is null-safe and uses ``try_`` casts: ANSI mode is on in Spark 4 and
one odd row must not fail a job.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

STRICT_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def text(col: Column) -> Column:
    """``col`` as a trimmed string, null read as empty."""
    return F.trim(F.coalesce(col.cast("string"), F.lit("")))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def collapse(col: Column) -> Column:
    """Runs of white space as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def number(col: Column) -> Column:
    """A number as an export writes it: grouping commas and blanks dropped."""
    bare = F.trim(F.replace(col.cast("string"), F.lit(","), F.lit("")))
    return F.when(bare.rlike(STRICT_NUMBER), bare.try_cast("double"))


def whole_number(col: Column) -> Column:
    """As ``number`` and cut toward zero, so ``142.0`` reads as 142."""
    n = number(col)
    return F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).try_cast("int")


def yes(col: Column) -> Column:
    """Whether a flag column says yes (words, or any non-zero JSON number)."""
    word = F.lower(text(col))
    return word.isin("true", "yes", "y", "1", "t")


def picked(*pairs) -> Column:
    """Of (condition, text) pairs the texts whose condition is true, in order.

    ``array_compact`` runs a lambda, and Spark interprets whatever stands in
    one; this is compiled with the rest of the row.
    """
    none = F.array().cast("array<string>")
    return F.concat(none, *[F.when(held, F.array(F.lit(word))).otherwise(none) for held, word in pairs])


def ascii_only(col: Column) -> Column:
    return F.octet_length(col) == F.length(col)


def without_nul(col: Column) -> Column:
    return F.translate(col, "\x00", "")


def word_list(words) -> Column:
    """``words`` as one array literal (a constant after folding)."""
    return F.split(F.lit("\x01".join(words)), "\x01")


def any_of(col: Column, needles) -> Column:
    """Whether ``col`` holds any of the literal ``needles``: one pre-compiled
    alternation, so a long list stays one node of the plan."""
    needles = [n for n in needles if n]
    if not needles:
        return F.lit(False)
    return col.contains(needles[0]) if len(needles) == 1 else col.rlike(literal_regex(needles))


def first_of(col: Column, needles, labels=None) -> Column:
    """The first needle in list order that ``col`` holds, or null.

    ``col`` is bound once: an expression inside a lambda is worked out anew for
    every needle.
    """
    needles = list(needles)
    if not needles:
        return F.lit(None).cast("string")
    words = word_list(needles)
    held = F.transform(F.array(col), lambda c: F.filter(words, lambda w: c.contains(w)))
    hit = F.try_element_at(F.try_element_at(held, F.lit(1)), F.lit(1))
    if labels is None:
        return hit
    return F.try_element_at(word_list(labels), F.array_position(words, hit).cast("int"))


def literal_regex(words) -> str:
    """An alternation matching any of ``words`` literally."""
    return "|".join(re.sub(r"([\\.^$|?*+()\[\]{}/-])", r"\\\1", w) for w in words)


def parsed_date(col: Column) -> Column:
    """A do-not-contact date. Day-first is tried before month-first.

    An ISO text gives its date; a bare number above 10^9 is an epoch second.
    """
    raw = F.trim(col.cast("string"))
    # The ISO form carries its date in its first ten characters by definition.
    iso = F.regexp_extract(raw, r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})(?:$|[T ])", 1)
    epoch = F.when(raw.rlike(STRICT_NUMBER), raw.try_cast("double"))
    return F.coalesce(
        F.try_to_timestamp(F.nullif(iso, F.lit("")), F.lit("yyyy-M-d")),
        F.try_to_timestamp(raw, F.lit("d/M/yyyy")),
        F.try_to_timestamp(raw, F.lit("M/d/yyyy")),
        F.when(epoch > 1_000_000_000, F.timestamp_seconds(epoch)),
    )
