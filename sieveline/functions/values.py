"""Comparing a typed measurement with a rule's literal.

A measurement holds its value as text, number or boolean. Which comparison
applies is settled while the plan is built, from the literal's type: a boolean
equals the number it counts as, text never equals a number, and null is an
ordinary value for equality that never satisfies an ordering.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import STRICT_NUMBER

EQUALITY = ("==", "!=", "in", "not in", "is")
ORDERING = (">", ">=", "<", "<=")
OPERATORS = EQUALITY + ORDERING


@dataclass
class Value:
    """A value whose type is only known per row."""

    vstr: Column
    vnum: Column
    vbool: Column

    @property
    def is_null(self) -> Column:
        return self.vstr.isNull() & self.vnum.isNull() & self.vbool.isNull()

    @property
    def truthy(self) -> Column:
        return F.coalesce(self.vbool, self.vnum != 0, self.vstr != "", F.lit(False))

    @property
    def as_number(self) -> Column:
        word = F.trim(self.vstr)
        return F.coalesce(self.vnum, self.vbool.cast("double"),
                          F.when(word.rlike(STRICT_NUMBER), word.try_cast("double")))

    def as_text(self, whole: bool = False) -> Column:
        """The value as an export writes it; whole numbers without a fraction."""
        num = self.vnum.cast("bigint").cast("string") if whole else self.vnum.cast("string")
        flag = F.when(self.vbool, F.lit("True")).when(~self.vbool, F.lit("False"))
        return F.coalesce(self.vstr, num, flag)

    def shown(self, whole: bool = False) -> Column:
        """The value as a reason sentence quotes it."""
        return F.coalesce(
            F.when(self.vstr.isNotNull(), F.concat(F.lit("'"), self.vstr, F.lit("'"))),
            self.as_text(whole), F.lit("None"))


def of_type(col: Column, dtype: str) -> Value:
    """A statically typed evidence column as a ``Value``."""
    none_s, none_n, none_b = (F.lit(None).cast(t) for t in ("string", "double", "boolean"))
    if dtype == "boolean":
        return Value(none_s, none_n, col)
    if dtype == "string":
        return Value(col, none_n, none_b)
    if dtype in ("int", "bigint", "double", "float", "smallint", "tinyint") or dtype.startswith("decimal"):
        return Value(none_s, col.cast("double"), none_b)
    return Value(F.to_json(col), none_n, none_b)


def from_signal(sig: Column) -> Value:
    return Value(sig["vstr"], sig["vnum"], sig["vbool"])


def equals(v: Value, want) -> Column:
    if want is None:
        return v.is_null
    if isinstance(want, bool):
        return F.coalesce(v.vbool == F.lit(want), v.vnum == F.lit(float(want)), F.lit(False))
    if isinstance(want, (int, float)):
        hit = F.coalesce(v.vnum == F.lit(float(want)), F.lit(False))
        if want in (0, 1):
            hit = hit | F.coalesce(v.vbool == F.lit(bool(want)), F.lit(False))
        return hit
    if isinstance(want, str):
        return F.coalesce(v.vstr == F.lit(want), F.lit(False))
    return F.lit(False)          # a list is never equal to a scalar


def among(v: Value, wants) -> Column:
    """Membership. Text literals become one ``IN`` list."""
    words = [w for w in wants if isinstance(w, str)]
    out = F.coalesce(v.vstr.isin(words), F.lit(False)) if words else F.lit(False)
    for w in wants:
        if not isinstance(w, str):
            out = out | equals(v, w)
    return out


def literal_number(want):
    if isinstance(want, bool):
        return float(want)
    try:
        return float(want)
    except (TypeError, ValueError):
        return None


def compare(op: str, v: Value, want) -> Column:
    """``v op want`` as a boolean column that is never null."""
    many = isinstance(want, (list, tuple, set))
    if op == "==":
        return equals(v, want)
    if op == "!=":
        return ~equals(v, want)
    if op == "in":
        return among(v, want) if many else equals(v, want)
    if op == "not in":
        return ~(among(v, want) if many else equals(v, want))
    if op == "is":
        return v.truthy == F.lit(bool(want))
    if op in ORDERING:
        bound = literal_number(want)
        if bound is None or bound != bound:
            return F.lit(False)
        n = v.as_number
        test = {">": n > bound, ">=": n >= bound, "<": n < bound, "<=": n <= bound}[op]
        # Spark orders NaN above every number; here it satisfies nothing.
        return F.coalesce(test & ~F.isnan(n), F.lit(False))
    raise ValueError(f"no operator {op!r}")
