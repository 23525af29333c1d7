"""Business names: the key two branches of a brand share, and their script."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..reference_data import CHAINS, SCRIPT_WORDS
from .text import ascii_only, collapse, word_list

# Fixed patterns: branch suffixes and company words that separate two branches
# of one brand.
BRANCH_SUFFIX = (r"(?iU)\s[-–—|(]\s?[^-–—|()]{1,40}\)?$"
                 r"|\s(branch|store|clinic|centre|center)\s*\d*$")
COMPANY_WORDS = (r"(?iU)\b(ltd|limited|llc|inc|plc|gmbh|bv|pty|llp|co|corp|company|group|"
                 r"holdings|uk|usa|international)\b\.?")
NOT_WORD = r"(?U)[^\p{L}\p{N}_\s]"
# The same for lower-cased ASCII names, where the Unicode forms of classes and
# cases match nothing more and cost several times as much.
PLAIN_SUFFIX, PLAIN_WORDS = BRANCH_SUFFIX.replace("(?iU)", ""), COMPANY_WORDS.replace("(?iU)", "")
PLAIN_GAP = "[^a-z0-9_]+"           # what NOT_WORD blanks and ``collapse`` then joins


@lru_cache(maxsize=1)
def _compatibility_forms() -> tuple[str, str, dict[str, str]]:
    """Letters and digits with a compatibility form, by rule from the Unicode
    data: one-to-one pairs for ``translate`` and the few that expand."""
    src, dst, wide = [], [], {}
    for cp in range(0x80, 0x20000):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3 or 0x4E00 <= cp <= 0x9FFF:
            continue
        ch = chr(cp)
        if not ch.isalnum():
            continue
        folded = unicodedata.normalize("NFKC", ch)
        if folded == ch:
            continue
        if len(folded) == 1:
            src.append(ch)
            dst.append(folded)
        else:
            wide[ch] = folded
    return "".join(src), "".join(dst), wide


def fold_compatibility(col: Column, source: Column | None = None) -> Column:
    """Full-width letters, ligatures and the like as their plain forms.

    ``source`` is what ``col`` was cut from: it answers what characters there
    may be, so that ``col`` itself is worked out once.

    ``translate`` covers the one-to-one forms; a name holding one of the rare
    expanding characters takes the per-character branch. Both stay in the JVM.
    """
    src, dst, wide = _compatibility_forms()
    plain = F.translate(col, src, dst)
    chars, forms = word_list(wide), word_list(wide.values())
    spelled = F.array_join(F.transform(F.split(plain, ""), lambda ch: F.coalesce(
        F.try_element_at(forms, F.nullif(F.array_position(chars, ch), F.lit(0)).cast("int")), ch)), "")
    source = col if source is None else source
    holds_wide = F.length(F.translate(source, "".join(wide), "")) < F.length(source)
    return (F.when(ascii_only(source), col)
            .when(holds_wide, spelled)
            .otherwise(plain))


def chain_key(name: Column) -> Column:
    """A name reduced to what branches of one brand share (empty when nothing
    usable is left)."""
    key = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    plain = F.regexp_replace(F.regexp_replace(key, PLAIN_SUFFIX, ""), PLAIN_WORDS, " ")
    plain = F.trim(F.regexp_replace(plain, PLAIN_GAP, " "))
    return F.when(ascii_only(key), plain).otherwise(collapse(fold_compatibility(_stripped(key), key)))


def _stripped(key: Column) -> Column:
    key = F.regexp_replace(key, BRANCH_SUFFIX, "")
    key = F.regexp_replace(key, COMPANY_WORDS, " ")
    return F.regexp_replace(key, NOT_WORD, " ")


def brand_key(name: str) -> str:
    """``chain_key`` of a brand in the reference list, on the driver."""
    key = name.strip().lower()
    for pattern, put in ((BRANCH_SUFFIX, ""), (COMPANY_WORDS, " ")):
        key = re.sub(pattern.replace("(?iU)", "(?i)"), put, key)
    key = re.sub(r"[^\w\s]", " ", key)
    return " ".join(unicodedata.normalize("NFKC", key).split())


def known_brand(key: Column, brands: dict[str, int] | None = None) -> Column:
    """Place (from 1) in the brand list of the longest whole-word prefix of
    ``key`` that is a brand; null when none is.

    The prefix test is one equality lookup for each word count that the list has.
    """
    listed = [brand_key(b) for b in (CHAINS if brands is None else brands)]
    keys = word_list(listed)
    heads = [F.substring_index(key, " ", n) for n in sorted({k.count(" ") + 1 for k in listed}, reverse=True)]
    return F.coalesce(*[F.nullif(F.array_position(keys, h), F.lit(0)) for h in heads]).cast("int")


def brand_name(place: Column, brands: dict[str, int] | None = None) -> Column:
    return F.try_element_at(word_list([brand_key(b) for b in (CHAINS if brands is None else brands)]), place)


def brand_size(place: Column, brands: dict[str, int] | None = None) -> Column:
    sizes = [str(int(n)) for n in (CHAINS if brands is None else brands).values()]
    return F.try_element_at(word_list(sizes), place).cast("long")


@lru_cache(maxsize=1)
def script_spans() -> dict[str, list[list[int]]]:
    """script -> ranges of its letters, by rule from character names: the first
    script whose word starts the name, or stands in it after a blank."""
    runs: dict[str, list[list[int]]] = {label: [] for label, _ in SCRIPT_WORDS}
    for cp in range(0x41, 0x30000):
        ch = chr(cp)
        if 0xD800 <= cp <= 0xDFFF or not ch.isalpha():
            continue
        title = unicodedata.name(ch, "")
        for label, word in SCRIPT_WORDS:
            if title.startswith(word) or " " + word in title:
                spans = runs[label]
                if spans and spans[-1][1] == cp - 1:
                    spans[-1][1] = cp
                else:
                    spans.append([cp, cp])
                break
    return runs


def script_class(label: str) -> str:
    return "[" + "".join("\\x{%x}-\\x{%x}" % (a, b) for a, b in script_spans()[label]) + "]"


# One mark per script, none of them a letter.
SCRIPT_MARKS = dict(zip([label for label, _ in SCRIPT_WORDS], "0123456789:;<="))


# Scripts of tens of thousands of letters in few ranges: matched by range. All
# other letters are looked up one by one.
BY_RANGE = ("han", "hangul")


@lru_cache(maxsize=1)
def _letter_marks() -> tuple[str, str]:
    pairs = [(chr(cp), SCRIPT_MARKS[label]) for label, spans in script_spans().items() if label not in BY_RANGE
             for a, b in spans for cp in range(a, b + 1)]
    return "".join(c for c, _ in pairs), "".join(m for _, m in pairs)


def script_marks(name: Column) -> Column:
    """The letters of ``name``, each written as its script's mark; a letter of
    no listed script stays itself."""
    plain = F.repeat(F.lit(SCRIPT_MARKS["latin"]), F.length(F.regexp_replace(name, "[^A-Za-z]+", "")))
    spelled = F.translate(F.regexp_replace(name, r"[^\p{L}]+", ""), *_letter_marks())
    for label in BY_RANGE:
        spelled = F.regexp_replace(spelled, script_class(label), SCRIPT_MARKS[label])
    return F.when(ascii_only(name), plain).otherwise(spelled)


def script_counts(marks: Column) -> dict[str, Column]:
    return {label: F.length(marks) - F.length(F.replace(marks, F.lit(mark)))
            for label, mark in SCRIPT_MARKS.items()}
