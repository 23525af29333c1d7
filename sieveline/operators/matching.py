"""Lookups the qualification rules need, as equi-lookups on derived keys.

Host-suffix, brand-prefix and trade-term matching are theta joins by nature.
The reference lists are small fixed tables, so each becomes a few equality
tests on keys cut from the row itself: no shuffle, no nested loop.  The
``*_join`` forms take the list as a DataFrame, for lists of any size; substrings
meet on an inverted index of pieces (``containing``).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..reference_data import (GENERIC_CATEGORIES, HOST_PACKS, SHARED_VETOES, TRADES)
from ..functions.text import any_of, first_of, word_list


# ---- skew-safe lookup -------------------------------------------------------

NULL_SPREAD = 4096     # shares the rows without a key are dealt into
SALTS = 64             # copies of a hot key's one lookup row


def lookup(left: DataFrame, right: DataFrame, key: str, spread: str = "cid",
           hot: DataFrame | None = None) -> DataFrame:
    """``left`` left-joined to ``right``, which holds one row per key.

    A key many left rows share is split, not gathered: where its counts are
    known anyway (``hot``: a bounded table of hot keys) its rows are salted and
    its one right row copied; otherwise AQE splits the oversized partition of
    this join at run time. Rows without a key match nothing and are dealt out
    evenly. No broadcast is forced: AQE broadcasts ``right`` only when its
    measured size is under the threshold.
    """
    deal = F.pmod(F.xxhash64(spread), F.lit(NULL_SPREAD)).cast("int")
    if hot is None:
        salted = left.withColumn("_salt", F.when(F.col(key).isNull(), deal).otherwise(F.lit(0)))
        return salted.join(right.withColumn("_salt", F.lit(0)), [key, "_salt"], "left").drop("_salt")
    marked = F.broadcast(hot.select(key).withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(deal, F.lit(SALTS))).when(F.col(key).isNull(), deal).otherwise(F.lit(0))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = left.join(marked, key, "left").withColumn("_salt", salt).drop("_hot")
    spread_right = right.join(marked, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.join(spread_right, [key, "_salt"], "left").drop("_salt")


HOT_SHARE = 256        # a key with more than 1/256 of the rows counts as hot


def hot_among(counts: DataFrame, n: str) -> DataFrame:
    """Rows of a count table holding over one 256th of its total: at most 256
    of them whatever the data, so they may always be broadcast."""
    total = counts.agg(F.sum(n)).scalar()
    return counts.filter(F.col(n) * HOT_SHARE > total)


# ---- host suffixes ----------------------------------------------------------

def host_packs(overrides: dict | None = None):
    """The host lists in precedence order; an override replaces a list whole."""
    overrides = overrides or {}
    return [(pid, state, list(overrides.get(pid, hosts))) for pid, state, hosts in HOST_PACKS]


def _all_hosts(packs) -> list[str]:
    return [h for _, _, hosts in packs for h in hosts]


def host_rank(host: Column, packs=None) -> Column:
    """Place (from 1) of the first list entry a host equals or is a subdomain
    of, lists taken in precedence order; null for a host of its own.

    Matching on a dot boundary means one of the host's last-n-labels suffixes
    is an entry: one equality lookup per depth against a constant.
    """
    hosts = _all_hosts(packs or host_packs())
    entries = word_list(hosts)
    depth = max(h.count(".") + 1 for h in hosts)
    cuts = [F.substring_index(host, ".", -n) for n in range(1, depth + 1)]
    return F.array_min(F.array(*[F.nullif(F.array_position(entries, c), F.lit(0)) for c in cuts])).cast("int")


def host_state(rank: Column, packs=None) -> Column:
    out, upto = F.when(rank.isNull(), F.lit("owned_domain")), 0
    for _, state, hosts in packs or host_packs():
        upto += len(hosts)
        out = out.when(rank <= upto, F.lit(state))
    return out


def host_entry(rank: Column, packs=None) -> Column:
    return F.try_element_at(word_list(_all_hosts(packs or host_packs())), rank)


def host_pack(rank: Column, packs=None) -> Column:
    out, upto = F.when(rank.isNull(), F.lit(None).cast("string")), 0
    for pid, _, hosts in packs or host_packs():
        upto += len(hosts)
        out = out.when(rank <= upto, F.lit(f"{pid}@1"))
    return out


def host_join(df: DataFrame, host_col: str, hosts: DataFrame) -> DataFrame:
    """As ``classify_host`` with the list as a DataFrame ``(host, state, rank)``.

    One equi-join on a unique key for each label depth up to the list's
    deepest; the lowest rank wins. Adds ``host_state`` and ``host_matched``.
    """
    depth = hosts.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    table = (hosts.groupBy("host").agg(F.min(F.struct("rank", "state", "host")).alias("_hit"))
             .withColumnRenamed("host", "_suffix"))
    out, hits = df, []
    for n in range(1, depth + 1):
        side = table.select(F.col("_suffix").alias(f"_s{n}"), F.col("_hit").alias(f"_h{n}"))
        out = out.withColumn(f"_s{n}", F.substring_index(host_col, ".", -n)).join(side, f"_s{n}", "left")
        hits.append(F.col(f"_h{n}"))
    best = F.least(*hits, hits[0])
    return (out.withColumn("host_state", F.coalesce(best["state"], F.lit("owned_domain")))
            .withColumn("host_matched", best["host"])
            .drop(*[f"_{k}{n}" for k in "sh" for n in range(1, depth + 1)]))


# ---- trade terms ------------------------------------------------------------

# Plural endings and what takes their place, the first that fits; a word
# shorter than the given length keeps its ending.
PLURALS = [("ies", "y", 5), ("ses", "s", 5), ("xes", "x", 5), ("zes", "z", 5), ("hes", "h", 5), ("ss", "ss", 0), ("s", "", 4)]


def stem(noun: str) -> str:
    """What a plural and its singular have in common, for substring matching."""
    ending, instead = next(((e, i) for e, i, least in PLURALS if noun.endswith(e) and len(noun) >= least), ("", ""))
    return noun[:len(noun) - len(ending)] + instead


def typed_trade(term: str, **given) -> dict:
    """A trade somebody typed, as a pack of one plan: its stem stands in for terms not given."""
    name = re.sub(r"\s+", " ", str(term or "")).strip()
    if not name:
        raise ValueError(f"{term!r} names no trade")
    pack = {kind: [str(t) for t in given.get(kind) or ()] for kind in
            ("categories", "keywords", "locale_terms", "vetoes", "osm_tags")}
    for kind in ("categories", "keywords"):
        pack[kind] = pack[kind] or [stem(name.lower())]
    return {"label": name[0].upper() + name[1:], **pack}


def effective_vetoes(pack: dict, shared=None) -> list[str]:
    """The pack's own vetoes, then each shared one no claimed term overlaps."""
    shared = SHARED_VETOES if shared is None else shared
    claims = [t.lower() for t in [*pack["categories"], *pack["keywords"]] if t]
    free = [v.lower() for v in shared
            if not any(v.lower() in c or c in v.lower() for c in claims)]
    return [v.lower() for v in pack["vetoes"]] + free


def veto_table(terms: DataFrame, shared: DataFrame) -> DataFrame:
    """The same rule over tables: ``(pack_id, veto, origin)``.

    ``terms`` holds ``pack_id, kind, term`` (kind is category, keyword or veto)
    and ``shared`` a ``term`` for each shared veto. A pack's claims are one
    array, tested against the shared list in place: no pack is joined with
    every veto.
    """
    term = F.lower("term")
    claims = F.array_compact(F.collect_set(F.when((F.col("kind") != "veto") & (term != ""), term)))
    packs = terms.groupBy("pack_id").agg(
        claims.alias("claims"), F.array_compact(F.collect_set(F.when(F.col("kind") == "veto", term))).alias("own"))
    offered = shared.agg(F.sort_array(F.collect_set(term)).alias("v")).scalar()
    packs = packs.withColumn("offered", offered)
    free = F.filter("offered", lambda v: ~F.exists("claims", lambda c: c.contains(v) | v.contains(c)))
    marked = F.concat(F.transform("own", lambda v: F.struct(v.alias("veto"), F.lit("own").alias("origin"))),
                      F.transform(free, lambda v: F.struct(v.alias("veto"), F.lit("shared").alias("origin"))))
    return packs.select("pack_id", F.explode(marked).alias("m")).select("pack_id", "m.veto", "m.origin")


def pack_inventory(terms: DataFrame) -> DataFrame:
    """How many distinct terms of each kind a pack holds, from ``pack_id, kind, term``."""
    return terms.groupBy("pack_id", "kind").agg(F.countDistinct(F.lower("term")).alias("terms"))


# How a listing stands to a trade.
VETOED, BY_CATEGORY, BY_NAME, NO_MATCH = 0, 1, 2, 3


def trade_standing(cat: Column, title: Column, pack: dict) -> Column:
    """VETOED, BY_CATEGORY, BY_NAME or NO_MATCH, tested in that order.

    ``cat`` and ``title`` are lower case; the name counts only when the
    category says nothing.
    """
    return (F.when(any_of(cat, effective_vetoes(pack)), VETOED)
            .when(any_of(cat, [c.lower() for c in pack["categories"]]), BY_CATEGORY)
            .when(((cat == "") | cat.isin(GENERIC_CATEGORIES)) & any_of(title, trade_terms(pack)), BY_NAME)
            .otherwise(NO_MATCH))


def trade_terms(pack: dict) -> list[str]:
    return [t.lower() for t in [*pack["keywords"], *pack.get("locale_terms", [])] if t]


def trade_rule(standing: Column, cat: Column, title: Column, pack: dict) -> Column:
    """Which entry matched, for the evidence."""
    wants = pack["categories"]
    return (F.when(standing == VETOED, first_of(cat, effective_vetoes(pack)))
            .when(standing == BY_CATEGORY, first_of(cat, [c.lower() for c in wants], wants))
            .when(standing == BY_NAME, first_of(title, trade_terms(pack))))


GRAM = 3                     # letters of a piece that texts and terms meet on


def _grams(text: Column, size: int) -> Column:
    """The distinct pieces of ``size`` letters of a text, none of a shorter one."""
    n = F.char_length(text)
    return F.when(n >= size, F.array_distinct(F.transform(
        F.sequence(F.lit(1), n - (size - 1)), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``text, term`` of every text that holds a term, from ``texts`` (``text``) and ``terms`` (``term``), each once.

    An inverted index: a term is filed under that piece of it which fewest terms
    have, texts look their pieces up by equality, and what meets is verified. So
    terms may be a table of any size, and no text is held against all of them.
    Case counts; an empty term is held by nothing.
    """
    named = terms.select("term").filter("term <> ''").distinct().withColumn("_size", F.least(F.char_length("term"), F.lit(GRAM)))
    pieces = reduce(lambda x, n: F.when(F.col("_size") == n, _grams(F.col("term"), n)).otherwise(x), range(1, GRAM + 1),
                    F.array().cast("array<string>"))
    each = named.select("term", "_size", F.explode(pieces).alias("_piece"))
    held = each.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    filed = each.join(held, "_piece").groupBy("term").agg(F.min(F.struct("_n", "_piece"))["_piece"].alias("_piece"))
    every = F.array_distinct(F.concat(*[_grams(F.col("text"), n) for n in range(1, GRAM + 1)]))
    asked = texts.select("text").filter("text <> ''").distinct().select("text", F.explode(every).alias("_piece"))
    return asked.join(filed, "_piece").filter(F.col("text").contains(F.col("term"))).select("text", "term")


def trade_term_join(df: DataFrame, terms: DataFrame) -> DataFrame:
    """Trade matching with the terms as a table ``(pack_id, kind, term)`` of any size.

    ``kind`` is veto, category or keyword. Distinct categories, and distinct
    names where the category says nothing, meet the terms by ``containing``;
    the answers join back on equality.
    """
    keyed = df.withColumn("_cat", F.lower(F.trim(F.coalesce("category", F.lit("")))))
    generic = (F.col("_cat") == "") | F.col("_cat").isin(GENERIC_CATEGORIES)
    keyed = keyed.withColumn("_title", F.when(
        generic, F.lower(F.coalesce("name", F.lit("")))).otherwise(F.lit("")))
    lowered = terms.select("pack_id", "kind", F.lower("term").alias("term")).distinct()

    def found(column: str, kinds: list[str]) -> DataFrame:
        own = lowered.filter(F.col("kind").isin(kinds))
        return containing(keyed.select(F.col(column).alias("text")), own).join(own, "term").groupBy(F.col("text").alias(column)).agg(
            *[F.collect_set(F.when(F.col("kind") == k, F.col("pack_id"))).alias(f"_{k}") for k in kinds])

    none = F.array().cast("array<string>")
    out = lookup(lookup(keyed, found("_cat", ["veto", "category"]), "_cat"), found("_title", ["keyword"]), "_title")
    out = out.withColumns({k: F.coalesce(k, none) for k in ("_veto", "_category", "_keyword")})
    return (out.withColumn("trade_vetoed", F.size("_veto") > 0)
            .withColumn("trade_hits", F.array_sort(F.array_except(F.array_union("_category", "_keyword"), F.col("_veto"))))
            .drop("_cat", "_title", "_veto", "_category", "_keyword"))
