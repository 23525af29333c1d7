"""From listings to verdicts, as one lazy DataFrame plan.

Rules are applied tier by tier: page joins see only the rows the free rules
left standing, and a row settles at the first tier that fails it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import (CHEAP, EXPENSIVE, FREE, LISTING_FIELDS, QUALIFIED, conform)
from ..operators import free_signals, memory, ordered, page_signals, registry, rules, scoring
from ..operators.listings import first_seen
from ..session import settle
from .brief import Brief, duration


@dataclass
class Inputs:
    """Landed tables a plan may join to. Absent ones leave their signals unmeasured."""

    site_pages: DataFrame | None = None
    place_pages: DataFrame | None = None
    mail_domains: DataFrame | None = None
    suppressions: DataFrame | None = None       # cid, suppressed_at
    prior_verdicts: DataFrame | None = None     # cid, outcome: hide unchanged
    stored: DataFrame | None = None             # verdicts whose paid signals are reused
    ledger: object | None = None                # where the runs that a brief suppresses are kept
    now: Column | None = None
    fresh_days: int | None = page_signals.FRESH_DAYS


def measure_free(listings: DataFrame, brief: Brief, tally: bool = True,
                 tally_table: DataFrame | None = None) -> DataFrame:
    """``listings`` with the free signals. ``tally=False`` is a stream, where
    no brand count exists; ``tally_table`` supplies a stored one."""
    names = brief.signals_for(FREE)
    if "chain_size" in names:
        if tally:
            listings = free_signals.with_chain_tally(listings, tally_table)
        else:
            listings = free_signals.with_chain_key(listings).withColumn("_chain_n", F.lit(None).cast("long"))
    df = registry.add_signals(listings, names, brief.context(), pin=brief.referenced)
    if "signals" not in df.columns:
        df = df.withColumn("signals", F.struct(F.lit(None).cast("string").alias("_none")))
    return df.drop("_chain_key", "_chain_n")


def _reuse(df: DataFrame, stored: DataFrame | None, names) -> DataFrame:
    """Attach stored answers of the named signals as ``_old``."""
    if stored is None:
        return df
    have = {f.name for f in stored.schema["signals"].dataType}
    names = [n for n in names if n in have]
    if not names:
        return df
    old = stored.select("cid", F.struct(*[F.col("signals")[n].alias(n) for n in names]).alias("_old"))
    return df.join(old, "cid", "left")


def measure_paid(df: DataFrame, brief: Brief, inputs: Inputs, tier: str) -> DataFrame:
    """Adds one paid tier's signals, reusing stored answers where there are any."""
    names = brief.signals_for(tier)
    if not names:
        return df
    ctx = brief.context()
    base = [c for c in df.columns]
    if tier == CHEAP:
        hop = "site_contact" in names
        if inputs.site_pages is None:
            df = _without_pages(df)
        else:
            df = page_signals.with_pages_of(df, inputs.site_pages, hop, ctx.this_year, inputs.now, inputs.fresh_days,
                                            page_signals.facts_read(names))
        df = page_signals.with_mail_check(df, inputs.mail_domains if hop else None)
        asked = F.coalesce(F.col("_page")["requests"], F.lit(0)) + F.coalesce(F.col("_contact")["requests"], F.lit(0))
    else:
        df = page_signals.with_place_pages(df, inputs.place_pages)
        asked = F.col("_place").isNotNull().cast("int")
    df = registry.add_signals(df, names, ctx)
    df = _reuse(df, inputs.stored, names)
    if "_old" in df.columns:
        held = {f.name for f in df.schema["_old"].dataType}
        fields = []
        for f in df.schema["signals"].dataType:
            fresh = F.col("signals")[f.name]
            if f.name in held:
                old = F.col("_old")[f.name]
                if df.schema["_old"].dataType[f.name].dataType.simpleString() != f.dataType.simpleString():
                    old = F.from_json(F.to_json(old), f.dataType)      # stored by another version
                fresh = F.coalesce(old, fresh)
            fields.append(fresh.alias(f.name))
        df = df.withColumn("signals", F.struct(*fields))
        # what is stored for all of a tier's signals is asked of nobody
        known = [F.col("_old")[n].isNotNull() if n in held else F.lit(False) for n in names]
        asked = F.when(reduce(lambda a, b: a & b, known), F.lit(0)).otherwise(asked)
    if "requests" in base:
        df = df.withColumn("requests", F.col("requests") + asked.cast("long"))
    return df.select(*base)


EMPTY_FACTS = ("url string, fetched_at timestamp, final_url string, status int, error string, "
               "redirected boolean, requests int, ok boolean, parked string, placeholder string, "
               "words int, platform string, marker string, generator string, emails array<string>, "
               "socials map<string,string>, phones array<string>, contact_url string, "
               "viewport boolean, years array<int>")


def _without_pages(df: DataFrame) -> DataFrame:
    shape = df.sparkSession.createDataFrame([], EMPTY_FACTS).drop("url").schema.simpleString()
    none = F.lit(None).cast(shape)
    return df.withColumns({"_page": none, "_contact": none, "_contact_url": F.lit(None).cast("string")})


VERDICT_TAIL = ["signals", "outcome", "rejected_by", "reject_reason"]


def withheld(spark, brief: Brief, inputs: Inputs) -> DataFrame | None:
    """Everything a run leaves out: the table given, the brief's lists, what its earlier runs found, and its ids."""
    from ..sources.donotcontact import read_list

    lists = [] if inputs.suppressions is None else [inputs.suppressions]
    lists += [read_list(spark, path) for path in brief.suppress.get("lists") or []]
    runs = brief.suppress.get("runs") or []
    if runs:
        earlier = [inputs.ledger.verdicts(r) if inputs.ledger else None for r in runs]
        if any(e is None for e in earlier):
            raise ValueError("suppress.runs needs a ledger that holds those runs")
        lists += [e.select("cid", F.lit(None).cast("timestamp").alias("suppressed_at")) for e in earlier]
    cids = brief.suppress.get("cids") or []
    return memory.suppression_list(*lists, cids=cids) if lists or cids else None


def honoured(brief: Brief) -> None:
    """Refuses limits that a batch can't keep, rather than ignore them."""
    asked = [k for k in ("max_runtime", "max_runtime_seconds") if brief.limits.get(k) is not None]
    if asked:
        raise ValueError(f"a batch has no clock to keep limits.{', limits.'.join(asked)} by; see streaming.qualify.run_for")


def judge(listings: DataFrame, brief: Brief, inputs: Inputs | None = None, *, dedupe: bool = True,
          tally: bool = True, tally_table: DataFrame | None = None, materialise: bool = True,
          cost: bool = False) -> DataFrame:
    """Verdicts of ``listings``: listing columns, ``signals``, outcome, score.

    ``cost`` adds ``requests``: the lookups charged for a row's paid signals.

    ``materialise`` writes the free tier once to the shared folder when paid
    tiers follow, so settled and surviving rows are not both derived from the
    source.
    """
    inputs = inputs or Inputs()
    df = conform(listings)
    if dedupe:
        df = first_seen(df)
    hidden = withheld(df.sparkSession, brief, inputs)
    if hidden is not None:
        df = memory.without_suppressed(df, hidden, brief.suppress.get("after"), inputs.now)
    df = measure_free(df, brief, tally, tally_table)
    measured = set(brief.signals_for(FREE))
    kept = [*LISTING_FIELDS, *VERDICT_TAIL, *(["requests"] if cost else [])]
    df = df.withColumn("requests", F.lit(0).cast("long")) if cost else df
    df = rules.evaluate(df, brief.filters, measured).select(*kept)
    paid = [t for t in (CHEAP, EXPENSIVE) if brief.signals_for(t)]
    if paid and materialise:
        df = settle(df, "free-tier")
    settled = []
    for tier in paid:
        settled.append(df.filter(F.col("outcome") != QUALIFIED))
        alive = df.filter(F.col("outcome") == QUALIFIED).drop("outcome", "rejected_by", "reject_reason")
        alive = measure_paid(alive, brief, inputs, tier)
        measured |= set(brief.signals_for(tier))
        df = rules.evaluate(alive, brief.filters, measured).select(*kept)
    shape = df.schema["signals"].dataType
    for part in settled:
        df = df.unionByName(_widened(part, shape))
    return finish(df, brief)


def _widened(df: DataFrame, shape) -> DataFrame:
    """Give settled rows the later tiers' signals as nulls."""
    have = {f.name for f in df.schema["signals"].dataType}
    return df.withColumn("signals", F.struct(*[
        (F.col("signals")[f.name] if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in shape]))


def finish(df: DataFrame, brief: Brief) -> DataFrame:
    """Score the qualified rows and list broken measurements."""
    s = brief.scoring
    good = F.col("outcome") == QUALIFIED
    df = df.withColumn("failed_signals", rules.failed_signals(df)).withColumn("qualified", good)
    return scoring.score(df, s.get("weights") or {}, s.get("normalise", True) is not False,
                         bool(s.get("confidence")), s.get("bands"), only=good)


def requalify(stored: DataFrame, brief: Brief, inputs: Inputs | None = None) -> DataFrame:
    """Stored rows judged by today's rules: free signals recomputed, paid ones
    reused as they were measured."""
    given = inputs or Inputs()
    again = Inputs(given.site_pages, given.place_pages, given.mail_domains, stored=stored,
                   now=given.now, fresh_days=given.fresh_days)
    return judge(stored.select(*LISTING_FIELDS), brief, again, dedupe=False)


def run(listings: DataFrame, brief: Brief, inputs: Inputs | None = None, **kw) -> DataFrame:
    """``judge`` with what a run withholds or cuts short marked in ``fate``:
    ``shown``, ``hidden`` (unchanged since before) or ``unreached`` (past the
    breaker, the result cap or the request budget). Nothing is dropped uncounted."""
    return ordered.apply_limits(marked(listings, brief, inputs, **kw), **limits(brief))


def marked(listings: DataFrame, brief: Brief, inputs: Inputs | None = None, **kw) -> DataFrame:
    """The verdicts a run's limits are applied to, settled."""
    honoured(brief)
    inputs = inputs or Inputs()
    df = judge(listings, brief, inputs, cost=bool(brief.limits.get("max_requests")), **kw)
    # Verdicts are written anyway; what depends on their order reads the file.
    return settle(memory.mark_unchanged(df, inputs.prior_verdicts), "judged")


def limits(brief: Brief) -> dict:
    return {"max_results": brief.limits.get("max_results"), "max_requests": brief.limits.get("max_requests"), **brief.breaker}


def estimate(listings: DataFrame | None, brief: Brief, places: int = 0) -> DataFrame:
    """What a brief would run, per tier. With listings at hand the rows a paid
    tier would see are measured by the free rules rather than guessed."""
    from pyspark.sql import SparkSession

    spark = listings.sparkSession if listings is not None else SparkSession.active()
    rows = [(t, ",".join(brief.signals_for(t)), len(brief.signals_for(t)), places,
             brief.limits.get("max_results"), brief.limits.get("max_requests"),
             duration(brief.limits.get("max_runtime_seconds") or brief.limits.get("max_runtime")))
            for t in (FREE, CHEAP, EXPENSIVE)]
    plan = spark.createDataFrame(rows, "tier string, signals string, n_signals int, places int, "
                                       "max_results int, max_requests int, max_runtime_seconds int")
    if listings is None:
        return plan.withColumn("rows_in", F.lit(None).cast("long"))
    base = first_seen(conform(listings))
    free = rules.evaluate(measure_free(base, brief), brief.filters, set(brief.signals_for(FREE)))
    every = free.agg(F.count(F.lit(1)).alias("n")).scalar()
    alive = free.agg(F.count_if(F.col("outcome") == QUALIFIED).alias("n")).scalar()
    return plan.withColumn("rows_in", F.when(F.col("n_signals") == 0, F.lit(0).cast("long"))
                           .when(F.col("tier") == FREE, every).otherwise(alive))
