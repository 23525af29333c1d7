"""A brief from its sources to its results: read, judged, limited, counted, written, recorded."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memory, ordered, places, shaping, stats
from ..operators.listings import first_seen
from ..session import settle
from ..sinks import files
from ..sources import registry as sources
from .brief import Brief, source_id
from .judge import Inputs, limits, marked, withheld


@dataclass
class Execution:
    verdicts: DataFrame         # every judged row with its fate
    results: DataFrame          # qualified rows that are shown, as the output block asks
    report: DataFrame           # (source, place, status, why): what the sources told
    stats: DataFrame            # one row


def planned(spark: SparkSession, brief: Brief) -> DataFrame | None:
    """The places a brief names, in their order; none where it names none."""
    where = brief.where
    if not any(where.get(k) for k in ("places", "packs", "place")):
        return None
    return places.planned_places(spark, where)


def source_specs(brief: Brief) -> list[dict]:
    """A brief's sources with the trade's map tags, where a source names none of its own."""
    packs = [brief.trade_packs[p] for p in brief.trade_ids if p in brief.trade_packs]
    own = list(dict.fromkeys(t for p in packs for t in p.get("osm_tags") or []))
    specs = []
    for given in brief.sources:
        spec = dict(given) if isinstance(given, dict) else {"id": given}
        options = dict(spec.get("options") or {})
        if own and source_id(spec) == "osm":
            options.setdefault("tags", own)
        specs.append({**spec, "options": options})
    return specs


def execute(spark: SparkSession, brief: Brief, inputs: Inputs | None = None, *, resume: DataFrame | None = None,
            out: str | None = None, run_id: str | None = None) -> Execution:
    """Runs a brief.

    Each source is landed once, so that one which breaks while it is read costs
    its own rows alone. ``resume`` holds an earlier attempt's verdicts: decided
    rows are not judged again. ``out`` is a folder for the results as CSV;
    with ``run_id`` the run is recorded in the inputs' ledger, its verdicts with it.
    """
    inputs = inputs or Inputs()
    book = inputs.ledger if run_id else None
    if run_id and book is None:
        raise ValueError("a run_id needs a ledger in the inputs")
    began = time.time()
    if book:
        book.record_run(run_id, brief.name, "running", began)
    try:
        done = _executed(spark, brief, inputs, resume, began)
        if out:
            if brief.output.get("split_by"):
                files.write_split(done.results, out, brief.output)
            else:
                files.write_csv(done.results, out, brief.output)
        if book:
            book.save(run_id, done.verdicts.filter(F.col("fate") != "unreached"))
            row = done.stats.select("status", F.to_json(F.struct("*")).alias("told")).first()       # one row of counts
            book.update_stats(run_id, row.told)
            book.set_state(run_id, row.status, time.time())
    except Exception:
        if book:
            book.set_state(run_id, "failed", time.time())
        raise
    return done


def _executed(spark: SparkSession, brief: Brief, inputs: Inputs, resume: DataFrame | None, began: float) -> Execution:
    listings, report = sources.read_all(spark, source_specs(brief), planned(spark, brief), land=True)
    found = first_seen(listings)
    hidden = withheld(spark, brief, inputs)
    if hidden is not None:
        inputs = replace(inputs, suppressions=hidden)
        brief = replace(brief, suppress={k: v for k, v in brief.suppress.items() if k == "after"})
    todo = found if resume is None else memory.undecided(found, resume)
    judged = marked(todo, brief, inputs, dedupe=False)
    fated, stop = ordered.limited(judged, **limits(brief))
    verdicts = settle(fated, "run")
    results = shaping.shape(shaping.best_first(verdicts.filter(F.col("fate") == "shown")), brief.output)
    row = stats.full_stats(
        verdicts, listings, report, stop,
        withheld=None if hidden is None else memory.suppressed(todo, hidden, brief.suppress.get("after"), inputs.now),
        resumed=resume, elapsed_seconds=time.time() - began)
    return Execution(verdicts, results, report, settle(row, "stats"))
