"""Whole runs: a brief from its sources to its results, budgets, failures, replays."""

from __future__ import annotations

import contextlib

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline import Brief, Inputs
from sieveline.model import conform, measurement
from sieveline.operators import page_signals, registry, stats
from sieveline.plans.execute import execute
from sieveline.plans.judge import judge, run
from sieveline.sources import registry as sources
from sieveline.streaming import qualify
from workload import briefs as B
from workload import inputs as I
from workload import oracle_parts as O
from workload.judging_queries import SITES
from workload.landing_queries import _landed_stream, folder
from workload.registry import query
from workload.signal_queries import READABLE, emails_sql, now

TABLE, TORN = "listing_table", "torn_table"


@contextlib.contextmanager
def table_sources():
    """Two sources of this workload's own: listings in a table, and a table that breaks while it is read."""
    from sieveline.reference_data import SOURCE_CAPS
    from sieveline.sources.registry import _READERS

    @sources.source(TABLE)
    def table(spark, options):
        return conform(spark.read.parquet(options["path"]))

    @sources.source(TORN)
    def torn(spark, options):
        rows = conform(spark.read.parquet(options["path"]))
        return rows.withColumn("name", F.when(F.col("ord") % 5 == 3, F.raise_error(F.lit("a torn row")).cast("string"))
                               .otherwise(F.col("name")))
    try:
        yield
    finally:
        for name in (TABLE, TORN):
            _READERS.pop(name), SOURCE_CAPS.pop(name)


def specs(spark, sf):
    """Every offered listing landed as one table, and the same once more in a source that breaks half way."""
    path = folder(spark, "offered")
    I.offered(spark, sf).write.parquet(path)
    return [{"id": TORN, "options": {"path": path}}, {"id": TABLE, "options": {"path": path}},
            {"id": TABLE, "enabled": False}]


@query("u2_source_failures", f"""WITH {I.OFFERED_CTE} SELECT '{TABLE}' AS source, 'ok' AS status, (SELECT count(*) FROM offered) AS found
   UNION ALL SELECT '{TORN}', 'fatal', 0""")
def u2_failures(spark, sf):
    """A source that breaks while its rows are read costs its own rows alone, and is reported."""
    with table_sources():
        rows, report = sources.read_all(spark, specs(spark, sf), land=True)
    found = rows.groupBy((F.shiftright("ord", 57)).alias("at")).agg(F.count(F.lit(1)).alias("found"))
    found = found.select(F.lit(TABLE).alias("source"), "found")
    return report.join(found, "source", "left").select("source", "status", F.coalesce("found", F.lit(0).cast("long")).alias("found"))


def whole_run(spark, sf, output=None):
    """The dentist brief over both sources: two ids withheld, an earlier attempt resumed, stopped at forty results."""
    with table_sources():
        brief = Brief.of({**B.DENTISTS, "sources": B.FILE, "limits": {"max_results": 40, "breaker": {"rate": 1.0}},
                          "suppress": {"cids": ["CUST:4", "cust:25"]}, "output": output or {}}, I.YEAR)
        brief.sources = specs(spark, sf)
        earlier = judge(I.listings(spark, sf).filter("ord % 9 = 0"), brief, dedupe=False)
        return execute(spark, brief, resume=earlier)


RUN = f"""WITH {I.LISTINGS_CTE},\n{O.dentist_cte(8)},
  todo AS (SELECT * FROM verdicts WHERE cid NOT IN ('cust:4', 'cust:25') AND (ord % 9 <> 0 OR outcome = 'unevaluated')),
  counted AS (SELECT *, sum((outcome = 'qualified')::INT) OVER (ORDER BY ord) AS q FROM todo),
  cap AS (SELECT min(ord) AS last FROM counted WHERE q >= 40),
  reached AS (SELECT counted.* FROM counted, cap WHERE last IS NULL OR ord <= last)"""


@query("e1_brief_results", RUN + """ SELECT cid, score, row_number() OVER (ORDER BY score DESC, ord) AS place FROM reached
   WHERE outcome = 'qualified' AND score >= 50 ORDER BY score DESC, ord LIMIT 25""")
def e1(spark, sf):
    """A brief run from its sources to its results."""
    results = whole_run(spark, sf, {"min_score": 50, "sort": "score", "top": 25}).results.select("cid", "score", "ord")
    place = F.row_number().over(W.orderBy(F.col("score").desc(), "ord")).cast("long")         # of 25 rows
    return results.withColumn("place", place).select("cid", "score", "place")


@query("a1_full_stats", RUN + f""", o AS (SELECT count(*) + (SELECT count(*) FROM listings WHERE ord % 7 = 0) AS n FROM listings)
  SELECT (SELECT n FROM o) AS discovered, count(*) AS deduped, count(*) FILTER (WHERE outcome = 'qualified') AS qualified,
    count(*) FILTER (WHERE outcome = 'rejected') AS rejected, count(*) FILTER (WHERE outcome = 'unevaluated') AS unevaluated,
    count(*) FILTER (WHERE rejected_by = 'trade_match') AS by_trade, 2::BIGINT AS suppressed,
    (SELECT count(*) FROM verdicts WHERE ord % 9 = 0 AND outcome <> 'unevaluated') AS resumed,
    (SELECT count(*) FROM todo) - count(*) AS unreached,
    CASE WHEN (SELECT last FROM cap) IS NOT NULL THEN 'result cap reached' END AS stopped_reason, 'partial' AS status,
    '{TORN}' AS failed FROM reached""")
def a1_full(spark, sf):
    """What a run counts: found, judged, withheld, resumed, rejected by each rule, and why it stopped."""
    row = whole_run(spark, sf).stats
    by = F.coalesce(F.try_element_at("rejected_by", F.lit("trade_match")), F.lit(0).cast("long"))
    return row.select("discovered", "deduped", "qualified", "rejected", "unevaluated", by.alias("by_trade"), "suppressed", "resumed",
                      "unreached", "stopped_reason", "status", F.array_join(F.map_keys("source_errors"), ",").alias("failed"))


@query("a7_report_lines", """WITH r AS (SELECT 's' || c_nationkey % 3 AS source, 'p' || c_nationkey AS place,
    CASE WHEN c_custkey % 10 = 0 THEN 'failed' WHEN c_custkey % 10 = 1 THEN 'empty' WHEN c_custkey % 10 = 2 THEN 'note'
         WHEN c_custkey % 50 = 3 THEN 'fatal' ELSE 'ok' END AS status, 'why ' || c_mktsegment AS why FROM customer)
  SELECT CASE status WHEN 'failed' THEN 'skipped' ELSE 'empty' END AS kind, source || '/' || place AS what, max(why) AS why
  FROM r WHERE status IN ('failed', 'empty') GROUP BY 1, 2
  UNION ALL SELECT DISTINCT 'note', source || ': ' || why, NULL FROM r WHERE status = 'note'
  UNION ALL SELECT 'error', source, string_agg(DISTINCT why, '; ' ORDER BY why) FROM r WHERE status = 'fatal' GROUP BY source""")
def a7_lines(spark, sf):
    k = F.col("c_custkey")
    status = (F.when(k % 10 == 0, "failed").when(k % 10 == 1, "empty").when(k % 10 == 2, "note").when(k % 50 == 3, "fatal")
              .otherwise("ok"))
    return stats.report_lines(I.read(spark, sf, "customer").select(
        F.concat(F.lit("s"), (F.col("c_nationkey") % 3).cast("string")).alias("source"),
        F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("place"), status.alias("status"),
        F.concat(F.lit("why "), F.col("c_mktsegment")).alias("why")))


@query("w5_budgeted_run", SITES + """, c AS (SELECT *, sum(CASE WHEN n >= 10 AND website IS NOT NULL THEN requests ELSE 0 END)
     OVER (ORDER BY page_id) AS spent FROM v), s AS (SELECT min(page_id) AS stop FROM c WHERE spent >= 20)
  SELECT cid, outcome, CASE WHEN page_id > stop THEN 'unreached' ELSE 'shown' END AS fate FROM c, s""")
def w5_run(spark, sf):
    """A run that stops after the row spending the last of its budget; a row the free rules settled costs nothing."""
    brief = B.site_brief()
    brief.limits = {"max_requests": 20, "breaker": {"rate": 1.01}}
    return run(I.page_listings(spark, sf), brief, Inputs(site_pages=I.site_pages(spark, sf), now=now()), dedupe=False).select(
        "cid", "outcome", "fate")


@query("c4_mail_checked", f"""WITH {I.SITE_CTE}, e AS (SELECT *, {emails_sql("html")} AS found FROM site),
   a AS (SELECT *, error IS NULL AND website IS NOT NULL AND ({READABLE}) AS read, length(split_part(found[1], '@', 2)) % 3 AS r FROM e)
   SELECT cid, CASE WHEN read THEN found[1] WHEN error IS NOT NULL AND website IS NOT NULL THEN 'unknown' END AS vstr,
     CASE WHEN website IS NULL THEN 1.0::DOUBLE WHEN error IS NOT NULL THEN 0.0::DOUBLE WHEN NOT read THEN 0.5::DOUBLE
       WHEN found[1] IS NOT NULL AND r = 1 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS confidence,
     CASE WHEN read AND found[1] IS NOT NULL AND r <> 2 THEN r = 0 END AS mail_server FROM a""")
def c4_mail(spark, sf):
    """Addresses whose domain cannot receive mail count half; unanswered domains stay unknown."""
    ctx = registry.Context(this_year=F.lit(I.YEAR))
    df = page_signals.with_pages_of(I.page_listings(spark, sf), I.site_pages(spark, sf), True, ctx.this_year, now())
    domain = F.lower(F.substring_index(F.try_element_at(page_signals.shown_emails(), F.lit(1)), "@", -1))
    r = F.length("domain") % 3
    answers = df.select(domain.alias("domain")).filter("domain IS NOT NULL").distinct().filter(r != 2).select(
        F.upper("domain").alias("domain"), F.when(r == 0, 2).otherwise(0).alias("mx_count"), F.lit(False).alias("has_a"))
    out = registry.add_signals(page_signals.with_mail_check(df, answers), ["site_contact"], ctx)
    s = F.col("signals")["site_contact"]
    return out.select("cid", s["vstr"].alias("vstr"), s["confidence"].alias("confidence"),
                      s["evidence"]["mail_server"].alias("mail_server"))


@query("d1_plugin_signal", f"""WITH {I.LISTINGS_CTE} SELECT cid, CASE WHEN review_count IS NULL THEN 'unmeasurable:busy'
    WHEN review_count < 10 THEN 'busy' END AS rejected_by FROM listings""")
def d1(spark, sf):
    """A signal of one's own in a brief's rules."""
    @registry.signal("busy", kind="boolean")
    def busy(ctx):
        n = F.col("review_count")
        return measurement(vbool=n >= 10, error=F.when(n.isNull(), F.lit("no reviews told")))
    try:
        brief = Brief.of({"sources": B.FILE, "filters": [{"signal": "busy", "op": "==", "value": True}]}, I.YEAR)
        return judge(I.listings(spark, sf), brief, dedupe=False).select("cid", "rejected_by")
    finally:
        registry.unregister("busy")


# ---- streams ----------------------------------------------------------------

@query("t6_replayed_batch", O.dentists("SELECT cid, outcome, score FROM verdicts"))
def t6(spark, sf):
    """A stream that was killed before its last batch was marked done replays that batch and adds nothing."""
    out, mark = folder(spark, "streamed"), folder(spark, "mark")
    stream = qualify.fresh(_landed_stream(spark, sf))
    qualify.run_for(qualify.start(stream, B.dentists(), out, mark, single=False), None)
    commits = spark._jvm.org.apache.hadoop.fs.Path(f"{mark}/commits")
    fs = commits.getFileSystem(spark._jsc.hadoopConfiguration())
    batches = [f.getPath() for f in fs.listStatus(commits) if f.getPath().getName().isdigit()]
    fs.delete(max(batches, key=lambda p: int(p.getName())), False)
    again = qualify.start(stream, B.dentists(), out, mark, single=False)
    qualify.run_for(again, None)
    if not again.recentProgress:
        raise RuntimeError("no batch was replayed")
    return spark.read.parquet(out).select("cid", "outcome", "score")


@query("t8_progress", O.dentists("""SELECT count(*) AS found, count(*) FILTER (WHERE outcome = 'qualified') AS qualified,
   count(*) FILTER (WHERE outcome = 'rejected') AS rejected FROM verdicts"""))
def t8(spark, sf):
    """The counts a stream's batches report while it runs, summed up."""
    stream = qualify.with_progress(qualify.judged(qualify.fresh(_landed_stream(spark, sf)), B.dentists()).select("outcome"))
    q = (stream.writeStream.format("noop").option("checkpointLocation", folder(spark, "mark")).trigger(availableNow=True).start())
    q.awaitTermination()
    told = [p.observedMetrics["progress"].asDict() for p in q.recentProgress if "progress" in p.observedMetrics]
    return spark.createDataFrame(told, "found long, qualified long, rejected long").groupBy().agg(
        *[F.sum(c).alias(c) for c in ("found", "qualified", "rejected")])
