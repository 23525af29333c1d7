"""Rules, scores, order, windows, joins between runs, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline import Brief, Inputs, judge
from sieveline.model import LISTING_FIELDS
from sieveline.operators import (health, listings, memory, ordered, page_signals, places, reviews,
                                 rules, scoring, shaping, stats)
from sieveline.plans.judge import estimate, measure_free, requalify, run
from sieveline.session import settle
from sieveline.sinks import ledger
from workload import briefs as B
from workload import inputs as I
from workload import oracle_parts as O
from workload.registry import query
from workload.signal_queries import PHRASES, READABLE, WORDS, now


def verdicts(spark, sf, brief=None):
    return judge(I.listings(spark, sf), brief or B.dentists(), dedupe=False)


def stored(spark, sf, *cols):
    """An earlier run under stricter rules, read back from where it was written."""
    return settle(verdicts(spark, sf, B.stricter()).select(*cols), "stored-run")


# ---- rules ------------------------------------------------------------------

def ruled(spark, sf, *rule, only=("reviews", "liveness", "contactable", "rating_band", "web_presence",
                                  "review_velocity", "establishment_age")):
    used = Brief(filters=list(rule)).referenced
    m = measure_free(I.listings(spark, sf), B.measuring(only=[n for n in only if n in used]))
    return rules.evaluate(m, list(rule)).select("cid", "outcome", "rejected_by")


def _three(case: str) -> str:
    return f"""WITH {I.LISTINGS_CTE}, r AS (SELECT cid, {case} AS rejected_by FROM listings)
      SELECT cid, rejected_by, CASE WHEN rejected_by IS NULL THEN 'qualified'
        WHEN starts_with(rejected_by, 'unmeasurable:') THEN 'unevaluated' ELSE 'rejected' END AS outcome FROM r"""


REACH = ("(trim(coalesce(phone, '')) <> '' OR trim(coalesce(website, '')) <> '' OR trim(coalesce(booking_url, '')) <> '' "
         "OR email IS NOT NULL)")


@query("r1_equality", _three(f"""CASE WHEN NOT {REACH} THEN 'contactable'
   WHEN review_count IS NULL THEN 'unmeasurable:reviews' WHEN review_count = 3 THEN 'reviews' END"""))
def r1(spark, sf):
    """``true`` equals the number 1; null is a value that differs from 3."""
    return ruled(spark, sf, {"signal": "contactable", "op": "==", "value": 1},
                 {"signal": "reviews", "op": "!=", "value": None}, {"signal": "reviews", "op": "!=", "value": 3})


@query("r2_membership", _three(f"""CASE WHEN {O.LIVENESS} NOT IN ('open', 'stale') THEN 'liveness'
   WHEN review_count IN (2, 4, 6) THEN 'reviews' END"""))
def r2(spark, sf):
    return ruled(spark, sf, {"signal": "liveness", "op": "in", "value": ["open", "stale", 5, None]},
                 {"signal": "reviews", "op": "not in", "value": [2, 4, 6, "8"]})


@query("r3_truthiness", _three("CASE WHEN review_count IS NULL THEN 'unmeasurable:reviews' "
                               "WHEN review_count = 0 THEN 'reviews' END"))
def r3(spark, sf):
    return ruled(spark, sf, {"signal": "reviews", "op": "is", "value": True},
                 {"signal": "liveness", "op": "is", "value": "anything"})


@query("r4_ordering", _three(f"""CASE WHEN review_count IS NULL THEN 'unmeasurable:reviews'
   WHEN review_count < 5 THEN 'reviews' WHEN review_count >= 15 THEN 'reviews' WHEN NOT {REACH} THEN 'contactable' END"""))
def r4(spark, sf):
    """Bounds given as text still compare as numbers; a boolean counts as 1 or 0."""
    return ruled(spark, sf, {"signal": "reviews", "op": ">=", "value": "5"}, {"signal": "reviews", "op": "<", "value": 15},
                 {"signal": "contactable", "op": ">", "value": 0})


@query("r5_evidence_path", _three(f"""CASE WHEN first_review_year IS NULL THEN 'unmeasurable:establishment_age.approx_age_years'
   WHEN {I.YEAR} - first_review_year < 31 THEN 'establishment_age.approx_age_years' END"""))
def r5(spark, sf):
    return ruled(spark, sf, {"signal": "establishment_age.approx_age_years", "op": ">=", "value": 31})


@query("r6_first_failure", O.dentists("""SELECT cid, outcome, rejected_by, CASE rejected_by
   WHEN 'trade_match' THEN 'trade_match is False, needs != False'
   WHEN 'web_presence' THEN 'web_presence is ''' || web_presence || ''', needs != ''owned_domain'''
   WHEN 'reviews' THEN 'reviews is ' || review_count || ', needs >= 8'
   WHEN 'unmeasurable:reviews' THEN 'reviews is unknown (no review count on the record: unknown, not zero): not judged'
   WHEN 'liveness' THEN 'liveness is ''' || liveness || ''', needs not in [''perm_closed'', ''temp_closed'']' END AS reject_reason FROM verdicts"""))
def r6(spark, sf):
    return verdicts(spark, sf).select("cid", "outcome", "rejected_by", "reject_reason")


@query("r7_unmeasurable", _three("""CASE WHEN (rating < 0 OR rating > 5) IS TRUE THEN 'unmeasurable:rating_band'
   WHEN rating IS NULL OR review_count < 5 OR rating < 4.5 THEN 'rating_band'
   WHEN review_count IS NULL OR first_review_year IS NULL THEN 'unmeasurable:review_velocity'
   WHEN round(review_count::DOUBLE / greatest(1.0::DOUBLE, (2026 - first_review_year + 1)::DOUBLE), 2) < 0.3 THEN 'review_velocity' END"""))
def r7(spark, sf):
    """A broken measurement and a null answer leave a row unjudged."""
    return ruled(spark, sf, {"signal": "rating_band", "op": "==", "value": "excellent"},
                 {"signal": "review_velocity", "op": ">=", "value": 0.3})


@query("r8_groups", _three(f"""CASE
   WHEN NOT coalesce(review_count >= 12, false) AND {O.RATING_BAND} NOT IN ('excellent') THEN
     CASE WHEN review_count IS NULL AND (rating < 0 OR rating > 5) IS TRUE THEN 'unmeasurable:reviews' ELSE 'group:any' END
   WHEN NOT ({O.LIVENESS} <> 'perm_closed' AND {REACH}) THEN 'group:all' END"""))
def r8(spark, sf):
    return ruled(spark, sf, {"group": "any", "of": [{"signal": "reviews", "op": ">=", "value": 12},
                                                    {"signal": "rating_band", "op": "==", "value": "excellent"}]},
                 {"group": "all", "of": [{"signal": "liveness", "op": "!=", "value": "perm_closed"},
                                         {"group": "any", "of": [{"signal": "contactable", "op": "==", "value": True}]}]})


SITES = f"""WITH {I.SITE_CTE}, m AS (SELECT *, page_id AS n,
    CASE WHEN website IS NULL THEN 'no_site' WHEN error IS NOT NULL THEN NULL WHEN status = 503 THEN 'unknown'
      WHEN status IN (404, 403) THEN 'dead' WHEN {PHRASES} THEN 'placeholder' WHEN {WORDS} < 40 THEN 'placeholder'
      ELSE 'live' END AS site_status, ({READABLE}) AS good,
    regexp_matches(html, '(?i)<meta[^>]+name\\s*=\\s*["'']?viewport') AS mobile FROM site),
  r AS (SELECT *, CASE WHEN n < 10 THEN 'reviews'
      WHEN error IS NOT NULL AND website IS NOT NULL THEN 'unmeasurable:site_status'
      WHEN site_status NOT IN ('live', 'dead', 'placeholder') THEN 'site_status'
      WHEN NOT good OR NOT starts_with(url, 'https:') THEN 'site_https' END AS rejected_by FROM m),
  v AS (SELECT *, CASE WHEN rejected_by IS NULL THEN 'qualified' WHEN starts_with(rejected_by, 'unmeasurable:')
      THEN 'unevaluated' ELSE 'rejected' END AS outcome FROM r)"""


@query("r9_staged_tiers", SITES + """ SELECT cid, outcome, rejected_by, CASE WHEN outcome = 'qualified' THEN
    round((0.0::DOUBLE + CASE WHEN mobile THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END
      + CASE site_status WHEN 'live' THEN 20.0::DOUBLE WHEN 'dead' THEN 40.0::DOUBLE ELSE 0.0::DOUBLE END
      + 30.0::DOUBLE * (log10(least(n, 300)::DOUBLE + 1) / log10(301.0::DOUBLE))) / 80.0::DOUBLE * 100.0::DOUBLE, 1) END AS score FROM v""")
def r9(spark, sf):
    """Page rules judge only what the free rules left; every row settles once."""
    return judge(I.page_listings(spark, sf), B.site_brief(), Inputs(site_pages=I.site_pages(spark, sf), now=now()),
                 dedupe=False).select("cid", "outcome", "rejected_by", "score")


@query("r10_search", O.dentists("""SELECT cid, outcome FROM verdicts WHERE outcome = 'rejected' AND
   (contains(lower(coalesce(name, '')), 'nation_1') OR contains(lower(coalesce(category, '')), 'nation_1')
    OR contains(lower(coalesce(address, '')), 'nation_1'))"""))
def r10(spark, sf):
    return shaping.search(verdicts(spark, sf), "NATION_1", qualified=False).select("cid", "outcome")


@query("r11_min_score", O.dentists("SELECT cid, score FROM verdicts WHERE coalesce(score, 0) >= 75"))
def r11(spark, sf):
    return shaping.shape(verdicts(spark, sf), {"min_score": 75, "sort": "none"}).select("cid", "score")


# ---- scoring ----------------------------------------------------------------

def scored(spark, sf, weights, **kw):
    used = sorted({w.split(".")[0] for w in weights})
    m = measure_free(I.listings(spark, sf), B.measuring("trades/dentist", only=used))
    return scoring.score(m, weights, **kw)


@query("g1_flat_weight", f"""WITH {I.LISTINGS_CTE} SELECT cid, CASE WHEN {REACH} THEN 12.0::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN coalesce(review_count, 0) <> 0 THEN 7.0::DOUBLE ELSE 0.0::DOUBLE END + 3.0::DOUBLE AS score FROM listings""")
def g1(spark, sf):
    return scored(spark, sf, {"contactable": 12, "reviews": 7, "liveness": 3}, normalise=False).select("cid", "score")


@query("g2_value_weights", f"""WITH {I.LISTINGS_CTE} SELECT cid, CASE {O.LIVENESS} WHEN 'open' THEN 9.0::DOUBLE
    WHEN 'stale' THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN {REACH} THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END
    + CASE WHEN review_count = 7 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM listings""")
def g2(spark, sf):
    return scored(spark, sf, {"liveness": {"open": 9, "stale": 4}, "contactable": {True: 2, "False": 1},
                              "reviews": {7: 5}}, normalise=False).select("cid", "score")


@query("g3_scaled_weights", f"""WITH {I.LISTINGS_CTE},\n{O.chain_cte('listings')} SELECT cid,
    round(CASE WHEN review_count IS NULL THEN 0.0::DOUBLE ELSE 30.0::DOUBLE * (least(review_count, 10)::DOUBLE / 10.0::DOUBLE) END, 2) AS linear,
    round(CASE WHEN chain_key = '' THEN 0.0::DOUBLE ELSE 25.0::DOUBLE * (1.0::DOUBLE - log10(least(coalesce(brand_n, chain_n), 1000)::DOUBLE + 1.0::DOUBLE)
      / log10(1001.0::DOUBLE)) END, 2) AS inverted FROM chained""")
def g3(spark, sf):
    out = scored(spark, sf, {"reviews": {"weight": 30, "cap": 10},
                             "chain_size": {"weight": 25, "scale": "log", "cap": 1000, "invert": True}})
    return out.select("cid", F.col("breakdown")["reviews"].alias("linear"), F.col("breakdown")["chain_size"].alias("inverted"))


@query("g4_score_breakdown", O.dentists("""SELECT cid, score, pts_web, pts_reviews FROM verdicts"""))
def g4(spark, sf):
    b = F.col("breakdown")
    return verdicts(spark, sf).select("cid", "score", F.try_element_at(b, F.lit("web_presence")).alias("pts_web"),
                                      F.try_element_at(b, F.lit("reviews")).alias("pts_reviews"))


@query("g4_confidence_weighted", f"""WITH {I.LISTINGS_CTE},\n{O.trade_cte(['trades/dentist'], 'listings')} SELECT cid,
    round((0.0::DOUBLE + CASE WHEN trade_hit IS NULL THEN 0.0::DOUBLE ELSE 60.0::DOUBLE * trade_conf END
     + 40.0::DOUBLE * CASE WHEN {O.LIVENESS} = 'stale' THEN 0.5::DOUBLE WHEN {O.LIVENESS} = 'open' AND trim(coalesce(status_raw, '')) = ''
       THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END) / 100.0::DOUBLE * 100.0::DOUBLE, 1) AS score FROM trade""")
def g4_conf(spark, sf):
    return scored(spark, sf, {"trade_match": 60, "liveness": 40}, confidence=True).select("cid", "score")


@query("g5_bands", O.dentists("""SELECT cid, CASE WHEN score >= 75 THEN 'first' WHEN score >= 60 THEN 'next'
   WHEN score >= 0 THEN 'later' END AS band FROM verdicts"""))
def g5(spark, sf):
    return verdicts(spark, sf).select("cid", "band")


@query("g6_rescore", O.dentists("""SELECT cid, round((0.0::DOUBLE + 60.0::DOUBLE * (least(review_count, 20)::DOUBLE / 20.0::DOUBLE)
    + CASE WHEN REACH THEN 40.0::DOUBLE ELSE 0.0::DOUBLE END) / 100.0::DOUBLE * 100.0::DOUBLE, 1) AS score, CASE WHEN round((0.0::DOUBLE + 60.0::DOUBLE *
    (least(review_count, 20)::DOUBLE / 20.0::DOUBLE) + CASE WHEN REACH THEN 40.0::DOUBLE ELSE 0.0::DOUBLE END) / 100.0::DOUBLE * 100.0::DOUBLE, 1) >= 75 THEN 'hot' ELSE 'cold' END AS band
  FROM verdicts WHERE outcome = 'qualified'""".replace("REACH", REACH)))
def g6(spark, sf):
    return scoring.rescore(verdicts(spark, sf), {"reviews": {"weight": 60, "cap": 20}, "contactable": 40, }, bands=[
        {"min": 75, "label": "hot"}, {"from": 0, "label": "cold"}]).select("cid", "score", "band")


@query("g7_requalify", O.two_runs("""SELECT n.cid, n.name, o.outcome AS was, n.outcome AS now FROM verdicts n
   JOIN old o USING (cid) WHERE n.outcome <> o.outcome"""))
def g7(spark, sf):
    """A stored run judged by today's rules: what would change."""
    old = stored(spark, sf, *LISTING_FIELDS, "outcome")
    return memory.changes(old, requalify(old, B.dentists())).select("cid", "name", "was", "now")


@query("g8_estimate", SITES + """, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE page_id >= 10) AS alive FROM m)
  SELECT 'free' AS tier, 11 AS n_signals, n AS rows_in FROM t UNION ALL SELECT 'cheap', 3, alive FROM t
  UNION ALL SELECT 'expensive', 0, 0 FROM t""")
def g8(spark, sf):
    return estimate(I.page_listings(spark, sf), B.site_brief()).select("tier", "n_signals", "rows_in")


@query("p12_explain", O.dentists("""SELECT cid, signal, points, row_number() OVER (PARTITION BY cid ORDER BY points DESC, i) - 1 AS pos
  FROM (SELECT cid, 'web_presence' AS signal, pts_web AS points, 1 AS i FROM verdicts WHERE outcome = 'qualified'
   UNION ALL SELECT cid, 'reviews', pts_reviews, 0 FROM verdicts WHERE outcome = 'qualified'
   UNION ALL SELECT cid, 'trade_match', 20.0::DOUBLE, 2 FROM verdicts WHERE outcome = 'qualified')"""))
def p12(spark, sf):
    return scoring.explain(verdicts(spark, sf)).select("cid", "signal", "points", F.col("pos").cast("long").alias("pos"))


# ---- order, pages, limits ---------------------------------------------------

@query("o1_best_first", O.dentists("""SELECT cid, name, outcome, score, rejected_by,
   row_number() OVER (ORDER BY outcome = 'qualified' DESC, coalesce(score, 0) DESC, ord) AS place FROM verdicts"""))
def o1(spark, sf):
    """Every listing judged and ranked: the flagship query."""
    judged = verdicts(spark, sf).select("cid", "name", "outcome", "score", "rejected_by", "ord")
    return shaping.placed(settle(judged, "judged")).drop("ord")


@query("o2_shape_top", O.dentists("""SELECT cid, score FROM verdicts WHERE coalesce(score, 0) >= 60
   ORDER BY coalesce(score, 0) DESC, ord LIMIT 25"""))
def o2(spark, sf):
    return shaping.shape(verdicts(spark, sf), {"min_score": 60, "top": 25}).select("cid", "score")


@query("o3_results_page", O.dentists("""SELECT cid, name, score FROM verdicts ORDER BY coalesce(score, 0) DESC, cid
   LIMIT 200 OFFSET 20"""))
def o3(spark, sf):
    return shaping.page(verdicts(spark, sf), "score", 200, 20).select("cid", "name", "score")


@query("o3_page_by_name", O.dentists("SELECT cid, name FROM verdicts ORDER BY lower(coalesce(name, '')), cid LIMIT 50"))
def o3_name(spark, sf):
    return shaping.page(verdicts(spark, sf), "name", 50).select("cid", "name")


@query("o3_deep_page", O.dentists("""SELECT cid, name FROM verdicts ORDER BY lower(coalesce(name, '')), cid LIMIT 40 OFFSET 600"""))
def o3_deep(spark, sf):
    """A page far into the order, from the ranges it lies in."""
    return shaping.Pages(settle(verdicts(spark, sf)), "name", 300).page(40, 600).select("cid", "name")


@query("w1_first_seen", f"""WITH {I.OFFERED_CTE} SELECT lower(cid) AS cid, arg_min(name, ord) AS name, arg_min(source, ord) AS source
   FROM offered GROUP BY 1""")
def w1(spark, sf):
    return listings.first_seen(I.offered(spark, sf)).select("cid", "name", "source")


@query("w2_latest", "SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice "
       "FROM orders GROUP BY 1")
def w2(spark, sf):
    return listings.latest(I.read(spark, sf, "orders"), "o_custkey", "o_orderkey").select(
        "o_custkey", "o_orderkey", "o_totalprice")


@query("w4_result_cap", O.dentists("""SELECT cid, outcome FROM (SELECT *, sum(CASE WHEN outcome = 'qualified' THEN 1 ELSE 0 END)
   OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM verdicts)
   WHERE coalesce(before, 0) < 20"""))
def w4(spark, sf):
    judged = settle(verdicts(spark, sf).select("cid", "ord", "outcome"), "judged")
    return ordered.result_cap(judged, 20).select("cid", "outcome")


@query("w5_spend_budget", f"""WITH {I.SITE_CTE}, s AS (SELECT cid, sum(requests) OVER (ORDER BY page_id) AS spent FROM site
   WHERE website IS NOT NULL) SELECT cid, spent::BIGINT AS spent, spent <= 120 AS affordable FROM s""")
def w5(spark, sf):
    """Lookups in discovery order until 120 are charged."""
    df = page_signals.with_pages(I.page_listings(spark, sf), page_signals.site_facts(I.site_pages(spark, sf), F.lit(I.YEAR), now()), False)
    paid = df.filter(F.col("_page_url").isNotNull()).select("cid", "ord", F.col("_page")["requests"].alias("requests"))
    return ordered.within_budget(paid, F.col("requests"), 120).select("cid", "spent", "affordable")


TRACE = """t AS (SELECT event_id AS ord, event_type = 'error' AS failed,
    avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER w AS fail_rate, count(*) OVER w AS seen
  FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


@query("w6_breaker_trace", f"""WITH {TRACE} SELECT ord, fail_rate, seen >= 10 AND fail_rate >= 0.4 AS over FROM t""")
def w6(spark, sf):
    return ordered.breaker_trace(I.measured_events(spark, sf), F.col("failed")).select("ord", "fail_rate", "over")


@query("w6_breaker_stop", f"""WITH {TRACE} SELECT ord, failed FROM t WHERE ord <= coalesce(
   (SELECT min(ord) FROM t WHERE seen >= 10 AND fail_rate >= 0.4), 1000000000000)""")
def w6_stop(spark, sf):
    trace = ordered.breaker_trace(I.measured_events(spark, sf), F.col("failed"))
    return ordered.before_trip(trace).select("ord", "failed")


BASE_SQL = """seen AS (SELECT y.*, row_number() OVER (PARTITION BY source ORDER BY pos) AS rn,
    list_sort(list_filter(list(found) OVER (PARTITION BY source ORDER BY pos), lambda c: c >= 1)) AS good,
    avg(found) OVER (PARTITION BY source ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent FROM yields y),
 b AS (SELECT *, CASE WHEN len(good) >= 3 THEN list_median(good[len(good) // 2 + 1:])::DOUBLE END AS baseline FROM seen)"""


@query("w7_search_suspicion", f"""WITH {I.YIELDS_CTE}, {BASE_SQL} SELECT source, place, baseline, CASE WHEN baseline IS NULL THEN NULL
   WHEN found = 0 THEN 'zero' WHEN found IN (10, 20) AND baseline >= found * 2 THEN 'page_cap'
   WHEN found < baseline * 0.6 THEN 'collapse' END AS reason FROM b""")
def w7(spark, sf):
    return health.running_health(I.yields(spark, sf)).select("source", "place", "baseline", "reason")


@query("w8_back_off", f"""WITH {I.YIELDS_CTE}, {BASE_SQL} SELECT source, place, coalesce(rn >= 5 AND recent < baseline * 0.6, false) AS back_off
   FROM b""")
def w8(spark, sf):
    return health.running_health(I.yields(spark, sf)).select("source", "place", "back_off")


@query("a8_discovery_health", f"""WITH {I.YIELDS_CTE}, {BASE_SQL}, r AS (SELECT *, CASE WHEN baseline IS NULL THEN false ELSE
     found = 0 OR (found IN (10, 20) AND baseline >= found * 2) OR found < baseline * 0.6 END AS bad FROM b),
   s AS (SELECT source, count(*) AS searches, sum(found)::BIGINT AS found, count(*) FILTER (WHERE found = 0) AS zero_results,
     count(*) FILTER (WHERE bad) AS suspects, arg_max(baseline, rn) AS baseline FROM r GROUP BY source)
  SELECT *, round(found / (baseline * searches) * 100, 1) AS yield_pct, CASE WHEN baseline IS NULL THEN 'unknown'
    WHEN found / (baseline * searches) >= 0.9 THEN 'healthy' WHEN found / (baseline * searches) >= 0.6 THEN 'degraded'
    ELSE 'throttled' END AS verdict FROM s""")
def a8(spark, sf):
    return health.summary(I.yields(spark, sf)).drop("expected")


@query("w9_review_dedupe", f"""WITH {I.REVIEWS_CTE} SELECT cid, id, ord FROM (SELECT *,
   row_number() OVER (PARTITION BY cid, id ORDER BY ord) AS rn FROM reviews) WHERE rn = 1 OR id IS NULL""")
def w9(spark, sf):
    return reviews.distinct_reviews(I.reviews(spark, sf)).select("cid", "id", "ord")


@query("w9_review_cap", f"""WITH {I.REVIEWS_CTE}, d AS (SELECT *, row_number() OVER (PARTITION BY cid, id ORDER BY ord) AS rn FROM reviews)
   SELECT cid, id, ord FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY ord) AS k FROM d WHERE rn = 1 OR id IS NULL)
   WHERE k <= 4""")
def w9_cap(spark, sf):
    return reviews.distinct_reviews(I.reviews(spark, sf), cap=4).select("cid", "id", "ord")


@query("a12_review_rollup", f"""WITH {I.REVIEWS_CTE} SELECT cid, count(*)::INT AS reviews_fetched, min(year(made))::INT AS first_review_year,
   avg(rating) AS avg_rating, """ + ", ".join(f"count(*) FILTER (WHERE rating = {s}) AS stars_{s}" for s in range(1, 6)) + """
   FROM reviews GROUP BY cid""")
def a12(spark, sf):
    return reviews.rollup(I.reviews(spark, sf))


@query("a12_review_facts", f"""WITH {I.LISTINGS_CTE}, {I.REVIEWS_CTE}, f AS (SELECT cid, count(*)::INT AS n, min(year(made))::INT AS y
   FROM reviews GROUP BY cid) SELECT l.cid, coalesce(reviews_fetched, n)::INT AS reviews_fetched,
   coalesce(first_review_year, y)::INT AS first_review_year FROM listings l LEFT JOIN f USING (cid)""")
def a12_facts(spark, sf):
    return reviews.with_review_facts(I.listings(spark, sf), I.reviews(spark, sf)).select(
        "cid", "reviews_fetched", "first_review_year")


# ---- joins between runs -----------------------------------------------------

@query("j1_suppressed", f"""WITH {I.LISTINGS_CTE}, {I.SUPPRESSIONS_CTE} SELECT cid FROM listings WHERE cid NOT IN (SELECT cid FROM suppressions
   WHERE suppressed_at IS NULL OR epoch(TIMESTAMP '2001-12-31') - epoch(suppressed_at) <= 400 * 86400)""")
def j1(spark, sf):
    return memory.without_suppressed(I.listings(spark, sf), I.suppressions(spark, sf), "400d",
                                     F.lit("2001-12-31").cast("timestamp")).select("cid")


@query("j2_unchanged", O.two_runs("""SELECT n.cid, n.outcome, n.outcome = o.outcome AS hidden, n.outcome <> o.outcome AS resurfaced
   FROM verdicts n JOIN old o USING (cid)"""))
def j2(spark, sf):
    prior = stored(spark, sf, "cid", "outcome")
    return memory.mark_unchanged(verdicts(spark, sf), prior).select("cid", "outcome", "hidden", "resurfaced")


@query("j3_resume", O.dentists("SELECT cid FROM verdicts WHERE outcome = 'unevaluated'"))
def j3(spark, sf):
    return memory.undecided(I.listings(spark, sf), verdicts(spark, sf)).select("cid")


@query("j4_overlay", O.two_runs("""SELECT cid, outcome, 'new' AS origin FROM verdicts WHERE ord % 3 = 0
   UNION ALL SELECT cid, outcome, 'old' FROM old WHERE ord % 3 <> 0"""))
def j4(spark, sf):
    old = stored(spark, sf, "cid", "ord", "outcome").withColumn("origin", F.lit("old"))
    new = verdicts(spark, sf).select("cid", "ord", "outcome").withColumn("origin", F.lit("new")).filter("ord % 3 = 0")
    return memory.overlay(old, new).select("cid", "outcome", "origin")


@query("j5_stored_signals", f"""WITH {I.SITE_CTE} SELECT cid, CASE WHEN {READABLE} THEN starts_with(url, 'https:')
   WHEN website IS NOT NULL AND error LIKE '%certificate%' THEN false END AS https FROM site WHERE page_id >= 10""")
def j5(spark, sf):
    """Paid answers come from the stored run; no page is looked at again."""
    brief = Brief.of({"sources": B.FILE, "filters": [{"signal": "reviews", "op": ">=", "value": 10}],
                      "scoring": {"weights": {"site_https": 10}}}, I.YEAR)
    old = settle(judge(I.page_listings(spark, sf), brief, Inputs(site_pages=I.site_pages(spark, sf), now=now()), dedupe=False))
    again = requalify(old, brief)
    return again.filter(F.col("rejected_by").isNull()).select("cid", F.col("signals")["site_https"]["vbool"].alias("https"))


@query("j12_place_boxes", f"""WITH {I.LISTINGS_CTE}, boxes AS (SELECT n_nationkey AS pos, 'box ' || n_name AS place,
    n_nationkey * 5.0 - 70.5 AS south, n_nationkey * 5.0 - 60.25 AS north, n_nationkey * 5.0 - 165.5 AS west, n_nationkey * 5.0 - 150.25 AS east FROM nation)
   SELECT cid, arg_min(place, pos) AS place FROM listings JOIN boxes ON lat BETWEEN south AND north AND lng BETWEEN west AND east GROUP BY cid""")
def j12(spark, sf):
    n = F.col("n_nationkey")
    boxes = I.read(spark, sf, "nation").select(
        n.alias("pos"), F.concat(F.lit("box "), F.col("n_name")).alias("place"), (n * 5.0 - 70.5).alias("south"),
        (n * 5.0 - 60.25).alias("north"), (n * 5.0 - 165.5).alias("west"), (n * 5.0 - 150.25).alias("east"))
    points = I.listings(spark, sf).withColumn("place_label", F.lit(None).cast("string"))
    return places.in_boxes(points, boxes, 5.0).select("cid", F.col("place_label").alias("place"))


@query("j13_a10_transitions", O.two_runs("""SELECT o.outcome AS was, n.outcome AS now, count(*) AS n FROM verdicts n JOIN old o USING (cid)
   WHERE n.outcome <> o.outcome GROUP BY ALL"""))
def j13(spark, sf):
    return memory.transitions(stored(spark, sf, "cid", "outcome"), verdicts(spark, sf))


HEXED = "'0x1a:0x' || lower(to_hex(ord)) AS hex"


@query("j14_reviews_of", O.dentists("""SELECT '0x1a:0x' || lower(to_hex(o_custkey)) AS cid, o_orderkey AS id, v.name AS business
   FROM orders JOIN verdicts v ON v.ord = o_custkey WHERE outcome = 'qualified' AND o_custkey % 2 = 0"""))
def j14(spark, sf):
    """Reviews of qualified businesses that carry a hex id pair."""
    hexed = lambda c: F.concat(F.lit("0x1a:0x"), F.lower(F.hex(c)))                        # noqa: E731
    v = verdicts(spark, sf).withColumn("cid", F.when(F.col("ord") % 2 == 0, hexed(F.col("ord"))).otherwise(F.col("cid")))
    r = I.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), hexed(F.col("o_custkey")).alias("cid"),
                                           F.lit("x").alias("business"))
    return reviews.reviews_of(r, v).select("cid", "id", "business")


@query("j15_source_gaps", """SELECT s.source, c.signal, c.instead, s.listings FROM (SELECT 'osm' AS source, count(*) AS listings FROM customer
   UNION ALL SELECT 'mapsearch', count(*) FROM customer WHERE c_custkey % 7 = 0) s
   JOIN (VALUES ('osm', 'reviews', NULL), ('mapsearch', 'reviews', 'rating_band')) c(source, signal, instead) USING (source)""")
def j15(spark, sf):
    from sieveline.sources.registry import capabilities
    src = I.offered(spark, sf).withColumn("source", F.when(F.col("source") == "mapsearch", F.col("source")).otherwise(F.lit("osm")))
    sizes = src.groupBy("source").agg(F.count(F.lit(1)).alias("listings"))
    return places.unmeasurable(B.dentists(), capabilities(spark), sizes).join(sizes, "source")


@query("j16_priority_match", """SELECT c_custkey, CASE WHEN contains(lower(c_mktsegment), 'build') THEN 0
   WHEN contains(lower(c_mktsegment), 'mach') THEN 1 END AS rank FROM customer""")
def j16(spark, sf):
    wanted = spark.createDataFrame([("Build", 0), ("mach", 1), ("ch", 2)], "want string, rank int")
    seg = I.read(spark, sf, "customer").withColumn("place", F.col("c_mktsegment"))
    ranks = places.priority_join(seg.select("place").distinct(), wanted)
    return seg.join(ranks, "place", "left").select("c_custkey", "rank")


# ---- places and unions ------------------------------------------------------

@query("u1_places", """SELECT arg_min(place, pos) AS place, min(pos) AS pos FROM (
   SELECT c_mktsegment || ' ' || c_nationkey AS place, c_custkey AS pos FROM customer
   UNION ALL SELECT lower(c_mktsegment) || ' ' || c_nationkey, c_custkey + 1000000 FROM customer)
   WHERE lower(place) NOT IN ('building 3', 'machinery 4') GROUP BY lower(place)""")
def u1(spark, sf):
    c = I.read(spark, sf, "customer")
    where = lambda seg, add: c.select(F.concat(seg, F.lit(" "), F.col("c_nationkey").cast("string")).alias("place"),
                                      (F.col("c_custkey") + F.lit(add)).alias("pos"))
    both = where(F.col("c_mktsegment"), 0).unionByName(where(F.lower("c_mktsegment"), 1000000))
    return places.union_places(both, ["Building 3", "MACHINERY 4"]).select("place", "pos")


@query("u2_sources_union", f"""WITH {I.OFFERED_CTE} SELECT lower(cid) AS cid, source, (source = 'mapsearch')::BIGINT AS source_rank FROM offered""")
def u2(spark, sf):
    every = I.offered(spark, sf)
    out = listings.union_sources(every.filter("source <> 'mapsearch'"), every.filter("source = 'mapsearch'").drop("hours"))
    return out.select("cid", "source", F.shiftright("ord", 57).alias("source_rank"))


@query("u3_suppression_union", f"""WITH {I.SUPPRESSIONS_CTE}, a AS (SELECT cid, suppressed_at, 0 AS r FROM suppressions
   UNION ALL SELECT 'cust:' || c_custkey, NULL, 1 FROM customer WHERE c_custkey % 22 = 11 UNION ALL SELECT 'cust:33', NULL, 2)
   SELECT cid, arg_max(suppressed_at IS NULL, r) AS permanent FROM a GROUP BY cid""")
def u3(spark, sf):
    more = I.read(spark, sf, "customer").filter("c_custkey % 22 = 11").select(
        F.concat(F.lit("CUST:"), F.col("c_custkey").cast("string")).alias("cid"), F.lit(None).cast("timestamp").alias("suppressed_at"))
    return memory.suppression_list(I.suppressions(spark, sf), more, cids=["CUST:33"]).select(
        "cid", F.col("suppressed_at").isNull().alias("permanent"))


@query("u4_remaining_units", f"WITH {I.UNITS_CTE} SELECT kind, key FROM units WHERE state <> 'done'")
def u4(spark, sf):
    u = I.units(spark, sf)
    plan = u.select("kind", "key").unionByName(u.select("kind", "key").filter("key like '%1'"))
    return ledger.remaining_units(plan, u)


@query("u5_tag_union", """SELECT tag, min(pos) AS pos FROM (SELECT 'shop=' || lower(p_type) AS tag, p_partkey AS pos FROM part
   UNION ALL SELECT 'craft=' || lower(p_brand), p_partkey + 1000000 FROM part) GROUP BY tag""")
def u5(spark, sf):
    p = I.read(spark, sf, "part")
    tags = p.select(F.concat(F.lit("shop="), F.lower("p_type")).alias("tag"), F.col("p_partkey").alias("pos")).unionByName(
        p.select(F.concat(F.lit("craft="), F.lower("p_brand")).alias("tag"), (F.col("p_partkey") + 1000000).alias("pos")))
    return listings.distinct_first(tags, "tag", "pos").select("tag", "pos")


@query("o4_place_order", """SELECT place, row_number() OVER (ORDER BY CASE WHEN contains(lower(place), 'nation_2') THEN 0
   WHEN contains(lower(place), '5') THEN 1 ELSE 2 END, pos) AS n FROM (SELECT n_name AS place, n_nationkey AS pos FROM nation)""")
def o4(spark, sf):
    p = I.read(spark, sf, "nation").select(F.col("n_name").alias("place"), F.col("n_nationkey").cast("long").alias("pos"))
    rank = p.withColumn("r", places.priority_rank(F.col("place"), ["nation_2", "5"]) * 1000 + F.col("pos"))
    return ordered.numbered(rank, "r", "n").select("place", "n")


@query("s13_tag_predicate", """SELECT p_partkey, p_type IN ('SMALL') OR p_brand IN ('Brand#4') OR p_size > 30 AS hit FROM part""")
def s13(spark, sf):
    tags = F.map_filter(F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"), F.lit("big"), F.when(
        F.col("p_size") > 30, F.lit("y"))), lambda _, v: v.isNotNull())
    return I.read(spark, sf, "part").select("p_partkey", places.has_tag(tags, ["type=SMALL", "brand=Brand#4", "big"]).alias("hit"))


# ---- statistics -------------------------------------------------------------

@query("a1_run_stats", f"""WITH {I.OFFERED_CTE},\n{O.dentist_cte(8)} SELECT (SELECT count(*) FROM offered) AS discovered, count(*) AS deduped,
   count(*) FILTER (WHERE outcome = 'qualified') AS qualified, count(*) FILTER (WHERE outcome = 'rejected') AS rejected,
   count(*) FILTER (WHERE outcome = 'unevaluated') AS unevaluated,
   round(count(*) FILTER (WHERE outcome = 'qualified')::DOUBLE / count(*) FILTER (WHERE outcome <> 'unevaluated'), 4) AS qualify_rate,
   round(count(*)::DOUBLE / 30.0::DOUBLE * 60, 1) AS per_minute, 'done' AS status FROM verdicts""")
def a1_a3(spark, sf):
    every = I.offered(spark, sf)
    return stats.terminal_status(stats.run_stats(judge(every, B.dentists()), every, 30.0))


@query("a2_rejections", O.dentists("SELECT rejected_by, count(*) AS n FROM verdicts WHERE outcome = 'rejected' GROUP BY 1"))
def a2(spark, sf):
    return stats.rejections(verdicts(spark, sf))


@query("a3_terminal_status", """SELECT count(*) AS places, CASE WHEN count(*) FILTER (WHERE c_nationkey = 3) > 0 THEN 'partial' ELSE 'done' END AS status
   FROM customer""")
def a3(spark, sf):
    report = I.read(spark, sf, "customer").select(F.when(F.col("c_nationkey") == 3, "failed").when(
        F.col("c_nationkey") == 4, "empty").otherwise("ok").alias("status"))
    return stats.terminal_status(report.agg(F.count(F.lit(1)).alias("places")), report)


@query("a6_place_yields", f"""WITH {I.LISTINGS_CTE} SELECT 'NATION_' || i AS place, count(cid) AS found FROM range(45) t(i)
   LEFT JOIN listings ON place_label = 'NATION_' || i GROUP BY 1""")
def a6(spark, sf):
    plan = spark.range(45).select(F.concat(F.lit("NATION_"), F.col("id").cast("string")).alias("place"))
    return health.place_yields(I.listings(spark, sf), plan).select("place", "found")


@query("a7_source_report", """WITH r AS (SELECT 's' || c_nationkey % 3 AS source, 'p' || c_nationkey AS place,
    CASE WHEN c_custkey % 10 = 0 THEN 'failed' WHEN c_custkey % 10 = 1 THEN 'empty' WHEN c_custkey % 10 = 2 THEN 'note'
         WHEN c_custkey % 50 = 3 THEN 'fatal' ELSE 'ok' END AS status, 'why ' || c_mktsegment AS why FROM customer)
  SELECT source, count(DISTINCT CASE WHEN status = 'failed' THEN place END) AS failed_places,
    count(DISTINCT CASE WHEN status = 'empty' THEN place END) AS empty_places,
    count(DISTINCT CASE WHEN status = 'note' THEN why END) AS notes, min(CASE WHEN status = 'fatal' THEN why END) AS fatal
  FROM r GROUP BY source""")
def a7(spark, sf):
    k = F.col("c_custkey")
    status = (F.when(k % 10 == 0, "failed").when(k % 10 == 1, "empty").when(k % 10 == 2, "note").when(k % 50 == 3, "fatal")
              .otherwise("ok"))
    report = I.read(spark, sf, "customer").select(
        F.concat(F.lit("s"), (F.col("c_nationkey") % 3).cast("string")).alias("source"),
        F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("place"), status.alias("status"),
        F.concat(F.lit("why "), F.col("c_mktsegment")).alias("why"))
    return stats.fold_report(report)


@query("a9_field_coverage", f"""WITH {I.LISTINGS_CTE} SELECT place_label, count(*) AS records, count(review_count) AS review_count,
   count(status_raw) AS status, 0::BIGINT AS hours FROM listings GROUP BY 1""")
def a9(spark, sf):
    return health.field_coverage(I.listings(spark, sf), "place_label")


@query("a11_new_per_unit", """WITH f AS (SELECT o_custkey AS cid, 'u' || month(o_orderdate) AS unit, o_orderkey AS ord FROM orders)
  SELECT unit, count(*) AS fetched, count(*) FILTER (WHERE rn = 1) AS new, count(*) FILTER (WHERE rn > 1) AS duplicates
  FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY ord) AS rn FROM f) GROUP BY unit""")
def a11(spark, sf):
    return stats.new_rows_per_unit(I.read(spark, sf, "orders").select(
        F.col("o_custkey").alias("cid"), F.concat(F.lit("u"), F.month("o_orderdate").cast("string")).alias("unit"),
        F.col("o_orderkey").alias("ord")))


@query("a13_unit_states", f"""WITH {I.UNITS_CTE} SELECT s AS state, count(state) AS n FROM
   (VALUES ('pending'), ('running'), ('done'), ('failed'), ('deferred')) v(s) LEFT JOIN units ON state = s GROUP BY s""")
def a13(spark, sf):
    return stats.unit_counts(I.units(spark, sf))


@query("a13_unit_failures", f"WITH {I.UNITS_CTE} SELECT kind, key, error FROM units WHERE state = 'failed'")
def a13_failed(spark, sf):
    return stats.failed_units(I.units(spark, sf))


@query("a13_pending", f"WITH {I.UNITS_CTE} SELECT count(*) AS pending FROM units WHERE state IN ('pending', 'deferred', 'running')")
def a13_pending(spark, sf):
    return stats.pending_units(I.units(spark, sf))


@query("a14_funnel", O.dentists("""SELECT CASE WHEN outcome = 'rejected' THEN rejected_by ELSE outcome END AS step, count(*) AS n,
   round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM verdicts), 2) AS pct FROM verdicts GROUP BY 1"""))
def a14(spark, sf):
    return stats.funnel(verdicts(spark, sf))


@query("a15_score_distribution", O.dentists("""SELECT least(floor(score / 10) + 1, 10)::BIGINT AS bin, count(*) AS n, min(score) AS low,
   max(score) AS high FROM verdicts WHERE outcome = 'qualified' GROUP BY 1"""))
def a15(spark, sf):
    return stats.score_distribution(verdicts(spark, sf))


@query("a17_failure_rate", """SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS failures,
   count(*) FILTER (WHERE event_type = 'error')::DOUBLE / count(*) AS fail_rate FROM events""")
def a17(spark, sf):
    return health.failure_rate(I.measured_events(spark, sf), F.col("failed"))


@query("a18_outcome_counts", O.dentists("""SELECT o AS outcome, count(outcome) AS n FROM (VALUES ('qualified'), ('rejected'), ('unevaluated')) t(o)
   LEFT JOIN verdicts ON outcome = o GROUP BY 1"""))
def a18(spark, sf):
    return memory.outcome_counts(verdicts(spark, sf))


@query("a20_suppression_report", O.two_runs("""SELECT (SELECT count(*) FROM customer WHERE c_custkey % 11 = 0 AND c_custkey IN (SELECT o_custkey FROM orders)) AS hard_entries,
   (SELECT count(*) FROM customer WHERE c_custkey % 11 = 0 AND c_custkey IN (SELECT o_custkey FROM orders)) AS hidden_hard,
   count(*) FILTER (WHERE n.outcome = o.outcome) AS hidden_soft, count(*) FILTER (WHERE n.outcome <> o.outcome) AS resurfaced
   FROM verdicts n JOIN old o USING (cid)"""))
def a20(spark, sf):
    prior = stored(spark, sf, "cid", "outcome")
    return memory.suppression_report(I.listings(spark, sf), verdicts(spark, sf), I.suppressions(spark, sf), prior)


@query("a21_spend", f"""WITH {I.SITE_CTE} SELECT sum(requests)::BIGINT AS requests, count(*) AS answers, count(*) FILTER (WHERE requests = 0) AS from_cache
   FROM site WHERE website IS NOT NULL""")
def a21(spark, sf):
    df = page_signals.with_pages(I.page_listings(spark, sf), page_signals.site_facts(I.site_pages(spark, sf), F.lit(I.YEAR), now()), False)
    return stats.spend(df.filter(F.col("_page").isNotNull()).select(F.col("_page")["requests"].alias("requests")))


@query("t0_run_with_limits", O.two_runs("""SELECT cid, fate FROM (SELECT n.cid, n.ord, n.outcome = o.outcome AS hidden,
     min(CASE WHEN n.outcome <> o.outcome AND q >= 15 THEN n.ord END) OVER () AS cap,
     CASE WHEN n.ord > least(coalesce(trip, 1000000000), coalesce(cap, 1000000000)) THEN 'unreached'
          WHEN hidden THEN 'hidden' ELSE 'shown' END AS fate
   FROM (SELECT *, sum((outcome = 'qualified')::INT) OVER (ORDER BY ord) AS q FROM verdicts) n JOIN old o USING (cid)
     CROSS JOIN (SELECT min(ord) AS trip FROM (SELECT ord, avg(broken::INT) OVER w AS r, count(*) OVER w AS c FROM verdicts
       WINDOW w AS (ORDER BY ord ROWS 19 PRECEDING)) WHERE c >= 10 AND r >= 0.6) AS tr)"""))
def run_with_limits(spark, sf):
    """A whole run: unchanged rows withheld, stopped by the cap or the breaker."""
    brief = B.dentists()
    brief.limits = {"max_results": 15, "breaker": {"rate": 0.6}}
    prior = stored(spark, sf, "cid", "outcome")
    return run(I.listings(spark, sf), brief, Inputs(prior_verdicts=prior), dedupe=False).select("cid", "fate")


@query("d3_signal_options", f"""WITH {I.LISTINGS_CTE} SELECT cid, CASE WHEN rating IS NULL THEN 'unrated' WHEN rating < 0 OR rating > 10 THEN 'unknown'
   WHEN review_count < 2 THEN 'unrated' WHEN rating >= 3 THEN 'high' WHEN rating >= 1 THEN 'low' ELSE 'poor' END AS vstr FROM listings""")
def d3(spark, sf):
    brief = B.measuring(only=["rating_band"], rating_band={"scale": 10, "min_reviews": 2, "bands": {"low": 1, "high": 3}})
    return measure_free(I.listings(spark, sf), brief).select("cid", F.col("signals")["rating_band"]["vstr"].alias("vstr"))

