"""SQL building blocks for the oracles.

Written the plain way (theta joins, EXISTS, correlated lookups) so they check
the equi-lookups of the Spark plans rather than repeat them.
"""

from sieveline.reference_data import (CHAINS, GENERIC_CATEGORIES, HOST_PACKS, NON_WEB_SCHEMES,
                                      SHARED_VETOES, TRADES)
from workload.inputs import LISTINGS_CTE, YEAR


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(
        q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + ")"


def host(col: str) -> str:
    raw = f"trim(coalesce({col}, ''))"
    schemes = ", ".join(q(s) for s in NON_WEB_SCHEMES)
    slashed = f"regexp_extract({raw}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
    loc = f"(CASE WHEN {slashed} <> '' THEN {slashed} ELSE regexp_extract({raw}, '^([^/?#]*)', 1) END)"
    return (f"(CASE WHEN lower(regexp_extract({raw}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ({schemes}) THEN '' "
            f"ELSE regexp_replace(split_part(list_extract(string_split(lower({loc}), '@'), -1), ':', 1), "
            f"'^www\\.', '') END)")


HOSTS_CTE = "hosts(rank, state, entry) AS " + values(
    [(i + 1, state, h) for i, (state, h) in enumerate((s, h) for _, s, hs in HOST_PACKS for h in hs)])


def web_cte(source: str = "listings") -> str:
    """web: every listing column plus web_presence, web_conf, web_host, web_matched."""
    return f"""{HOSTS_CTE},
web0 AS (SELECT *, {host('website')} AS site, {host('booking_url')} AS book FROM {source}),
web1 AS (SELECT *,
   (SELECT min(rank) FROM hosts WHERE site = entry OR ends_with(site, '.' || entry)) AS sr,
   (SELECT min(rank) FROM hosts WHERE book = entry OR ends_with(book, '.' || entry)) AS br FROM web0),
web2 AS (SELECT web1.*, coalesce(s.state, 'owned_domain') AS ss, s.entry AS se,
   coalesce(b.state, 'owned_domain') AS bs, b.entry AS be
   FROM web1 LEFT JOIN hosts s ON s.rank = sr LEFT JOIN hosts b ON b.rank = br),
web AS (SELECT * EXCLUDE (sr, br),
   CASE WHEN contains(site, '.') THEN ss WHEN contains(book, '.') AND bs = 'booking_only' THEN 'none'
        WHEN contains(book, '.') THEN bs ELSE 'none' END AS web_presence,
   CASE WHEN NOT contains(site, '.') AND contains(book, '.') AND bs <> 'booking_only' THEN 0.9::DOUBLE
        ELSE 1.0::DOUBLE END AS web_conf,
   CASE WHEN contains(site, '.') THEN site WHEN contains(book, '.') THEN book END AS web_host,
   CASE WHEN contains(site, '.') THEN se WHEN contains(book, '.') THEN be END AS web_matched
   FROM web2)"""


def trade_rows():
    rows = []
    for pid, pack in TRADES.items():
        for kind, terms in (("category", pack["categories"]), ("keyword", pack["keywords"]),
                            ("locale", pack["locale_terms"]), ("veto", pack["vetoes"])):
            rows += [(pid, kind, i, t.lower()) for i, t in enumerate(terms)]
    return rows


TERMS_CTE = "terms(pack, kind, pos, term) AS " + values(trade_rows()) + """,
shared(pos, term) AS """ + values([(i, t.lower()) for i, t in enumerate(SHARED_VETOES)]) + """,
vetoes AS (
  SELECT pack, term, 'own' AS origin FROM terms WHERE kind = 'veto'
  UNION ALL
  SELECT p.pack, s.term, 'shared' FROM (SELECT DISTINCT pack FROM terms) p, shared s
  WHERE NOT EXISTS (SELECT 1 FROM terms t WHERE t.pack = p.pack AND t.kind IN ('category', 'keyword')
                    AND (contains(t.term, s.term) OR contains(s.term, t.term))))"""

GENERIC = ", ".join(q(g) for g in GENERIC_CATEGORIES)


def trade_cte(packs, source: str, match: str = "any") -> str:
    """trade: source columns plus trade_hit (slug, null when false) and trade_conf."""
    names = values([(i, p) for i, p in enumerate(packs)])
    every = "count(*) FILTER (WHERE hit) = " + str(len(packs))
    ok = f"({every})" if match == "all" and len(packs) > 1 else "bool_or(hit)"
    conf = "min(conf) FILTER (WHERE hit)" if match == "all" else "max(conf) FILTER (WHERE hit)"
    return f"""{TERMS_CTE},
wanted(i, pack) AS {names},
stand0 AS (
  SELECT l.cid, w.i, w.pack,
    EXISTS (SELECT 1 FROM vetoes v WHERE v.pack = w.pack AND contains(lower(trim(coalesce(category, ''))), v.term)) AS veto,
    EXISTS (SELECT 1 FROM terms t WHERE t.pack = w.pack AND t.kind = 'category'
            AND contains(lower(trim(coalesce(category, ''))), t.term)) AS bycat,
    lower(trim(coalesce(category, ''))) IN ('', {GENERIC}) AND
    EXISTS (SELECT 1 FROM terms t WHERE t.pack = w.pack AND t.kind IN ('keyword', 'locale')
            AND contains(lower(coalesce(name, '')), t.term)) AS byname
  FROM {source} l, wanted w),
stand AS (SELECT *, NOT veto AND (bycat OR byname) AS hit,
    CASE WHEN bycat THEN 0.95::DOUBLE ELSE 0.6::DOUBLE END AS conf FROM stand0),
choice AS (SELECT cid, bool_or(veto) AS veto, {ok} AS ok, {conf} AS conf,
    arg_min(split_part(pack, '/', 2), -conf * 1000 + i) FILTER (WHERE hit) AS slug FROM stand GROUP BY cid),
trade AS (SELECT l.*,
    CASE WHEN NOT c.veto AND c.ok THEN slug END AS trade_hit,
    CASE WHEN c.veto THEN 1.0::DOUBLE WHEN c.ok THEN conf ELSE 0.9::DOUBLE END AS trade_conf
  FROM {source} l JOIN choice c USING (cid))"""


LOW_STATUS = "trim(regexp_replace(replace(lower(trim(coalesce(status_raw, ''))), '_', ' '), '\\s+', ' ', 'g'))"
LIVENESS = f"""(CASE WHEN contains({LOW_STATUS}, 'permanently closed') OR contains({LOW_STATUS}, 'closed permanently')
  THEN 'perm_closed'
  WHEN contains({LOW_STATUS}, 'temporarily closed') OR contains({LOW_STATUS}, 'closed temporarily') THEN 'temp_closed'
  WHEN first_review_year IS NOT NULL AND coalesce(review_count, 0) <= 3 AND ({YEAR} - first_review_year) * 12 >= 24
  THEN 'stale' ELSE 'open' END)"""

CHAIN_KEY = """trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(name, ''))),
  '\\s[-–—|(]\\s?[^-–—|()]{1,40}\\)?$|\\s(branch|store|clinic|centre|center)\\s*\\d*$', '', 'gi'),
  '\\b(ltd|limited|llc|inc|plc|gmbh|bv|pty|llp|co|corp|company|group|holdings|uk|usa|international)\\b\\.?', ' ', 'gi'),
  '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"""


def brand_rows():
    from sieveline.functions.names import brand_key
    return [(brand_key(b), n) for b, n in CHAINS.items()]


def chain_cte(source: str) -> str:
    """chained: source columns plus chain_key, chain_n, brand, brand_n."""
    return f"""brands(brand, locations) AS {values(brand_rows())},
chained AS (SELECT *, (SELECT arg_max(brand, length(brand)) FROM brands
      WHERE chain_key = brand OR starts_with(chain_key, brand || ' ')) AS brand,
    (SELECT arg_max(locations, length(brand)) FROM brands
      WHERE chain_key = brand OR starts_with(chain_key, brand || ' ')) AS brand_n
  FROM (SELECT *, count(*) OVER (PARTITION BY chain_key) AS chain_n
        FROM (SELECT *, {CHAIN_KEY} AS chain_key FROM {source})))"""


RATING_LABEL = ("(CASE WHEN rating >= 4.5 THEN 'excellent' WHEN rating >= 4.0 THEN 'good' "
                "WHEN rating >= 3.0 THEN 'mixed' ELSE 'poor' END)")
RATING_BAND = f"""(CASE WHEN rating IS NULL THEN 'unrated' WHEN rating < 0 OR rating > 5 THEN 'unknown'
  WHEN review_count < 5 THEN 'unrated' ELSE {RATING_LABEL} END)"""


def dentist_cte(least: int = 8, source: str = "listings", name: str = "verdicts", first: bool = True) -> str:
    """Verdicts of the dentist brief, written out rule by rule."""
    tag = name
    base = (web_cte(source) + ",\n" + trade_cte(["trades/dentist"], "web") + ",\n") if first else ""
    return base + f"""{tag}_j AS (SELECT *, {LIVENESS} AS liveness FROM trade),
{tag}_f AS (SELECT *, CASE WHEN review_count IS NULL THEN 'unmeasurable:reviews'
    WHEN review_count < {least} THEN 'reviews'
    WHEN liveness IN ('perm_closed', 'temp_closed') THEN 'liveness'
    WHEN trade_hit IS NULL THEN 'trade_match'
    WHEN web_presence = 'owned_domain' THEN 'web_presence' END AS rejected_by FROM {tag}_j),
{tag}_o AS (SELECT *, CASE WHEN rejected_by IS NULL THEN 'qualified'
    WHEN starts_with(rejected_by, 'unmeasurable:') THEN 'unevaluated' ELSE 'rejected' END AS outcome FROM {tag}_f),
{tag}_s AS (SELECT *,
    CASE web_presence WHEN 'none' THEN 50.0::DOUBLE WHEN 'booking_only' THEN 30.0::DOUBLE WHEN 'social_only' THEN 20.0::DOUBLE
      WHEN 'builder' THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS p_web,
    30.0::DOUBLE * (log10(least(review_count, 40)::DOUBLE + 1) / log10(41.0::DOUBLE)) AS p_rev FROM {tag}_o),
{tag} AS (SELECT * EXCLUDE (p_web, p_rev), CASE WHEN outcome = 'qualified' THEN
      round((0.0::DOUBLE + p_rev + p_web + 20.0::DOUBLE) / 100.0::DOUBLE * 100.0::DOUBLE, 1) END AS score,
    CASE WHEN outcome = 'qualified' THEN round(p_web, 2) END AS pts_web,
    CASE WHEN outcome = 'qualified' THEN round(p_rev, 2) END AS pts_reviews,
    (rating < 0 OR rating > 5) IS TRUE AS broken
  FROM {tag}_s)"""


def dentists(select: str, least: int = 8) -> str:
    return f"WITH {LISTINGS_CTE},\n{dentist_cte(least)}\n{select}"


def two_runs(select: str) -> str:
    """``old`` judged at 12 reviews, ``verdicts`` at 8."""
    return (f"WITH {LISTINGS_CTE},\n{dentist_cte(8)},\n{dentist_cte(12, name='old', first=False)}\n{select}")
