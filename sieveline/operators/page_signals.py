"""Signals read from landed pages.

Pages are large and most of a page is never asked about, so ``page_facts``
reduces each page to the few facts the signals use while it is scanned, before
anything is shuffled. Only those narrow rows are deduplicated and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import html as H
from ..functions import urls
from ..functions.text import first_of, text
from ..model import CHEAP, EXPENSIVE, first_case, measurement, pinned
from ..session import settle
from . import registry
from .matching import lookup
from .registry import Context, signal

FRESH_DAYS = 7
FEW_WORDS = 40


def target_url() -> Column:
    """The address the page signals look at: the website, else the booking link."""
    site = text(F.col("website"))
    return F.when(site != "", site).otherwise(text(F.col("booking_url")))


TIED = ["ord", "status", "requests"]         # answers alike in address, age and outcome: these decide, those there are


def latest_fresh(pages: DataFrame, now: Column | None = None, days: int | None = FRESH_DAYS,
                 key: Column | None = None, newest_by: Column | None = None) -> DataFrame:
    """The latest answer of each URL, of those young enough.

    Only answers that succeeded outlive their fetch; a failed one is kept only
    while nothing better exists for its URL. Of answers alike in all that, the
    one that landed first (``ord``) is kept. ``key`` is the address itself where
    it is not to be normalised, ``newest_by`` (largest first) what is latest
    where that is not the time of the fetch.
    """
    now = F.current_timestamp() if now is None else now
    key = urls.normalise(F.col("url")) if key is None else key
    out = pages.withColumn("url", key).filter(F.col("url") != "")
    if days is not None:
        out = out.filter(F.col("fetched_at") > now - F.make_dt_interval(F.lit(days)))
    latest = [F.col("error").isNotNull(), F.col("fetched_at").desc_nulls_last()] if newest_by is None else [newest_by.desc_nulls_last()]
    newest = W.partitionBy("url").orderBy(*latest, F.col("final_url"), *[
        F.col(c).asc_nulls_last() for c in TIED if c in out.columns])
    # A limit of one per key is applied before the shuffle as well as after.
    return out.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")


LOWERED = {"parked", "placeholder", "platform", "marker"}        # facts that read the page in lower case
LINKED = {"socials", "contact_url"}                               # facts that read its links


def facts_read(names) -> set[str] | None:
    """The page facts the named signals read; None, which is all of them, where one doesn't say."""
    reads = [registry.get(n).reads for n in names]
    return None if any(r is None for r in reads) else {fact for r in reads for fact in r}


def page_facts(pages: DataFrame, this_year: Column | None = None, wanted: set[str] | None = None) -> DataFrame:
    """One narrow row per page: how it was answered, and the ``wanted`` facts (all, if None) of its HTML."""
    year = F.year(F.current_date()) if this_year is None else this_year

    def asked(facts) -> bool:
        return wanted is None or bool(wanted & set(facts))

    # Texts that several facts read are made once for a page.
    pages = pages.withColumn("html", F.coalesce(F.col("html"), F.lit(""))).withColumn(
        "_final", F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url")))
    pages = pages.withColumn("_low", F.lower("html")) if asked(LOWERED) else pages
    pages = pages.withColumn("_links", H.hrefs(F.col("html"))) if asked(LINKED) else pages
    pages = pinned(pages, *[c for c in ("html", "_final", "_low", "_links") if c in pages.columns])
    html, final, low, links = (F.col(c) for c in ("html", "_final", "_low", "_links"))
    served = F.array_join(F.transform(
        F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))),
        lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " ")
    kind, marker = H.platform(F.concat(low, F.lit(" "), F.lower(served)))
    ok = F.col("error").isNull() & (F.col("status") >= 200) & (F.col("status") < 300)
    facts = {
        "parked": H.parked_at(final, low),
        "placeholder": first_of(low, H.PLACEHOLDER_PHRASES),
        "words": H.word_count(html),
        "platform": kind, "marker": marker, "generator": H.generator(html),
        "emails": H.emails(html), "socials": H.socials(links),
        "phones": H.phones(html), "contact_url": H.contact_link(links, final),
        "viewport": html.rlike(H.VIEWPORT),
        "years": H.copyright_years(html, year)}
    return pages.select(
        "url", "fetched_at", *(["ord"] if "ord" in pages.columns else []), final.alias("final_url"), "status", "error",
        F.coalesce("redirected", F.lit(False)).alias("redirected"),
        F.coalesce("requests", F.lit(1)).alias("requests"),
        ok.alias("ok"), *[fact.alias(name) for name, fact in facts.items() if asked([name])])


def site_facts(pages: DataFrame, this_year: Column | None = None, now: Column | None = None,
               days: int | None = FRESH_DAYS, wanted: set[str] | None = None) -> DataFrame:
    return latest_fresh(page_facts(pages, this_year, wanted), now, days)


MAP_BITS = 1 << 27           # of a reducer: 16 MB at most, whatever it stands for


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(MAP_BITS)) + 1


def reducer(keys: DataFrame, key: Column) -> DataFrame:
    """A bitmap of hashed keys: at most 4,096 rows ``(_bucket, _bits)`` of 4 KB each, however many keys there are."""
    slots = keys.filter(key.isNotNull()).select(_slot(key).alias("_slot"))
    return (slots.groupBy(F.bitmap_bucket_number("_slot").alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits")))


def among(rows: DataFrame, key: Column, bits: DataFrame) -> DataFrame:
    """Rows whose key may be one of a reducer's: none of its keys is missed, a few others pass.

    The reducer is broadcast, which its size allows by how it is built; rows stay where they were scanned.
    """
    at = F.bitmap_bit_position(_slot(key))
    octet = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.getbit(octet, (at % 8).cast("int")) == 1
    return (rows.withColumn("_bucket", F.bitmap_bucket_number(_slot(key)))
            .join(F.broadcast(bits), "_bucket").filter(held).drop("_bucket", "_bits"))


def facts_of(pages: DataFrame, addresses: DataFrame, this_year: Column | None = None, now: Column | None = None,
             days: int | None = FRESH_DAYS, wanted: set[str] | None = None) -> DataFrame:
    """``site_facts`` for the addresses that are asked about (``address``, normalised), and maybe a few more.

    HTML is read last. The answers' narrow columns alone tell the latest fresh
    one of each address; then only those pages are opened. Both steps go through
    reducers, so pages are neither shuffled nor joined by a table that grows.
    """
    return latest_fresh(page_facts(chosen_pages(pages, addresses, now, days), this_year, wanted), now, days)


def chosen_pages(pages: DataFrame, addresses: DataFrame, now: Column | None = None,
                 days: int | None = FRESH_DAYS) -> DataFrame:
    """The pages ``facts_of`` opens."""
    final = F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url"))
    heads = pages.select("url", "error", "fetched_at", final.alias("final_url"))
    asked = among(heads, urls.normalise(F.col("url")), reducer(addresses, F.col("address")))
    newest = latest_fresh(asked, now, days)

    def answer(url: Column, final_url: Column) -> Column:
        return F.xxhash64(url, F.col("error").isNull(), F.col("fetched_at"), final_url)
    wanted = reducer(newest, answer(F.col("url"), F.col("final_url")))
    return among(pages, answer(urls.normalise(F.col("url")), final), wanted)


def _packed(facts: DataFrame, name: str) -> DataFrame:
    fields = [c for c in facts.columns if c != "url"]
    return facts.select(F.col("url").alias(f"_{name}_url"), F.struct(*fields).alias(name))


def page_address() -> Column:
    """The address of a listing's page as pages are keyed; null where it has none."""
    return F.nullif(urls.normalise(target_url()), F.lit(""))


def _with_home(listings: DataFrame, facts: DataFrame, contact_hop: bool) -> DataFrame:
    """Adds ``_page``, and ``_contact_url`` where a contact page is to be asked as well."""
    out = lookup(listings.withColumn("_page_url", page_address()),
                 _packed(facts, "_page").withColumnRenamed("__page_url", "_page_url"), "_page_url")
    if not contact_hop:
        return out.withColumns({"_contact": F.lit(None).cast(out.schema["_page"].dataType),
                                "_contact_url": F.lit(None).cast("string")})
    page = F.col("_page")
    link, home = page["contact_url"], page["final_url"]
    hop = page["ok"] & (F.size(page["emails"]) == 0) & link.isNotNull() & (
        F.rtrim(link, F.lit("/")) != F.rtrim(home, F.lit("/")))
    return out.withColumn("_contact_url", F.when(hop, F.nullif(urls.normalise(link), F.lit(""))))


def _with_contact(out: DataFrame, facts: DataFrame) -> DataFrame:
    return lookup(out, _packed(facts, "_contact").withColumnRenamed("__contact_url", "_contact_url"), "_contact_url")


def with_pages(listings: DataFrame, facts: DataFrame, contact_hop: bool = True) -> DataFrame:
    """``listings`` with ``_page`` and, where the home page shows no address
    and links a contact page of its own, ``_contact``.

    With a contact hop the facts are settled: both lookups read them, and each
    would open every page for them.
    """
    facts = settle(facts, "page-facts") if contact_hop else facts
    out = _with_home(listings, facts, contact_hop)
    return _with_contact(out, facts) if contact_hop else out


def with_pages_of(listings: DataFrame, pages: DataFrame, contact_hop: bool = True, this_year: Column | None = None,
                  now: Column | None = None, days: int | None = FRESH_DAYS, wanted: set[str] | None = None) -> DataFrame:
    """``with_pages`` straight from landed pages: only the pages of these listings are opened.

    Reads ``listings`` twice. With a contact hop the first lookup is settled,
    since it is asked which contact pages there are before they are opened.
    """
    home = facts_of(pages, listings.select(page_address().alias("address")), this_year, now, days, wanted)
    out = _with_home(listings, home, contact_hop)
    if not contact_hop:
        return out
    out = settle(out, "home-pages")
    return _with_contact(out, facts_of(pages, out.select(F.col("_contact_url").alias("address")), this_year, now, days,
                                       wanted))


def with_mail_check(df: DataFrame, mail_domains: DataFrame | None) -> DataFrame:
    """Adds ``_mail_ok``: can the first address's domain receive mail?

    True with a mail record, or failing that an address record; null while
    unanswered.
    """
    first = F.try_element_at(shown_emails(), F.lit(1))
    domain = F.lower(F.substring_index(first, "@", -1))
    if mail_domains is None:
        return df.withColumn("_mail_ok", F.lit(None).cast("boolean"))
    answers = (mail_domains.groupBy(F.lower(F.btrim(F.col("domain"), F.lit(" ."))).alias("_mail_domain"))
               .agg(F.max("mx_count").alias("_mx"), F.max("has_a").alias("_a")))
    out = lookup(df.withColumn("_mail_domain", domain), answers, "_mail_domain")
    return (out.withColumn("_mail_ok", mail_deliverable(F.col("_mx"), F.col("_a")))
            .drop("_mx", "_a", "_mail_domain"))


def mail_deliverable(mx_count: Column, has_a: Column) -> Column:
    return F.when(mx_count > 0, F.lit(True)).when(mx_count == 0, has_a)


def _hop_ok() -> Column:
    return F.coalesce(F.col("_contact")["ok"], F.lit(False))


def shown_emails() -> Column:
    home, hop = F.col("_page")["emails"], F.col("_contact")["emails"]
    return F.when(F.size(home) > 0, home).when(_hop_ok(), hop).otherwise(home)


# ---- common openings --------------------------------------------------------

def _state() -> dict[str, Column]:
    """What stands in the way of reading the page, in the order it is asked."""
    page = F.col("_page")
    no_url = target_url() == ""
    # A page nobody landed is a measurement not taken, as is a failed one.
    error = F.when(page.isNull(), F.lit("no landed answer for this address")).otherwise(page["error"])
    return {"no_url": no_url, "broken": ~no_url & (F.coalesce(error, F.lit("")) != ""),
            "refused": ~no_url & ~F.coalesce(page["ok"], F.lit(False)), "error": error}


def _opened(confidence, value_ok, kind: str, version: int = 1, broken_text: str | None = None,
            **evidence) -> Column:
    """A page signal's struct: null with full confidence without a URL, failed
    on an error, null at one half when the page was refused."""
    s = _state()
    readable = ~s["no_url"] & ~s["broken"] & ~s["refused"]
    fields = {kind: F.when(readable, value_ok)}
    if broken_text:
        kept = fields.get("vstr", F.lit(None).cast("string"))
        fields["vstr"] = F.when(s["broken"], F.lit(broken_text)).otherwise(kept)
    return measurement(
        **fields, version=version,
        confidence=first_case((s["no_url"], 1.0), (s["broken"], 0.0), (s["refused"], 0.5), default=confidence),
        error=F.when(s["broken"], s["error"]),
        note=first_case((s["no_url"], "no website to check"),
                        (~s["broken"] & s["refused"], "nothing served to inspect")),
        final_url=F.when(readable, F.col("_page")["final_url"]),
        **{k: F.when(readable, v) for k, v in evidence.items()})


# ---- signals ----------------------------------------------------------------

@signal("site_status", CHEAP, "categorical", builtin=True, reads=("parked", "placeholder", "words"),
        values=["live", "dead", "parked", "placeholder", "no_site", "unknown"],
        suggest={"op": "in", "value": ["dead", "parked", "placeholder", "no_site"]})
def site_status(ctx: Context) -> Column:
    s, page = _state(), F.col("_page")
    parked, status = page["parked"].isNotNull(), page["status"]
    gone, upset = status.isin(404, 410), status >= 500
    phrase, thin = page["placeholder"].isNotNull(), page["words"] < FEW_WORDS

    def pick(no_url, broken, on_parked, on_gone, on_upset, on_refused, on_phrase, on_thin, live):
        return first_case((s["no_url"], no_url), (s["broken"], broken), (parked, on_parked),
                          (gone, on_gone), (upset, on_upset), (s["refused"], on_refused),
                          (phrase, on_phrase), (thin, on_thin), default=live)

    return measurement(
        vstr=pick("no_site", "unknown", "parked", "dead", "unknown", "dead",
                  "placeholder", "placeholder", "live"),
        confidence=pick(1.0, 0.0, 0.95, 1.0, 0.3, 0.8, 0.85, 0.6, 1.0),
        error=F.when(s["broken"], s["error"]),
        final_url=page["final_url"], status=status, redirected=page["redirected"],
        matched=F.coalesce(page["parked"], page["placeholder"]), words=page["words"])


@signal("site_platform", CHEAP, "categorical", builtin=True, reads=("platform", "marker", "generator"),
        values=["wix", "squarespace", "shopify", "wordpress", "godaddy", "weebly", "webflow",
                "duda", "square", "facebook", "custom", "unknown"])
def site_platform(ctx: Context) -> Column:
    page = F.col("_page")
    return _opened(F.when(page["platform"].isNotNull(), 0.9).otherwise(0.6),
                   F.coalesce(page["platform"], F.lit("custom")), "vstr", broken_text="unknown",
                   matched=page["marker"], generator=page["generator"])


@signal("site_contact", CHEAP, "text", version=2, builtin=True, reads=("emails", "socials", "phones", "contact_url"))
def site_contact(ctx: Context) -> Column:
    page, hop = F.col("_page"), F.col("_contact")
    mails = shown_emails()
    first = F.try_element_at(mails, F.lit(1))
    no_map, no_list = F.create_map().cast("map<string,string>"), F.array().cast("array<string>")
    hopped = _hop_ok()
    extra = F.when(hopped, F.map_filter(hop["socials"], lambda k, _: ~F.array_contains(
        F.map_keys(page["socials"]), k)))
    return _opened(
        F.when(first.isNotNull() & (F.col("_mail_ok") == F.lit(False)), 0.5).otherwise(0.9),
        first, "vstr", version=2, broken_text="unknown",
        emails=mails, mail_server=F.when(first.isNotNull(), F.col("_mail_ok")),
        socials=F.map_concat(page["socials"], F.coalesce(extra, no_map)),
        phones=F.array_distinct(F.concat(page["phones"], F.coalesce(F.when(hopped, hop["phones"]), no_list))),
        contact_page=F.when(hopped, F.col("_contact_url")))


@signal("site_https", CHEAP, "boolean", builtin=True, reads=(), suggest={"op": "==", "value": False})
def site_https(ctx: Context) -> Column:
    s, page = _state(), F.col("_page")
    # The certificate answer is a finding that also carries its error.
    bad_cert = s["broken"] & F.lower(s["error"]).rlike("certificate|ssl")
    readable = ~s["no_url"] & ~s["broken"] & ~s["refused"]
    return measurement(
        vbool=first_case((bad_cert, False), (readable, urls.scheme(page["final_url"]) == "https")),
        confidence=first_case((s["no_url"], 1.0), (bad_cert, 0.8), (s["broken"], 0.0),
                              (s["refused"], 0.5), default=1.0),
        error=F.when(s["broken"], s["error"]), final_url=page["final_url"],
        note=first_case((s["no_url"], "no website to check"),
                        (bad_cert, "the certificate did not verify"),
                        (~s["broken"] & s["refused"], "nothing served to inspect")))


@signal("site_mobile", CHEAP, "boolean", builtin=True, reads=("viewport",), suggest={"op": "==", "value": False})
def site_mobile(ctx: Context) -> Column:
    return _opened(F.lit(0.85), F.col("_page")["viewport"], "vbool")


@signal("site_year", CHEAP, "number", builtin=True, reads=("years",), whole=True, rank=False)
def site_year(ctx: Context) -> Column:
    years = F.col("_page")["years"]
    latest = F.array_max(years)
    return _opened(F.when(latest.isNull(), 0.6).otherwise(0.8), latest, "vnum",
                   years_seen=years)


def with_place_pages(df: DataFrame, place_pages: DataFrame | None) -> DataFrame:
    """Adds ``_place``: what the landed place page of a listing says."""
    shape = "struct<count:bigint,has_tab:boolean>"
    if place_pages is None:
        return df.withColumn("_place", F.lit(None).cast(shape))
    body = F.coalesce(F.col("text"), F.lit(""))
    # pages are reduced while they are scanned; of several, the latest answer counts
    when = F.col("fetched_at") if "fetched_at" in place_pages.columns else F.lit(None).cast("timestamp")
    facts = place_pages.select(F.lower("cid").alias("cid"), F.struct(
        when.alias("at"), H.review_count(body).alias("count"), body.contains("Reviews").alias("has_tab")).alias("_p"))
    latest = facts.groupBy("cid").agg(F.max("_p").alias("_p")).select(
        "cid", F.struct("_p.count", "_p.has_tab").alias("_place"))
    return df.join(latest, "cid", "left")


@signal("reviews_live", EXPENSIVE, "number", builtin=True, whole=True,
        suggest={"op": ">=", "value": 30}, rank={"scale": "log", "cap": 300})
def reviews_live(ctx: Context) -> Column:
    place = F.col("_place")
    return measurement(
        vnum=place["count"], confidence=F.when(place["count"].isNull(), 0.0).otherwise(1.0),
        error=first_case((place.isNull(), "no landed place page for this listing"),
                         (place["count"].isNull() & ~place["has_tab"],
                          "the page shows the limited view: a rating and no reviews tab"),
                         (place["count"].isNull(), "a reviews tab and no readable count")),
        limited_view=F.when(place["count"].isNull(), ~place["has_tab"]))
