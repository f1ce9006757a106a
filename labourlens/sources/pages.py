"""Raw postings out of archived pages ``(page_id, url, html)``.

Embedded JSON is read natively as variants; only repeated HTML cards need a
parser outside the JVM.  Every extractor yields the loose posting columns of
``schemas.RAW_POSTING``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labourlens.dictionaries import BLOCKED_MARKERS
from labourlens.functions.cards import Step, cards
from labourlens.functions.keys import job_key, query_value, resolve_url
from labourlens.functions.salary import range_text
from labourlens.functions.text import contains_any

JSON_LD = r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
APP_STATE = r"(?is)<script[^>]*id\s*=\s*[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
LINK = r"(?is)<a\s[^>]*href\s*=\s*[\"']([^\"']*)[\"']"

RAW_COLUMNS = ["job_id", "job_title", "company_name", "city", "source_site", "source_url", "salary_raw", "experience_years",
               "skills_raw", "description_raw", "posted_at"]


# --- any page -------------------------------------------------------------------

def is_blocked(html: str | Column = "html") -> Column:
    """A challenge page instead of content; the whole page is searched."""
    text = F.lower(F.col(html) if isinstance(html, str) else html)
    return F.coalesce(contains_any(text, BLOCKED_MARKERS), F.lit(False))


def quarantined(pages: DataFrame) -> DataFrame:
    """The challenge pages, with the first marker each one holds: what an extraction leaves out."""
    low = F.lower(F.col("html"))
    first = F.coalesce(*[F.when(F.contains(low, F.lit(m)), F.lit(m)) for m in BLOCKED_MARKERS])
    return pages.withColumn("marker", first).where("marker IS NOT NULL").select("page_id", "url", "marker")


def page_title(html: str = "html") -> Column:
    return F.trim(F.regexp_extract(html, TITLE, 1))


def page_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per link, made absolute with the page's own host."""
    origin = F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]+)", 1)
    links = pages.select("page_id", origin.alias("origin"), F.posexplode(F.regexp_extract_all(html, F.lit(LINK), 1)).alias("pos", "href"))
    absolute = F.when(F.col("href").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.col("href")).when(
        F.col("href").startswith("/"), F.concat("origin", "href")).otherwise(F.concat("origin", F.lit("/"), "href"))
    return links.select("page_id", "pos", "href", absolute.alias("link"))


# --- embedded JSON --------------------------------------------------------------

def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _text(v: Column, *paths: str) -> Column:
    """First non-blank text under the paths."""
    return F.coalesce(*[F.nullif(_get(v, p), F.lit("")) for p in paths])


def _is_text(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(_get(v, path, "variant")) == "STRING", F.lit(False))


def _name(v: Column, *paths: str) -> Column:
    """Name of an object, or the text itself where a site writes only a text."""
    options = []
    for p in paths:
        options += [F.nullif(_get(v, p + ".name"), F.lit("")), F.when(_is_text(v, p), F.nullif(_get(v, p), F.lit("")))]
    return F.coalesce(*options)


def json_ld_items(pages: DataFrame) -> DataFrame:
    """``(page_id, url, item)``: every JSON-LD object; unreadable blocks are skipped."""
    blocks = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(JSON_LD), 1)).alias("text"))
    parsed = blocks.select("page_id", "url", F.try_parse_json("text").alias("v")).where("v IS NOT NULL")
    items = F.coalesce(_get(F.col("v"), "$", "array<variant>"), F.array("v"))
    return parsed.select("page_id", "url", F.explode(items).alias("item"))


def app_state(pages: DataFrame) -> DataFrame:
    """``(page_id, url, state)`` for pages with readable embedded state."""
    text = F.regexp_extract("html", APP_STATE, 1)
    return pages.select("page_id", "url", F.try_parse_json(text).alias("state")).where("state IS NOT NULL")


def without_app_state(pages: DataFrame) -> DataFrame:
    """Pages that should carry embedded state and do not: blocked or a new layout."""
    return pages.join(app_state(pages).select("page_id"), "page_id", "left_anti")


def _raw(df: DataFrame, site: str, url: Column, **columns: Column) -> DataFrame:
    rows = df.withColumn("source_url", url)
    rows = rows.select(
        "page_id", "source_url", F.lit(site).alias("source_site"), *[c.alias(n) for n, c in columns.items()])
    if "job_id" not in rows.columns:
        rows = rows.withColumn("job_id", job_key("source_site", "source_url"))
    for name in RAW_COLUMNS:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("array<string>" if name == "skills_raw" else "string"))
    return rows.select("page_id", *RAW_COLUMNS)


def json_ld_postings(pages: DataFrame, site: str = "itviec") -> DataFrame:
    """Postings written as JSON-LD, each with its own address or the page's."""
    item = F.col("item")
    found = json_ld_items(pages).where(_get(item, "$['@type']") == "JobPosting")
    places = ["$.jobLocation[0].address", "$.jobLocation.address"]
    amount = _get(item, "$.baseSalary.value.value")
    return _raw(
        found, site, F.coalesce(_text(item, "$.url"), F.col("url")),
        job_title=F.coalesce(_get(item, "$.title"), F.lit("")),
        company_name=F.coalesce(_name(item, "$.hiringOrganization"), F.lit("Unknown")),
        city=F.coalesce(*[_text(item, f"{p}.addressRegion", f"{p}.addressLocality") for p in places], F.lit("")),
        salary_raw=F.when(amount.isNotNull(), F.trim(F.concat_ws(" ", amount, _get(item, "$.baseSalary.value.unitText")))).otherwise(""),
        description_raw=F.coalesce(_get(item, "$.description"), F.lit("")),
        posted_at=_get(item, "$.datePosted"),
    )


def item_list_links(pages: DataFrame) -> DataFrame:
    """``(page_id, link)``: detail addresses of listing pages."""
    item = F.col("item")
    lists = json_ld_items(pages).where(_get(item, "$['@type']") == "ItemList")
    elements = lists.select("page_id", F.explode(_get(item, "$.itemListElement", "array<variant>")).alias("e"))
    return elements.select("page_id", _text(F.col("e"), "$.url").alias("link")).where("link IS NOT NULL")


def listed_postings(pages: DataFrame, site: str = "itviec") -> DataFrame:
    """Postings of the detail pages that some listing page names, once per listing."""
    links = item_list_links(pages)
    by_page = pages.select(F.col("page_id").alias("detail_id"), F.col("url").alias("link"))
    listed = links.join(by_page, "link").select("page_id", "detail_id")
    found = json_ld_postings(pages, site).withColumnRenamed("page_id", "detail_id")
    return listed.join(found, "detail_id").select("page_id", *RAW_COLUMNS)


@dataclass(frozen=True)
class StateSite:
    """Where a site keeps its listing and how it names things; paths in order of trial."""

    site: str
    base: str
    lists: tuple[str, ...]
    job_url: str
    titles: tuple[str, ...] = ("$.title", "$.jobTitle")
    companies: tuple[str, ...] = ("$.company",)
    cities: tuple[str, ...] = ("$.city", "$.location")
    salaries: tuple[str, ...] = ("$.salary",)
    skills: str = "$.skills"
    skill_names: tuple[str, ...] = ("$.skill.name", "$.name", "$.key")
    descriptions: tuple[str, ...] = ("$.description",)
    posted: tuple[str, ...] = ("$.posted_at", "$.createdAt")
    urls: tuple[str, ...] = ("$.url",)
    id_path: str = "$.id"
    any_list: bool = False


# --- fixed values: addresses and paths of the sites ------------------------------
STATE_SITES = {
    "glints": StateSite(
        "glints", "https://glints.com", ("$.props.pageProps.jobs", "$.props.pageProps.jobList",
                                         "$.props.pageProps.initialJobs.jobsInPage"),
        "https://glints.com/vn/opportunities/jobs/{}", companies=("$.company", "$.employer"), cities=("$.location", "$.city"),
        urls=("$.url", "$.slug"), any_list=True),
    "vietnamworks": StateSite(
        "vietnamworks", "https://www.vietnamworks.com", ("$.props.pageProps.outstandingJobs", "$.props.pageProps.featuredJobs",
                                                         "$.props.pageProps.latestJobs"),
        "https://www.vietnamworks.com/job/{}", titles=("$.jobTitle", "$.title"), cities=("$.location", "$.city"),
        skills="$.skillTags", skill_names=("$.key", "$.name"), descriptions=("$.jobDescription",), id_path="$.jobId", any_list=True),
    "vieclam24h": StateSite(
        "vieclam24h", "https://vieclam24h.vn", ("$.props.initialState.api.getJobList.data",),
        "https://vieclam24h.vn/viec-lam/{}.html", companies=("$.company", "$.employer"), salaries=("$.salary_raw", "$.salary")),
}


@dataclass(frozen=True)
class CardSite:
    site: str
    base: str
    card: Step
    fields: dict
    id_attribute: str = ""


_COMPANY = ((Step("span", "company-name"),), (Step("a", "company-name"),))
_COMMON = {"company": _COMPANY, "city": ((Step("span", "location"),),), "salary": ((Step("span", "salary"),),),
           "tags": ((Step("span", "tag"),),)}
CARD_SITES = {
    "careerviet": CardSite("careerviet", "https://careerviet.vn", Step("div", "job-item"), {
        "title": ((Step("a", href="/vi/tim-viec-lam/"),), (Step("a"),)), **_COMMON}),
    "vietnamworks": CardSite("vietnamworks", "https://www.vietnamworks.com", Step("div", "job-item"), {
        "title": ((Step("h3", "job-title"), Step("a")), (Step("a"),)), **_COMMON}),
    "topcv": CardSite("topcv", "https://www.topcv.vn", Step("div", "job-item-search-result"), {
        "title": ((Step("h3", "title"), Step("a")), (Step("a", href="/viec-lam/"),)),
        "company": ((Step("span", "company-name"),), (Step("a", "company"),)),
        "salary": ((Step("label", "title-salary"),),), "city": ((Step("span", "city-text"),),),
        "experience": ((Step("label", "exp"), Step("span")),)}, "data-job-id"),
}
LISTING_URLS = {
    "itviec": "https://itviec.com/viec-lam-it?q={keyword}&page={page}",
    "glints": "https://glints.com/vn/opportunities/jobs?keyword={keyword}&page={page}",
    "vietnamworks": "https://www.vietnamworks.com/viec-lam?q={keyword}&page={page}",
    "vieclam24h": "https://vieclam24h.vn/viec-lam-tp-hcm-p122.html?occupation_ids[]=8&occupation_ids[]=7"
                  "&sort_q=priority_max,desc&page={page}",
    "careerviet": "https://careerviet.vn/viec-lam/{keyword}-trang-{page}-vi.html",
    "topcv": "https://www.topcv.vn/tim-viec-lam-{keyword}-tai-ho-chi-minh-kl2cr257cb258",
}
RETIRED = {"timviecnhanh": "vieclam24h"}


def _non_empty(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def state_postings(pages: DataFrame, site: StateSite) -> DataFrame:
    """Postings of a listing page with embedded state."""
    state = F.col("state")
    found = [_non_empty(_get(state, p, "array<variant>")) for p in site.lists]
    if site.any_list:
        # Any other list of objects that have a title, by name of its property.
        values = F.map_values(_get(state, "$.props.pageProps", "map<string,variant>"))
        lists = F.transform(values, lambda v: _get(v, "$", "array<variant>"))
        found.append(F.get(F.filter(lists, lambda a: F.coalesce(
            F.size(a) > 0, F.lit(False)) & _text(F.get(a, F.lit(0)), "$.title", "$.jobTitle").isNotNull()), F.lit(0)))
    hits = app_state(pages).select("page_id", F.explode(F.coalesce(*found)).alias("hit"))
    hit = F.col("hit")
    amounts = F.when(
        _get(hit, "$.salary.minAmount", "double").isNotNull() & _get(hit, "$.salary.maxAmount", "double").isNotNull(),
        range_text(_get(hit, "$.salary.minAmount", "double"), _get(hit, "$.salary.maxAmount", "double")))
    written = F.coalesce(*[F.when(_is_text(hit, p), _text(hit, p)) for p in site.salaries])
    names = F.transform(
        F.coalesce(_get(hit, site.skills, "array<variant>"), F.array().cast("array<variant>")),
        lambda s: F.coalesce(F.when(_is_text(s, "$"), _get(s, "$")), _text(s, *site.skill_names)))
    fallback = F.concat(F.lit(site.job_url.split("{}")[0]), F.coalesce(_text(hit, site.id_path), F.lit("")),
                        F.lit(site.job_url.split("{}")[1]))
    return _raw(
        hits, site.site, resolve_url(site.base, F.coalesce(_text(hit, *site.urls), fallback)),
        job_title=F.coalesce(_text(hit, *site.titles), F.lit("")),
        company_name=F.coalesce(_name(hit, *site.companies), F.lit("Unknown")),
        city=F.coalesce(_name(hit, *site.cities), F.lit("")),
        salary_raw=F.coalesce(amounts, written, F.lit("")),
        skills_raw=F.filter(names, lambda n: n.isNotNull()),
        description_raw=F.coalesce(_text(hit, *site.descriptions), F.lit("")),
        posted_at=_text(hit, *site.posted),
    )


def card_postings(pages: DataFrame, site: CardSite) -> DataFrame:
    """Postings of a listing page made of repeated cards."""
    found = pages.select("page_id", F.explode(cards(F.col("html"), site.card, site.fields, site.id_attribute)).alias("c"))
    url = resolve_url(site.base, F.col("c.href"))
    rows = found.withColumn("_url", url)
    own_id = F.when(F.col("c.card_id") != "", F.concat(F.lit(site.site + "_"), F.col("c.card_id")))
    return _raw(
        rows, site.site, F.col("_url"),
        job_id=F.coalesce(own_id, job_key(F.lit(site.site), "_url")),
        job_title=F.col("c.title"),
        company_name=F.coalesce("c.company", F.lit("Unknown")),
        city=F.coalesce("c.city", F.lit("")),
        salary_raw=F.coalesce("c.salary", F.lit("")),
        experience_years=F.col("c.experience"),
        skills_raw=F.col("c.tags"),
        description_raw=F.lit(""),
    )


def state_or_card_postings(pages: DataFrame, site: str) -> DataFrame:
    """Embedded state first; cards only for the pages that gave no posting."""
    from_state = state_postings(pages, STATE_SITES[site])
    rest = pages.join(from_state.select("page_id").distinct(), "page_id", "left_anti")
    return from_state.unionByName(card_postings(rest, CARD_SITES[site]))


EXTRACTORS = {
    "itviec": lambda pages: json_ld_postings(pages, "itviec"),
    "glints": lambda pages: state_postings(pages, STATE_SITES["glints"]),
    "vietnamworks": lambda pages: state_or_card_postings(pages, "vietnamworks"),
    "vieclam24h": lambda pages: state_postings(pages, STATE_SITES["vieclam24h"]),
    "careerviet": lambda pages: card_postings(pages, CARD_SITES["careerviet"]),
    "topcv": lambda pages: card_postings(pages, CARD_SITES["topcv"]),
}


def extract_site(site: str, pages: DataFrame, keyword: str | None = None) -> DataFrame:
    """Raw postings of one site's pages, tagged with the search word."""
    if site in RETIRED:
        raise RuntimeError(f"{site} merged into {RETIRED[site]}; use that site")
    if site not in EXTRACTORS:
        raise KeyError(f"unknown site {site!r}; known: {sorted(EXTRACTORS)}")
    return EXTRACTORS[site](pages.where(~is_blocked())).withColumn("keyword", F.lit(keyword).cast("string"))


def frontier(keywords: DataFrame, sites: Sequence[str], max_pages: int) -> DataFrame:
    """Listing addresses for every site, keyword and page number.

    Sites and page numbers are unrolled inside each keyword row.
    """
    templates = F.array(*[F.struct(F.lit(s).alias("site"), F.lit(LISTING_URLS[s]).alias("t")) for s in sites])
    rows = keywords.select("keyword", F.explode(templates).alias("s")).select(
        "keyword", "s.*", F.explode(F.sequence(F.lit(1), F.lit(max_pages))).alias("page"))
    url = F.replace(F.replace("t", F.lit("{keyword}"), query_value("keyword")), F.lit("{page}"), F.col("page").cast("string"))
    return rows.select("site", "keyword", "page", url.alias("url"))


def harvest_counts(rows: DataFrame, sites: Sequence[str]) -> DataFrame:
    """Rows per site, zero for a site that gave none."""
    counts = rows.groupBy(F.col("source_site").alias("site")).agg(F.count("*").alias("n"))
    asked = rows.sparkSession.createDataFrame([(s,) for s in sites], "site string")
    return asked.join(counts, "site", "left").select("site", F.coalesce("n", F.lit(0)).alias("n"))
