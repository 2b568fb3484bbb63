"""Rows out of landed pages and entity documents, by expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.text import squeeze
from fathomline.functions.urls import host, scheme

ICON, APPLE = ["icon", "shortcut", "apple-touch-icon", "apple-touch-icon-precomposed"], ["apple-touch-icon", "apple-touch-icon-precomposed"]  # fixed values
META = ["description", "og:title", "og:description", "twitter:description", "og:site_name"]  # fixed values: meta tags that tell what a page is
NO_PAGE = r"(?i)^(?:data:|javascript:|mailto:|about:)"


def attribute(tag: Column, name: str) -> Column:
    """The quoted value of a tag's attribute, null if absent."""
    return F.nullif(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))


def inner(html: Column, tag: str) -> Column:
    """The text of each element of a kind, without tags."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.transform(found, lambda x: squeeze(F.regexp_replace(x, "<[^>]*>", "")))


def absolute(url: Column, base: Column) -> Column:
    """``url`` resolved against ``base``: whole, from the scheme, from the root, or beside the page."""
    origin = F.concat(scheme(base), F.lit("://"), host(base))
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(://[^/]+.*/)[^/]*$", "$1")
    folder = F.when(folder.rlike(r"://[^/]+$"), F.concat(folder, F.lit("/"))).otherwise(folder)
    return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), url).when(url.startswith("//"), F.concat(scheme(base), F.lit(":"), url)).when(url.startswith("/"), F.concat(origin, url)).otherwise(F.concat(folder, url))


def best_logo(html: Column, base: Column) -> Column:
    """The url of the best icon a page declares: touch icons first, then the largest, then by url; the site's default icon if it declares none."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))

    def entry(tag):
        rel = F.split(F.lower(F.coalesce(attribute(tag, "rel"), F.lit(""))), r"\s+")
        sizes = F.transform(F.regexp_extract_all(F.lower(F.coalesce(attribute(tag, "sizes"), F.lit(""))), F.lit(r"(\d+)x\d+"), F.lit(1)), lambda x: x.cast("int"))
        link = F.trim(attribute(tag, "href"))
        fits = F.arrays_overlap(rel, F.array(*map(F.lit, ICON))) & link.isNotNull() & ~link.rlike(NO_PAGE)
        apple = F.arrays_overlap(rel, F.array(*map(F.lit, APPLE)))
        full = absolute(link, base)
        return F.when(fits & full.rlike("(?i)^https?://[^/]"), F.struct((~apple).alias("other"), (-F.coalesce(F.array_max(sizes), F.lit(0))).alias("small"), full.alias("url")))

    found = F.array_min(F.array_compact(F.transform(tags, entry)))["url"]
    return F.when(base.rlike("(?i)^https?://[^/?#]"), F.coalesce(found, F.concat(scheme(base), F.lit("://"), host(base), F.lit("/favicon.ico"))))


def meta_signals(html: Column) -> Column:
    """A page's title and what its meta tags say of it, in a fixed order, each once."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))

    def first(kind: str) -> Column:
        mine = F.filter(tags, lambda t: F.lower(F.coalesce(attribute(t, "name"), attribute(t, "property"))) == kind)
        return F.trim(attribute(F.get(mine, F.lit(0)), "content"))

    said = map(first, META)
    return F.array_distinct(F.filter(F.concat(F.slice(inner(html, "title"), 1, 1), F.array_compact(F.array(*said))), lambda x: x != ""))


def trending_repos(pages: DataFrame, html: str = "html") -> DataFrame:
    """``(owner, repo, description, language, stars)`` of a page's repository cards; cards without owner and repository are left out."""
    cards = pages.select(F.explode(F.slice(F.split(html, r'<article\b[^>]*class="[^"]*Box-row'), 2, 1000)).alias("card"))
    link = F.regexp_extract("card", r'(?is)<h2\b.*?href="\s*/([^"]+?)/?\s*"', 1)
    parts = F.split(link, "/")
    stars = F.regexp_extract("card", r'(?is)href="/[^"]*/stargazers"[^>]*>(.*?)</a>', 1)
    language = F.regexp_extract("card", r'(?is)itemprop="programmingLanguage"[^>]*>(.*?)<', 1)
    return cards.select(
        F.get(parts, F.lit(0)).alias("owner"), F.get(parts, F.lit(1)).alias("repo"), F.nullif(F.get(inner(F.col("card"), "p"), F.lit(0)), F.lit("")).alias("description"),
        F.nullif(squeeze(language), F.lit("")).alias("language"), F.regexp_replace(F.regexp_replace(stars, "<[^>]*>", ""), r"[\s,]", "").try_cast("int").alias("stars"), F.size(parts).alias("_n"),
    ).where("_n = 2").drop("_n")


STATEMENT = "array<struct<mainsnak: struct<datavalue: struct<value: {}>>>>"
ITEM, TIME, TEXT = STATEMENT.format("struct<id: string>"), STATEMENT.format("struct<time: string>"), STATEMENT.format("string")
ENTITY = f"labels map<string, struct<value: string>>, descriptions map<string, struct<value: string>>, missing string, claims struct<P31: {ITEM}, P17: {ITEM}, P159: {ITEM}, P452: {ITEM}, P112: {ITEM}, P571: {TIME}, P856: {TEXT}>"


def _values(statements: Column, field: str | None) -> Column:
    value = lambda s: s["mainsnak"]["datavalue"]["value"]
    return F.array_compact(F.transform(F.coalesce(statements, F.array()), lambda s: value(s)[field] if field else value(s)))


def entity_claims(entities: DataFrame, json: str = "json") -> DataFrame:
    """``entities`` with what an entity document claims: kinds, countries, sites in order, inception year, places, industries, founders.

    Statements without a value are left out; a document that isn't JSON claims nothing.
    """
    df = entities.withColumn("_e", F.from_json(json, ENTITY))
    c = F.col("_e.claims")
    years = F.filter(F.transform(_values(c["P571"], "time"), lambda t: F.regexp_extract(t, r"^[+-]?(\d{1,4})", 1).try_cast("int")), lambda y: y > 0)
    return df.withColumns({
        "label": F.col("_e.labels")["en"]["value"], "about": F.nullif(F.trim(F.col("_e.descriptions")["en"]["value"]), F.lit("")), "absent": F.col("_e.missing").isNotNull(),
        "kinds": F.array_distinct(_values(c["P31"], "id")), "countries": F.array_distinct(_values(c["P17"], "id")), "sites": _values(c["P856"], None),
        "inception": F.array_min(years), "places": F.array_distinct(_values(c["P159"], "id")), "industries": F.array_distinct(_values(c["P452"], "id")), "founders": F.array_distinct(_values(c["P112"], "id")),
    }).drop("_e")


def usable_site(sites: Column) -> Column:
    """The origin of the first http(s) url."""
    good = F.filter(sites, lambda u: F.trim(u).rlike("(?i)^https?://[^/?#]"))
    first = F.trim(F.get(good, F.lit(0)))
    return F.concat(scheme(first), F.lit("://"), F.regexp_extract(first, r"^[A-Za-z]+://([^/?#]+)", 1), F.lit("/"))
