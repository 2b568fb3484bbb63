"""Links of landed pages: absolute addresses, pages that tell what a company does, and a company's own site in an article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.names import name_tokens, normalize_name, token_subset
from fathomline.functions.text import page_links
from fathomline.functions.urls import AGGREGATORS, canonical_domain, dated_article, hostname, on_host, path, storable

# fixed values: words of a telling link
TELLING = ["about", "team", "company", "story", "mission", "product", "platform", "solution", "what-we-do", "how-it-works", "manifesto"]
# fixed value: pattern of paths that tell nothing
REJECTED = (
    r"(?i)(?:\.(?:pdf|png|jpg|jpeg|gif|svg|webp|css|js|ico|xml|zip|mp4|webm)$|"
    r"/(?:privacy|terms|legal|cookie|gdpr|login|signin|signup|register|contact|support|help|press|blog|news|careers|jobs|pricing|docs?|api)(?:/|$))"
)
SHORTEST_LABEL = 4  # fixed value: a shorter name is within too many domains
ORIGIN = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"


def origin(url: Column) -> Column:
    return F.regexp_extract(url, ORIGIN, 1)


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def _walked(p: Column) -> Column:
    """A path without its dot segments."""
    parts = F.split(p, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def absolute(base: Column, href: Column) -> Column:
    """``href`` as an address seen from the page ``base``."""
    tail = F.regexp_extract(href, r"([?#].*)$", 1)
    own = F.regexp_replace(href, r"[?#].*$", "")
    here = F.when(path(base) == "", "/").otherwise(path(base))
    folder = F.regexp_replace(here, "[^/]*$", "")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.lit(":"), href))
        .when(own == "", F.concat(origin(base), path(base), F.when(href.startswith("#"), F.regexp_extract(base, r"(\?[^#]*)", 1)).otherwise(""), tail))
        .when(own.startswith("/"), F.concat(origin(base), _walked(own), tail))
        .otherwise(F.concat(origin(base), _walked(F.concat(folder, own)), tail))
    )


def outbound(pages: DataFrame, keep: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """``keep``, ``base``, ``pos``, ``link`` and ``label`` for each http(s) link of each page, in order and with repeats."""
    found = pages.select(*keep, F.col(url).alias("base"), F.posexplode(page_links(html)).alias("pos", "l"))
    href = F.trim(F.coalesce(F.col("l.url"), F.lit("")))
    found = found.withColumn("href", href).where((href != "") & ~href.rlike(r"^(?:#|mailto:|tel:|javascript:)"))
    found = found.select(*keep, "base", "pos", absolute(F.col("base"), F.col("href")).alias("link"), F.trim(F.coalesce(F.col("l.label"), F.lit(""))).alias("label"))
    return found.where(F.lower(F.regexp_extract("link", "^([A-Za-z]+)://", 1)).isin("http", "https") & (authority(F.col("link")) != ""))


def telling_links(pages: DataFrame, keep: list[str], most: int = 3, url: str = "url", html: str = "html") -> DataFrame:
    """``keep``, ``rank`` and ``link``: the ``most`` links of a page's own host that tell most of the company.

    A word of ``TELLING`` in the path or the label counts one; ties go to the longer label, then by address. The page itself, assets, legal
    and sales pages are left out, and of links to one address the first counts. ``keep`` names a page.
    """
    found = outbound(pages, keep, url, html).where((authority(F.col("link")) == authority(F.col("base"))) & (authority(F.col("base")) != ""))
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "#.*$", ""), "/+$", "")
    found = found.withColumn("link", plain(F.col("link"))).where((F.col("link") != F.regexp_replace("base", "/+$", "")) & ~path(F.col("link")).rlike(REJECTED))
    first = Window.partitionBy(*keep, "link").orderBy("pos")
    found = found.withColumn("n", F.row_number().over(first)).where("n = 1")
    low = F.lower("label")
    score = sum((F.when(F.lower(path(F.col("link"))).contains(w) | low.contains(w), 1).otherwise(0) for w in TELLING), F.lit(0))
    best = Window.partitionBy(*keep).orderBy(F.desc("score"), F.desc(F.length("label")), "link")
    return found.withColumn("score", score).where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select(*keep, "rank", "link")


def company_link(articles: DataFrame, keep: list[str], name: str = "name", url: str = "url", html: str = "html", rejected: str | None = None) -> DataFrame:
    """``keep`` and ``site``: the origin of the link in an article that is most likely the company's own site.

    The first link whose domain holds the company's name, or is held by it, wins; else the first whose label has all tokens of its name, or they all of the label. The
    publisher's own links, aggregators, articles and shared hosts don't count, nor do the domains in the array ``rejected``. Articles without one have no row.
    """
    more = [F.col(name).alias("_name"), (F.col(rejected) if rejected else F.array().cast("array<string>")).alias("_rejected")]
    found = outbound(articles.select(*keep, url, html, *more), [*keep, "_name", "_rejected"], url, html)
    link = F.col("link")
    host, own, domain = hostname(link), hostname(F.col("base")), canonical_domain(link)
    fits = storable(link) & ~on_host(host, AGGREGATORS) & ~dated_article(link) & (host != own) & ~host.endswith(F.concat(F.lit("."), own))
    fits = fits & domain.isNotNull() & ~F.coalesce(F.array_contains("_rejected", domain), F.lit(False)) & (F.size(name_tokens(F.col("_name"))) > 0)
    label = normalize_name(F.regexp_replace(F.regexp_replace(domain, r"\.[^.]*$", ""), r"\.", ""))
    named = normalize_name(F.col("_name"))
    strong = (label != "") & (F.length(named) >= SHORTEST_LABEL) & (label.contains(named) | named.contains(label))
    weak = token_subset(F.col("_name"), F.col("label"))
    ranked = found.where(fits).withColumn("kind", F.when(strong, 0).when(weak, 1)).where("kind is not null")
    best = ranked.groupBy(*keep).agg(F.min(F.struct("kind", "pos", F.concat(origin(link), F.lit("/")).alias("site"))).alias("b"))
    return best.select(*keep, "b.site")
