"""Portfolio listings, landed page by page and read through the ``listing`` data source."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.plans.registry import q
from fathomline.sources.landing import land
from fathomline.sources.links import company_link, telling_links
from fathomline.sources.listings import headcounts, portfolio, read_listing_pages, refreshed

NAME = "concat(p_name, ' no ', cast(p_partkey as string))"
PAGE = "cast((p_partkey div 25) % 8 as string)"
SITE = "case when p_partkey % 7 = 0 then null else concat('https://p', cast(p_partkey as string), '.example.com') end"


def parts(t):
    """A listing a brand, on eight pages."""
    return t.raw("part").select("p_partkey", F.col("p_brand").alias("listing"), F.expr(PAGE).alias("page"), F.expr(NAME).alias("name"), F.expr(SITE).alias("website"), F.col("p_type").alias("one_liner"))


def joined(rows, item, before="", after="", order="p_partkey"):
    """``(listing, page, body)``: the items of a page between ``before`` and ``after``."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, item.alias("x")))), lambda s: s["x"]), ",")
    return rows.groupBy("listing", "page").agg(F.concat(F.lit(before), body, F.lit(after)).alias("body"))


def paged(t):
    """Pages of hits: blank names, early stages, empty addresses, an empty page and a page past the last."""
    rows = parts(t).withColumn("name", F.when(F.col("p_partkey") % 10 == 0, "  ").otherwise(F.col("name"))).withColumn("website", F.coalesce("website", F.lit("")))
    hit = F.to_json(F.struct("name", "website", "one_liner", F.when(F.col("p_partkey") % 6 == 0, "Pre-Seed").otherwise("Seed").alias("stage")))
    full = joined(rows, hit, '{"results": [{"nbPages": 9, "hits": [', "]}]}")
    others = rows.select("listing").distinct().select("listing", F.explode(F.array(*[F.struct(F.lit(p).alias("page"), F.lit(b).alias("body")) for p, b in (("8", '{"results": [{"hits": []}]}'), ("12", '{"results": [{"hits": [{"name": "past the last"}]}]}'))])).alias("x"))
    # a page that no row fell on lands empty
    every = rows.select("listing").distinct().withColumn("page", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda n: n.cast("string"))))
    full = every.join(full, ["listing", "page"], "left").withColumn("body", F.coalesce("body", F.lit('{"results": [{"nbPages": 9, "hits": []}]}')))
    return land(full.unionByName(others.select("listing", "x.*")))


def islands(t):
    """A page's script with the array of all companies: unnamed ones, and entries that are none."""
    rows = parts(t).withColumn("page", F.lit("0"))
    entry = F.when(F.col("p_partkey") % 9 == 0, F.lit('"not an entry"')).otherwise(F.to_json(F.struct(F.when(F.col("p_partkey") % 5 == 0, "[untitled]").otherwise(F.col("name")).alias("title"), F.col("website").alias("web"))))
    return land(joined(rows, entry, "<html><script>var other = [1]; window.a16z_portfolio_companies = [", "]; done();</script></html>"))


def sitemaps(t):
    """An index of eight sitemaps; one that the index leaves out; addresses of other pages."""
    slug = F.replace(F.replace("name", F.lit(" "), F.lit("-")), F.lit("'"), F.lit(""))
    rows = parts(t).withColumn("page", F.concat(F.lit("part-"), "page", F.lit(".xml")))
    url = F.concat(F.lit("<url><loc>https://firm.example.com/"), F.when(F.col("p_partkey") % 4 == 0, "team/").otherwise("company/"), slug, F.lit("/</loc></url>"))
    maps = joined(rows, url, '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', "</urlset>").withColumn("body", F.replace("body", F.lit("</url>,<url>"), F.lit("</url><url>")))
    index = maps.groupBy("listing").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<sitemap><loc>https://firm.example.com/"), "page", F.lit("</loc></sitemap>")))), "").alias("b"))
    index = index.select("listing", F.lit("index").alias("page"), F.concat(F.lit("<sitemapindex>"), "b", F.lit("</sitemapindex>")).alias("body"))
    stray = index.select("listing", F.lit("stray.xml").alias("page"), F.lit("<urlset><url><loc>https://firm.example.com/company/stray</loc></url></urlset>").alias("body"))
    return land(maps.unionByName(index).unionByName(stray))


def categories(t):
    """A landing page's cards, and the same companies again under their categories."""
    rows = parts(t)
    card = F.concat(F.lit('<a class="company-slide x" href="'), F.coalesce("website", F.lit("")), F.lit('"><b>'), "name", F.lit("</b></a><p>no card</p>"))
    front = joined(rows.where("p_partkey % 3 = 0").withColumn("page", F.lit("0")), card)
    again = F.concat(F.lit('<a class="company-slide" href="https://again.example.com">'), "name", F.lit("</a>"))
    below = joined(rows.withColumn("page", F.concat(F.lit("category-"), "page")), F.when(F.col("p_partkey") % 3 == 0, again).otherwise(card))
    return land(front.unionByName(below))


def results(t):
    """Pages of search results: redirects, plain links, repeats, other schemes and other anchors."""
    p = t.raw("pages").select("page_id", "url")
    link = lambda href: F.concat(F.lit('<a class="result__a" href="'), href, F.lit('">t</a>'))
    plain = F.concat(F.lit("https://r.example.com/"), "page_id")
    moved = F.concat(F.lit("//duckduckgo.com/l/?kh=-1&amp;uddg="), F.replace(F.replace(plain, F.lit(":"), F.lit("%3A")), F.lit("/"), F.lit("%2F")))
    body = F.concat(F.lit("<a href='https://none.example.com'>n</a>"), link(F.when(F.col("page_id") % 2 == 0, moved).otherwise(plain)), link(plain), link(F.lit("ftp://f.example.com")), link(F.concat(plain, F.lit("/b"))), link(F.concat(plain, F.lit("/c"))), link(F.concat(plain, F.lit("/d"))))
    return land(p.groupBy((F.col("page_id") % 16).cast("string").alias("listing"), (F.floor(F.col("page_id") / 16) % 4).cast("string").alias("page")).agg(F.array_join(F.array_sort(F.collect_list(F.when(F.lit(True), body))), "").alias("body")))


PART = f"select p_partkey, p_brand as listing, {NAME.replace('string', 'varchar')} as name, {SITE.replace('string', 'varchar')} as website, p_type from part"
q("S17_paged_listing", lambda t: portfolio(read_listing_pages(t.spark, paged(t), "paged", skip="Pre-Seed")),
  f"select listing, name, website, p_type as description from ({PART}) where p_partkey % 10 <> 0 and p_partkey % 6 <> 0")
q("S18_island_listing", lambda t: portfolio(read_listing_pages(t.spark, islands(t), "island", marker="a16z_portfolio_companies = ")),
  f"select listing, name, website, cast(null as varchar) as description from ({PART}) where p_partkey % 5 <> 0 and p_partkey % 9 <> 0")
q("S24_sitemap_listing", lambda t: portfolio(read_listing_pages(t.spark, sitemaps(t), "sitemap")).select("listing", "name"),
  f"select listing, array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') as name from ({PART}) where p_partkey % 4 <> 0")
q("S22_category_cards", lambda t: portfolio(read_listing_pages(t.spark, categories(t), "cards", css="company-slide")).select("listing", "name", "website"), f"select listing, name, website from ({PART})")
q("S29_result_links", lambda t: read_listing_pages(t.spark, results(t), "results").select("listing", "website").distinct(),
  "select distinct cast(page_id % 16 as varchar) as listing, 'https://r.example.com/' || page_id || s as website from pages, (values (''), ('/b'), ('/c'), ('/d')) x(s)")
SIZES = {"theorg": "id % 5 = 0", "growjo": "id % 3 = 0", "careers_page": "id % 2 = 0", "github": "id % 7 = 0", "wellfound": "id % 11 < 8", "a blog": "true"}


def sizes(t):
    """What sources say of a company's size, some without a range, one that isn't trusted."""
    told = [F.when(F.expr(when), F.struct(F.lit(s).alias("source"), (F.col("id") % 90 + len(s)).alias("low"), F.when(F.col("id") % 13 != n, F.col("id") % 90 + 100).alias("high"))) for n, (s, when) in enumerate(SIZES.items())]
    return t.companies.select(F.col("id").alias("company_id"), F.explode(F.array_compact(F.array(*told))).alias("s")).select("company_id", "s.*")


SIZED = " union all ".join(f"select id, {n} as rank, '{s}' as source, id % 90 + {len(s)} as low, id % 90 + 100 as high from companies where {when} and id % 13 <> {n}" for n, (s, when) in enumerate(SIZES.items()) if s != "a blog")
q("S30_trusted_headcounts", lambda t: headcounts(sizes(t)), f"select id as company_id, low, high, source from (select *, row_number() over (partition by id order by rank) as n from ({SIZED})) where n = 1")


def linked(t):
    """Pages with more links: telling and idle ones of their own host, companies' sites, aggregators and other schemes."""
    more = [
        "/about-us", "../our-product/x", "team.pdf", "/blog/about", "//x.example.com/about", "mailto:a@b.c", "?page=about", "/About-Us#top", "https://www.techcrunch.com/company", "https://get-acme.io/a?b=1",
        "https://acmeworks.example.org/2024/01/02/x", "https://other.example.org/", "https://acme-news.github.io/x",
    ]
    anchor = lambda n, href: F.concat(F.lit(f'<a href="{href}">'), F.when(F.col("page_id") % 3 == n % 3, "our Platform story").otherwise("Acme Works here"), F.lit("</a>"))
    extra = [F.when(F.col("page_id") % 13 != n, anchor(n, href)).otherwise("") for n, href in enumerate(more)]
    return t.raw("pages").select("page_id", "url", F.concat(F.coalesce("html", F.lit("")), *extra).alias("html"), F.expr("case page_id % 4 when 0 then 'Acme' when 1 then 'Works' when 2 then 'Acme Works' end").alias("name"))


q("T36_telling_links", lambda t: telling_links(linked(t), ["page_id"]))
q("T35_company_links", lambda t: company_link(linked(t), ["page_id"]))


def swept(t):
    """A sweep over landed arrays: a quarter of the companies is known, one brand's floor is too high, one listing is absent."""
    entries = portfolio(read_listing_pages(t.spark, islands(t), "island", marker="a16z_portfolio_companies = "))
    known = parts(t).where("p_partkey % 4 = 0").select(F.concat(F.upper("name"), F.lit(", Inc.")).alias("name"))
    floors = entries.select("listing").distinct().select("listing", F.when(F.col("listing") == "Brand#11", 10**9).otherwise(1).alias("floor")).unionByName(t.spark.range(1).select(F.lit("Brand#0").alias("listing"), F.lit(1).alias("floor")))
    return refreshed(entries, known, floors)


SWEPT = f"({PART}) where p_partkey % 5 <> 0 and p_partkey % 9 <> 0"
q("Z13_sweep_outcomes", lambda t: swept(t)[0], f"select listing, count(*) as found, count(*) filter (where p_partkey % 4 <> 0) as fresh, case when listing = 'Brand#11' then 'low' else 'ok' end as outcome from {SWEPT} group by 1 union all select 'Brand#0', 0, 0, 'absent'")
q("Z13_companies_to_add", lambda t: swept(t)[1].select("listing", "name", "website"), f"select listing, name, website from {SWEPT} and p_partkey % 4 <> 0 and listing <> 'Brand#11'")
