import re
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from fathomline.functions.text import _by_value, links
from fathomline.plans.listings import linked
from fathomline.sources import links as L
from fathomline.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def test_absolute_addresses(spark):
    bases = ["http://a.com", "http://a.com/", "https://a.com/x/y?q=1", "https://a.com/x/y/#f", "https://A.com:80/x/y/z"]
    hrefs = ["b", "/b/c", "./b", "../b", "../../b", "../../../b", "//c.com/d", "?r=2", "#s", "b/../c", "b/.", "https://d.com/e", "b?x=/../y", "/b/./c/../d/", ".."]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    for r in df.select("b", "h", L.absolute(F.col("b"), F.col("h")).alias("u")).collect():
        want = urljoin(r.b, r.h)
        assert r.u == want or r.u.rstrip("/") == want.rstrip("/"), (r.b, r.h, r.u, want)


def telling(url, html):
    host, seen, out = urlparse(url).netloc.lower(), set(), []
    for x in links(html):
        href, text = (x["url"] or "").strip(), (x["label"] or "").strip().lower()
        if not href or href.startswith(("#", "mailto:", "tel:", "javascript:")):
            continue
        p = urlparse(urljoin(url, href))
        plain = p._replace(fragment="").geturl().rstrip("/")
        if p.scheme not in ("http", "https") or p.netloc.lower() != host or plain == url.rstrip("/") or re.search(L.REJECTED, p.path.rstrip("/") or p.path) or plain in seen:
            continue
        seen.add(plain)
        score = sum(w in p.path.lower() or w in text for w in L.TELLING)
        if score:
            out.append((-score, -len(text), plain))
    return [u for *_, u in sorted(out)[:3]]


def test_telling_links_against_a_loop(spark):
    df = linked(Tables(spark, SF))
    got = {}
    for r in L.telling_links(df, ["page_id"]).orderBy("page_id", "rank").collect():
        got.setdefault(r.page_id, []).append(r.link)
    want = {r.page_id: telling(r.url, r.html) for r in df.collect()}
    assert got == {k: v for k, v in want.items() if v} and len(got) > 20


def test_company_links(spark):
    a = lambda href, text="x": f'<a href="{href}">{text}</a>'
    cases = [
        ("Acme", a("https://news.com/acme") + a("https://get-acme.io/p?q=1", "site") + a("https://acme.com"), None, "https://get-acme.io/"), ("Acme", a("https://www.linkedin.com/acme") + a("https://sub.news.com/") + a("mailto:x@acme.com"), None, None),
        ("Big Cat", a("https://maker.org/", "the Big Cat") + a("https://bc.org", "Big Cat"), None, "https://maker.org/"), ("Big Cat", a("https://maker.org/", "Big Cat") + a("https://bigcat.ai/x"), None, "https://bigcat.ai/"),
        ("Acme", a("https://acme.com") + a("https://acme.io"), ["acme.com"], "https://acme.io/"), ("Acme", a("https://acme.github.io/x", "Acme"), None, None), ("AI", a("https://ai.com", "z") + a("https://b.com", "AI"), None, "https://b.com/"),
        ("Acme", a("https://acme.com/2024/01/02/raise"), None, None), ("!!", a("https://x.com", "!!"), None, None), (None, a("https://acme.com"), None, None), ("Acme", None, None, None),
    ]
    df = spark.createDataFrame([(n, "https://www.news.com/a", name, html, bad) for n, (name, html, bad, _) in enumerate(cases)], "id long, url string, name string, html string, bad array<string>")
    got = {r.id: r.site for r in L.company_link(df, ["id"], rejected="bad").collect()}
    assert got == {n: c[3] for n, c in enumerate(cases) if c[3]}


def test_pages_reach_python_a_few_at_a_time(spark):
    """A task holds some pages, not an Arrow batch of them: 3,000 pages of 100,000 characters are 300 MB."""
    resident = lambda _: int(open("/proc/self/statm").read().split()[1]) * 4096 // 10**6
    pages = spark.range(0, 3000, numPartitions=1).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 100_000)).alias("html"))
    low, high = pages.select(_by_value(resident, "long", F.col("html")).alias("mb")).agg(F.min("mb"), F.max("mb")).first()
    assert high < 350 and high - low < 100
