import json

import pytest

from fathomline.sources.landing import land
from fathomline.sources.listings import FIRMS, portfolio, read_firm, read_listing_pages


def landed(spark, tmp_path, rows):
    place = f"file://{tmp_path}/landed"
    return land(spark.createDataFrame(rows, "listing string, page string, body string"), place)


def hits(names, total=None, **more):
    return json.dumps({"hits": [{"name": n, **more} if isinstance(n, str) or n is None else n for n in names]} | ({} if total is None else {"nbPages": total}))


def test_pages_are_planned_and_ordered(spark, tmp_path):
    rows = [("yc", "0", hits(["a", " b ", "", None, 7, {"name": "early", "stage": "Pre-Seed"}], 3)), ("yc", "1", hits([], 3)), ("yc", "2", hits(["c", "a"], 3)), ("yc", "10", hits(["beyond"])), ("other", "0", hits(["x"]))]
    df = read_listing_pages(spark, landed(spark, tmp_path, rows), "paged", skip="Pre-Seed")
    got = [(r.listing, r.name) for r in df.orderBy("listing", "pos").collect()]
    assert got == [("other", "x"), ("yc", "a"), ("yc", "b"), ("yc", "c"), ("yc", "a")]
    assert sorted((r.listing, r.name) for r in portfolio(df).collect()) == [("other", "x"), ("yc", "a"), ("yc", "b"), ("yc", "c")]
    assert df.rdd.getNumPartitions() == 3 + 1 + 2  # pages, and a check a listing


@pytest.mark.parametrize(
    ("kind", "rows"),
    [
        ("paged", [("a", "0", hits(["x"], 2))]),  # a page is absent
        ("paged", [("a", "0", hits([" ", None], 1))]),  # no usable entry at all
        ("paged", [("a", "0", "<html>")]),
        ("paged", [("a", "0", hits(["x"], 2)), ("a", "1", '{"hits": 5}')]),
        ("island", [("a", "0", "<script>var x = 1</script>")]),
        ("island", [("a", "0", "m = [1, 2")]),
        ("sitemap", [("a", "index", "<sitemapindex><sitemap><loc>http://x/one.xml</loc></sitemap></sitemapindex>")]),
        ("sitemap", [("a", "0", "<urlset><url><loc>http://x/team/y</loc></url></urlset>")]),
        ("cards", [("a", "0", "<p>nothing</p>")]),
    ],
)
def test_structural_misses_fail(spark, tmp_path, kind, rows):
    with pytest.raises(Exception, match="StructuralMiss"):
        read_listing_pages(spark, landed(spark, tmp_path, rows), kind, marker="m = ", css="c").collect()


def test_no_listing_fails(spark, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="no landed listing"):
        read_listing_pages(spark, f"file://{tmp_path}/none", "paged").collect()


def test_firms(spark, tmp_path):
    rows = [
        ("a16z", "0", 'x<script>a16z_portfolio_companies = [{"title": "A ]}", "web": "http://a"}, {"title": "[untitled]"}, 3, {"title": null}, {"title": "B", "web": " "}];</script>'),
        ("kleiner_perkins", "index", '<sitemapindex xmlns="http://s"><sitemap><loc>http://k/one.xml</loc></sitemap><sitemap><loc>http://k/two.xml</loc></sitemap></sitemapindex>'),
        ("kleiner_perkins", "one.xml", "<urlset><url><loc>http://k/company/big-data_co/</loc></url><url><loc>http://k/about</loc></url></urlset>"),
        ("kleiner_perkins", "two.xml", "<urlset><url><loc>http://k/company/big-data-co</loc></url><url><loc>http://k/company/%C3%A9t%C3%A9</loc></url></urlset>"),
        ("khosla", "0", '<a class="company-slide" href="http://front"><b>One</b> &amp; Co</a>'),
        ("khosla", "bio", '<a class="company-slide" href="http://late">One &amp; Co</a><div class="company-slide">Two</div>'),
        ("yc", "0", hits(["y"], 1, website="", one_liner="does y")),
    ]
    place = landed(spark, tmp_path, rows)
    got = {firm: sorted((r.name, r.website, r.description) for r in read_firm(spark, place, firm).collect()) for firm in ("a16z", "kleiner_perkins", "khosla", "yc")}
    assert got == {
        "a16z": [("A ]}", "http://a", None), ("B", None, None)], "kleiner_perkins": [("Big Data Co", None, None), ("Été", None, None)],
        "khosla": [("One & Co", "http://front", None), ("Two", None, None)], "yc": [("y", None, "does y")],
    }
    assert set(got) <= set(FIRMS)


def test_result_links(spark, tmp_path):
    body = '<a class="result__a" href="/l/?kh=-1&amp;uddg=https%3A%2F%2Fx.com%2Fa%3Fb%3D1">t</a><a class="result__a" href="/l/?kh=-1">t</a><a class="result__a" href="https://y.com">t</a><a class="result__a" href="https://y.com">t</a><a href="https://z.com">t</a><a class="result__a b" href="https://w.com">t</a>'
    place = landed(spark, tmp_path, [("q", "0", body)])
    assert [r.website for r in read_listing_pages(spark, place, "results").orderBy("pos").collect()] == ["https://x.com/a?b=1", "https://y.com", "https://w.com"]
    assert [r.website for r in read_listing_pages(spark, place, "results", limit=2).orderBy("pos").collect()] == ["https://x.com/a?b=1", "https://y.com"]
