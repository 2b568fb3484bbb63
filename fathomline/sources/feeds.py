"""Landed source files: RSS and Atom feeds, JSON listings, HTML cards, sitemaps.

Network clients are outside the engine; their landed files are the sources. ``nonempty`` fails a source
that yields no row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fathomline.functions.text import balanced, funding_words, squeeze
from fathomline.functions.urls import canonical_url, hostname, storable
from fathomline.sources.landing import kept

SNIPPET = 600


def nonempty(df: DataFrame, source: str) -> DataFrame:
    """``df``, or an error at run time if it has no row."""
    n = df.limit(1).agg(F.count("*").alias("_n"))
    # no row if there is one, and an error if there is none
    guard = n.where(F.when(F.col("_n") > 0, F.lit(False)).otherwise(F.raise_error(F.lit(f"{source} has no row")).cast("boolean")))
    return df.unionByName(guard.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]))


@dataclass(frozen=True)
class Outlet:
    """How an outlet's feed is read: its look-back in days, where a word of funding must stand, and how long a snippet may be."""

    days: int
    words: str | None  # "whole" item, "lede" (title and snippet) or None: the feed is about funding anyway
    snippet: int | None = None


#: The feeds' rules.
OUTLETS = {
    "techcrunch": Outlet(7, None),
    "siliconangle": Outlet(14, "whole"),
    "prnewswire": Outlet(14, "whole"),
    "crunchbase_news": Outlet(14, "whole"),
    "geekwire": Outlet(14, None, SNIPPET),
    "venturebeat": Outlet(7, "lede", SNIPPET),
}


def read_rss(spark: SparkSession, path: str, as_of: str, outlet: Outlet) -> DataFrame:
    """``parse_rss`` of the files at ``path``."""
    return parse_rss(spark.read.text(path, wholetext=True), as_of, outlet)


FEED = (
    "channel struct<item: array<struct<title: string, link: string, pubDate: string, description: string>>>, "
    "entry array<struct<title: string, link: array<struct<_href: string>>, published: string, updated: string, summary: string>>"
)


def feed_items(xml: DataFrame) -> DataFrame:
    """``(link, title, day, summary)`` of the items of RSS and Atom feeds in ``xml(value)``, each item's parts together.

    A part that an item lacks is null; a file that isn't XML has no items.
    """
    return xml.select(F.from_xml("value", FEED, {"mode": "PERMISSIVE"}).alias("f")).select(F.inline(_items()))


def _items():
    rss = F.transform("f.channel.item", lambda i: F.struct(F.trim(i["link"]).alias("link"), i["title"].alias("title"), F.to_date(F.try_to_timestamp(F.regexp_extract(i["pubDate"], r"(\d{1,2} \w{3} \d{4})", 1), F.lit("d MMM yyyy"))).alias("day"), i["description"].alias("summary")))
    atom = F.transform("f.entry", lambda i: F.struct(F.trim(F.get(i["link"], F.lit(0))["_href"]).alias("link"), i["title"].alias("title"), F.to_date(F.try_to_timestamp(F.substring(F.coalesce(i["published"], i["updated"]), 1, 10), F.lit("yyyy-MM-dd"))).alias("day"), i["summary"].alias("summary")))
    return F.concat(F.coalesce(rss, F.array()), F.coalesce(atom, F.array()))


def parse_rss(xml: DataFrame, as_of: str, outlet: Outlet) -> DataFrame:
    """``(link, title, source, published, summary)`` of the items of feeds in ``xml(value)`` by an outlet's rules.

    Links are canonical, and of a feed's items with one link the first counts; an item needs a link and a title. Undated
    items stay; a summary is plain text, empty if absent. A file that isn't XML has no items.
    """
    feeds = xml.select(F.xxhash64("value").alias("feed"), F.from_xml("value", FEED, {"mode": "PERMISSIVE"}).alias("f"))
    items = feeds.select("feed", F.posexplode(_items()).alias("pos", "item")).select("feed", "pos", "item.*")
    items = items.where((F.col("link") != "") & (F.col("title") != "")).withColumn("link", F.when(storable(F.col("link")), canonical_url(F.col("link"))).otherwise(F.col("link")))
    text = squeeze(F.regexp_replace(F.coalesce("summary", F.lit("")), "<[^>]*>", " "))
    items = items.where(F.col("day").isNull() | (F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), outlet.days))).withColumn("summary", text)
    lede = F.substring("summary", 1, outlet.snippet) if outlet.snippet else F.col("summary")
    if outlet.words:
        items = items.where(funding_words(F.concat_ws("\n", "title", lede if outlet.words == "lede" else F.col("summary"))))
    first = Window.partitionBy("feed", "link").orderBy("pos")
    items = items.withColumn("n", F.row_number().over(first)).where("n = 1")
    return items.select("link", "title", hostname(F.col("link")).alias("source"), F.col("day").alias("published"), lede.alias("summary"))


def read_listing(spark: SparkSession, path: str, schema: str, name: str, website: str) -> DataFrame:
    """Portfolio rows of JSON lines or arrays: ``(name, website)``, blank names dropped."""
    df = spark.read.schema(schema).json(path, multiLine=True)
    return df.select(F.trim(F.col(name)).alias("name"), F.col(website).alias("website")).where("name <> ''").dropDuplicates(["name"])


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.explode(F.xpath("value", F.lit("//*[local-name()='loc']/text()"))).alias("url"))


def islands(df: DataFrame, text: str, marker: str, schema: str) -> DataFrame:
    """The JSON value that follows ``marker`` in a page's script, read by ``schema``."""

    def cut(values: pd.Series) -> pd.Series:
        return values.map(lambda v: balanced(v, v.find(marker)) if v and marker in v else None)

    return df.withColumn("island", F.from_json(F.pandas_udf(cut, "string")(F.col(text)), schema))


class _Cards(HTMLParser):
    """Text and first link of each element of a class."""

    VOID = {"br", "img", "hr", "input", "meta", "link"}

    def __init__(self, css_class: str):
        super().__init__(convert_charrefs=True)
        self.css_class, self.cards, self.depth = css_class, [], 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if not self.depth and self.css_class in (a.get("class") or "").split():
            self.cards.append({"name": "", "url": None})
            self.depth = 1
        elif self.depth and tag not in self.VOID:
            self.depth += 1
        if self.depth and tag == "a" and self.cards[-1]["url"] is None:
            self.cards[-1]["url"] = a.get("href")

    def handle_endtag(self, tag):
        if self.depth and tag not in self.VOID:
            self.depth -= 1

    def handle_data(self, data):
        if self.depth:
            self.cards[-1]["name"] = " ".join(f"{self.cards[-1]['name']} {data}".split())


def cards(html: str | None, css_class: str) -> list[dict]:
    reader = _Cards(css_class)
    reader.feed(html or "")
    reader.close()
    return [c for c in reader.cards if c["name"]]


def read_cards(pages: DataFrame, html: str, css_class: str) -> DataFrame:
    """A row for each card of a page: ``(name, url)``, first of each name."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda h: cards(h, css_class))

    udf = F.pandas_udf(run, "array<struct<name:string,url:string>>")
    return pages.select(F.explode(udf(F.col(html))).alias("c")).select("c.*").dropDuplicates(["name"])


def external(df: DataFrame, call: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """Seam for outside services (models, resolvers): ``call`` maps a batch's rows to rows of ``schema``."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame(call(batch.to_dict("records")))

    return df.mapInPandas(run, schema)


def or_empty(build: Callable[[], DataFrame], schema: str, run: bool = False) -> DataFrame:
    """What ``build`` gives, or no row of ``schema`` where it can't be planned (a table or column is absent).

    With ``run`` it is also carried out and written down here, so that a job that fails gives no row either.
    """
    from pyspark.errors import AnalysisException, PySparkException

    spark = SparkSession.active()
    try:
        return kept(build().select(*[f.name for f in StructType.fromDDL(schema).fields]), "answer") if run else build()
    except AnalysisException:
        return spark.createDataFrame([], schema)
    except (PySparkException, Py4JJavaError):
        if not run:
            raise
        return spark.createDataFrame([], schema)
