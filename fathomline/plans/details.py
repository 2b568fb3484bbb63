"""Supporting operators: worklists, lookups, labels and small rules over the bound tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomline.functions import labels as B
from fathomline.functions import names as N
from fathomline.functions import subjects as S
from fathomline.functions import text as X
from fathomline.functions import urls as U
from fathomline.operators import resolve as M
from fathomline.operators import rounds as R
from fathomline.operators import similarity as V
from fathomline.operators import timeline as L
from fathomline.operators import windows as W
from fathomline.plans.aggregates import D, day
from fathomline.plans.registry import q
from fathomline.plans.relational import NEWS, news
from fathomline.plans.scores import PAIRS
from fathomline.plans.texts import CAPS
from fathomline.sources.feeds import OUTLETS, parse_rss
from fathomline.sources.tables import AS_OF

TABLES = ["nation", "customer", "supplier", "part", "orders", "lineitem"]


def rss(t):
    """Documents landed as feeds of some twenty items: absent, marked-up and long summaries, undated items, repeated links, and a file that is no XML."""
    item = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    n = news(t).withColumn("title", F.when(F.col("id") % 3 == 0, "Acme raised a seed round").otherwise("Other things"))
    told = F.when(F.col("id") % 17 == 0, F.concat(F.repeat(F.lit("word "), 150), F.lit("valuation of Acme"))).when(F.col("id") % 7 == 1, "&lt;b&gt;valuation&lt;/b&gt; of Acme").otherwise("text")
    dated = F.when(F.col("id") % 13 == 0, "").otherwise(item("pubDate", X.rfc822(F.col("published_date").cast("timestamp"))))
    link = F.concat("url", F.lit("/"), F.col("id"), F.when(F.col("id") % 11 == 0, "?utm_source=feed").otherwise(""))
    one = F.concat(F.lit("<item>"), item("title", F.col("title")), item("link", link), dated, F.when(F.col("id") % 5 == 0, "").otherwise(item("description", told)), F.lit("</item>"))
    again = F.when(F.col("id") % 9 == 0, F.concat(F.lit("<item>"), item("title", F.lit("Acme raised again")), item("link", F.concat("url", F.lit("/"), F.col("id"), F.lit("#more"))), F.lit("</item>"))).otherwise("")
    feeds = n.groupBy(F.floor(F.col("id") / 20).alias("feed")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", F.concat(one, again).alias("x")))), lambda s: s["x"]), "").alias("items"))
    return feeds.select(F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("value")).unionByName(t.spark.range(1).select(F.lit("<rss><chan").alias("value")))


ITEMS = f"""with {NEWS}, i as (select concat(url, '/', id) as link, case when id % 3 = 0 then 'Acme raised a seed round' else 'Other things' end as title, 'news.example.com' as source,
 case when id % 13 <> 0 then published_date end as published, case when id % 5 = 0 then '' when id % 17 = 0 then repeat('word ', 150) || 'valuation of Acme' when id % 7 = 1 then 'valuation of Acme' else 'text' end as told, id from news)
 select link, title, source, published, {{summary}} as summary from i where (published is null or published >= {D} - {{days}}) and {{words}}"""


def feed_sql(outlet):
    summary = f"substring(told, 1, {outlet.snippet})" if outlet.snippet else "told"
    words = {None: "true", "whole": "(id % 3 = 0 or contains(told, 'valuation'))", "lede": f"(id % 3 = 0 or contains({summary}, 'valuation'))"}[outlet.words]
    plain = ITEMS.format(summary=summary, days=outlet.days, words=words)
    # a repeated item, undated and without a summary, counts where the first of its link is too old or tells of no funding
    late = f"not ((published is null or published >= {D} - {outlet.days}) and {words})"
    return f"{plain} union all select link, 'Acme raised again', source, null, '' from i where id % 9 = 0 and {late}"


for n, outlet in enumerate(OUTLETS):
    q(f"S{6 + n}_{outlet}", lambda t, outlet=outlet: parse_rss(rss(t), AS_OF, OUTLETS[outlet]), feed_sql(OUTLETS[outlet]))
q("S3_complete_scan", lambda t: W.complete(t.companies.select("slug"), t.raw("customer").count()), "select slug from companies")
q("S3_partial_scan", lambda t: W.complete(t.companies.where("id > 3").select("slug"), t.raw("customer").count()), "select slug from companies where false")
q("S17_json_listing", lambda t: t.raw("events").select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", "p.k").where("k is not null"), "select event_id, cast(json_extract(props, '$.k') as int) as k from events where json_extract(props, '$.k') is not null")
q("S18_embedded_json", lambda t: t.raw("events").select("event_id", F.concat(F.lit("<script>data = "), "props", F.lit(";</script>")).alias("h")).select("event_id", F.get_json_object(F.regexp_extract("h", r"data = (\{.*?\});", 1), "$.k").cast("int").alias("k")), "select event_id, cast(json_extract(props, '$.k') as int) as k from events")
q("S22_deduped_cards", lambda t: t.raw("part").select("p_name").dropDuplicates(["p_name"]), "select distinct p_name from part")
q("S24_sitemap_urls", lambda t: t.raw("pages").select(F.concat(F.lit("<urlset><url><loc>"), X.xml_escape(F.col("url")), F.lit("</loc></url></urlset>")).alias("x")).select(F.explode(F.xpath("x", F.lit("//loc/text()"))).alias("url")), "select url from pages")
q("S27_first_matching_claim", lambda t: t.raw("customer").select(F.col("c_custkey").alias("id"), F.posexplode(F.array("c_mktsegment", F.lit("BUILDING"), F.lit("MACHINERY"))).alias("pos", "v")).where("v <> 'FURNITURE' and length(v) > 8").groupBy("id").agg(F.min_by("v", "pos").alias("v")), "select c_custkey as id, case when c_mktsegment <> 'FURNITURE' and length(c_mktsegment) > 8 then c_mktsegment else 'MACHINERY' end as v from customer")
q("S29_first_links", lambda t: t.raw("pages").select("page_id", F.slice(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1)), 1, 3).alias("l")).select("page_id", F.array_join("l", ",").alias("links")), "select page_id, array_to_string(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)[1:3], ',') as links from pages")
q("S38_report_rows", lambda t: t.runs.groupBy("stage", "status").agg(F.count("*").alias("n")), "select stage, status, count(*) as n from runs group by 1, 2")
q("A32_table_rows", lambda t: reduce(lambda a, b: a.unionByName(b), [t.raw(n).agg(F.lit(n).alias("table"), F.count("*").alias("n")) for n in TABLES]), " union all ".join(f"select '{n}' as \"table\", count(*) as n from {n}" for n in TABLES))
q("F18_claim_current", lambda t: t.rounds.where("amount_raised is not null").select("id", F.concat(F.lit("raised "), N.claim_usd(F.col("amount_raised"))).alias("want"), F.when(F.col("id") % 4 == 0, "raised $1M in all").otherwise(F.concat(F.lit("Acme raised "), N.claim_usd(F.col("amount_raised")), F.lit("."))).alias("claim")).select("id", F.col("claim").contains(F.col("want")).alias("current")), "select id, id % 4 <> 0 as current from rounds where amount_raised is not null")
q("L10_one_at_random", lambda t: t.companies.select("slug").orderBy(F.md5(F.concat(F.lit("7:"), "slug").cast("binary")), "slug").limit(1), "select slug from companies order by md5('7:' || slug), slug limit 1")
q("U7_set_tallies", lambda t: t.companies.select("id", F.array(F.lit(1), F.col("id") % 3, F.lit(5)).alias("a"), F.array(F.col("id") % 4, F.lit(5)).alias("b")).select("id", F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_except("b", "a")).alias("extra"), F.size(F.array_except("a", "b")).alias("missed")),
  "with s as (select id, list_distinct([1, id % 3, 5]) as a, list_distinct([id % 4, 5]) as b from companies) select id, cast(len(list_intersect(a, b)) as int) as both, cast(len(list_filter(b, lambda x: not list_contains(a, x))) as int) as extra, cast(len(list_filter(a, lambda x: not list_contains(b, x))) as int) as missed from s")

# entities
INCOMING = "incoming as (select case when p_partkey % 3 = 0 then concat('Customer#', lpad(cast(p_partkey as varchar), 9, '0')) else p_name end as name from part)"


def incoming(t):
    return t.raw("part").select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Customer#"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))).otherwise(F.col("p_name")).alias("name"))


q("M3_find_or_create", lambda t: (lambda i: i.join(t.companies.select(F.lower("name").alias("key")), "key", "left_anti").groupBy("key").agg(F.min("name").alias("name")))(incoming(t).withColumn("key", F.lower("name"))), f"with {INCOMING} select lower(name) as key, min(name) as name from incoming where lower(name) not in (select lower(name) from companies) group by 1")
q("M6_field_merge", lambda t: t.rounds.alias("a").join(t.rounds.alias("b"), F.expr("b.id = a.id + 1")).select(F.expr("a.id as id"), F.expr("coalesce(a.round_type, b.round_type) as round_type"), F.expr("coalesce(a.news_url, b.news_url) as news_url"), F.greatest(R.confidence_rank("a.confidence"), R.confidence_rank("b.confidence")).alias("sure")),
  "select a.id, coalesce(a.round_type, b.round_type) as round_type, coalesce(a.news_url, b.news_url) as news_url, greatest(case a.confidence when 'high' then 2 when 'medium' then 1 else 0 end, case b.confidence when 'high' then 2 when 'medium' then 1 else 0 end) as sure from rounds a join rounds b on b.id = a.id + 1")
q("M8_investor_upsert", lambda t: incoming(t).where(~F.lower("name").rlike(r"^(?:customer#0000000\d\d|tbd|various)$")).select(N.normalize_name(F.col("name")).alias("key"), "name").groupBy("key").agg(F.min("name").alias("name")), f"with {INCOMING} select regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') as key, min(name) as name from incoming where not regexp_matches(lower(name), '^(?:customer#0000000[0-9][0-9]|tbd|various)$') group by 1")
q("M13_gated_pairs", lambda t: V.smallest_alike(t.raw("part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("name")), 0.6, F.pmod("id", F.lit(2))).select("right_id", F.col("left_id").alias("survivor")), f"with {PAIRS} select right_id, min(left_id) as survivor from pairs where similarity >= 0.6 and left_id < right_id and (left_id + right_id) % 2 = 0 group by 1")
q("M20_conflicting_types", lambda t: t.rounds.where("round_type is not null and amount_raised is not null").groupBy("company_id", F.floor(F.col("amount_raised") / 10000).alias("band")).agg(F.countDistinct("round_type").alias("types"), F.min("announced_date").alias("first")).where("types > 1"), "select company_id, floor(amount_raised / 10000) as band, count(distinct round_type) as types, min(announced_date) as first from rounds where round_type is not null and amount_raised is not null group by 1, 2 having count(distinct round_type) > 1")
q("M25_verdict_purge", lambda t: (lambda wrong: news(t).join(wrong, "id", "left_anti").groupBy("company_id").agg(F.count("*").alias("n")))(t.raw("labels").where("quality = 0").select(F.col("doc_id").alias("id"))), f"with {NEWS} select company_id, count(*) as n from news where id not in (select doc_id from labels where quality = 0) group by 1")
q("M29_catalog_repair", lambda t: t.companies.select("id", F.when(F.col("website").contains("c66"), None).otherwise(F.col("website")).alias("website"), N.strip_suffix(F.concat("name", F.when(F.col("id") % 2 == 0, " Inc.").otherwise(""))).alias("name")), "select id, case when contains(website, 'c66') then null else website end as website, name from companies")
q("M30_casing_upgrade", lambda t: t.raw("part").select("p_partkey", F.lower("p_name").alias("name"), S.leading_segment(F.concat(F.initcap("p_name"), F.when(F.col("p_partkey") % 3 == 0, " goods").otherwise(""), F.lit(" | Official site"))).alias("brand")).select("p_partkey", F.when((F.lower("brand") == F.col("name")) & (F.col("brand") != F.col("name")), F.col("brand")).otherwise(F.col("name")).alias("name")),
  "select p_partkey, case when p_partkey % 3 = 0 then lower(p_name) else array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') end as name from part")
q("M33_verdict_upsert", lambda t: M.upsert(t.raw("labels").select("doc_id", "quality"), t.raw("labels").where("doc_id % 3 = 0").select("doc_id", F.lit(1).alias("quality")), ["doc_id"], F.col("quality")), "select doc_id, case when doc_id % 3 = 0 then 1 else quality end as quality from labels")
q("G21_finalized_axis", lambda t: (lambda w: t.raw("embeddings").select("vec_id", "label", F.element_at("embedding", 2).cast("double").alias("v")).select("vec_id", F.round(F.when(F.max("v").over(w) == F.min("v").over(w), 0.5).otherwise((F.col("v") - F.min("v").over(w)) / F.nullif(F.max("v").over(w) - F.min("v").over(w), F.lit(0.0))), 6).alias("x")))(Window.partitionBy("label")),
  "select vec_id, round((v - min(v) over w) / nullif(max(v) over w - min(v) over w, 0), 6) as x from (select vec_id, label, cast(embedding[2] as double) as v from embeddings) window w as (partition by label)")
q("G28_reason_histogram", lambda t: t.rounds.select(F.explode(F.array_compact(F.array(F.when(F.col("amount_raised").isNull(), "no amount"), F.when(F.col("announced_date").isNull(), "no date"), F.when(F.col("round_type").isNull(), "no type")))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")), "select 'no amount' as reason, count(*) as n from rounds where amount_raised is null union all select 'no date', count(*) from rounds where announced_date is null union all select 'no type', count(*) from rounds where round_type is null")

# scalars
BACKED = "case id % 7 when 0 then name || ' Capital Partners' when 1 then ' ' || name || '  Ventures' when 2 then 'Andreessen Horowitz' when 3 then 'GV' when 4 then 'a16z Crypto Fund LP' when 5 then 'a number of strategic investors' else case id % 5 when 0 then 'Undisclosed' when 1 then 'n/a' when 2 then '--' when 3 then ' Investors ' else name end end"
KEYED = r"lower(trim(regexp_replace(trim({0}), '(?i)(\s+(capital|ventures?|partners?|management|group|fund|lp|llc)\b\.?)+$', '')))".format(BACKED)
q("T21_investor_key", lambda t: t.investors.select("id", B.investor_key(F.expr(BACKED)).alias("key")), f"select id, case k when 'andreessen horowitz' then 'a16z' when 'gv' then 'google' else k end as key from (select id, {KEYED} as k from investors)")
q("T22_junk_names", lambda t: t.investors.select("id", B.no_investor(F.expr(BACKED)).alias("junk")), f"select id, k in ('a number of strategic investors', 'undisclosed', 'n/a', '--', 'investors') as junk from (select id, {KEYED} as k from investors)")
q("T23_person_like", lambda t: t.raw("part").select("p_partkey", (lambda w: F.size(w).between(2, 3) & F.forall(w, lambda x: x.rlike(r"^[A-Za-z][A-Za-z.'\-]+$")))(F.split("p_name", " ")).alias("person")), r"select p_partkey, len(string_split(p_name, ' ')) between 2 and 3 and len(list_filter(string_split(p_name, ' '), lambda x: not regexp_matches(x, '^[A-Za-z][A-Za-z.''\-]+$'))) = 0 as person from part")
TAGGED = "case id % 5 when 0 then 'Dev Tools' when 1 then 'developer_tools' when 2 then '  ' when 3 then 'Quantum  Sensing' else 'web3' end"
ALIASES = {"dev tools": "devtools", "developer tools": "devtools", "web3": "crypto", "robots": "robotics"}
q("T25_tag_list", lambda t: t.companies.select("id", F.array_join(B.canonical_tags(F.array(F.expr(TAGGED), F.lit("devtools"), F.lit("Robots")), ALIASES), ",").alias("tags")), "select id, case id % 5 when 3 then 'quantum-sensing,devtools,robotics' when 4 then 'crypto,devtools,robotics' else 'devtools,robotics' end as tags from companies")
INDUSTRIES = {"building": "construction", "machinery": "industrial technology", "automobile": "mobility"}
q("T26_industry_map", lambda t: t.companies.select("id", B.canonical_label(F.col("industry_group"), INDUSTRIES).alias("industry")), "select id, case industry_group when 'BUILDING' then 'construction' when 'MACHINERY' then 'industrial technology' when 'AUTOMOBILE' then 'mobility' else industry_group end as industry from companies")
ENDED = "case c_custkey % 6 when 0 then 'co.uk' when 1 then 'shop.com.au' when 2 then 'de' when 3 then 'com' when 4 then 'x.co.jp' else 'io' end"
q("T28_country_suffix", lambda t: t.raw("customer").select("c_custkey", B.country_of(F.concat(F.lit("C"), "c_custkey", F.lit("."), F.expr(ENDED))).alias("country")), "select c_custkey, case c_custkey % 6 when 0 then 'GB' when 1 then 'AU' when 2 then 'DE' when 4 then 'JP' end as country from customer")
LINKED = "case page_id % 3 when 0 then '/about/team' when 1 then '/blog/about' else '/company' end"
q("T36_ranked_links", lambda t: t.raw("pages").select("page_id", F.explode(F.array(F.expr(LINKED), F.lit("/about"), F.lit("/team.pdf"), F.lit("/faq"))).alias("path")).withColumn("score", B.telling(F.col("path"), F.lit("Our product"))).where("score > 0").transform(lambda d: W.first_per(d, ["page_id"], [F.desc("score"), F.asc("path")], 2)).select("page_id", "path", "score"),
  "select page_id, path, score from (select *, row_number() over (partition by page_id order by score desc, path) as n from (select page_id, unnest(['/about', case page_id % 3 when 0 then '/about/team' when 2 then '/company' end, '/faq']) as path, cast(unnest([2, case page_id % 3 when 0 then 3 when 2 then 2 end, 1]) as int) as score from pages) where path is not null) where n <= 2")
STORY = "list_distinct(list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9.]+'), lambda w: w <> '' and w not in ({})), lambda w: case when w in ({}) then 'raise' else w end))".format(*(", ".join(f"'{w}'" for w in x) for x in (L.STOP, L.RAISE)))
q("T45_same_story", lambda t: (lambda b: b.alias("a").join(b.alias("b"), F.expr("a.first = b.first and a.item_id < b.item_id")).select(F.expr("a.item_id as item_id"), F.expr("b.item_id as other_id"), L.same_story(F.col("a.words"), F.col("b.words"), F.col("a.sums"), F.col("b.sums")).alias("same")))(t.raw("benchmark").select("item_id", F.lower(F.substring_index("text", " ", 1)).alias("first"), L.title_words(F.col("text")).alias("words"), L.title_sums(F.col("text")).alias("sums"))),
  f"with a as (select item_id, lower(split_part(text, ' ', 1)) as first, {STORY} as w from benchmark) select a.item_id, b.item_id as other_id, len(list_intersect(a.w, b.w)) >= 3 and len(list_intersect(a.w, b.w)) >= 0.6 * least(len(a.w), len(b.w)) as same from a join a b on a.first = b.first and a.item_id < b.item_id")
q("T52_numbered_slugs", lambda t: t.raw("part").select("p_partkey", N.slugify(F.col("p_name")).alias("base")).withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy("p_partkey"))).select("p_partkey", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), "n")).alias("slug")),
  "select p_partkey, case when n = 1 then base else base || '-' || n end as slug from (select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as base, row_number() over (partition by trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') order by p_partkey) as n from part)")
q("T56_feed_items", lambda t: t.rounds.join(t.companies.select(F.col("id").alias("company_id"), "name"), "company_id").select("id", F.concat("name", F.lit(" raised "), N.claim_usd(F.col("amount_raised")), F.coalesce(F.concat(F.lit(" ("), "round_type", F.lit(")")), F.lit(""))).alias("title")),
  "select r.id, name || ' raised ' || case when amount_raised is null then 'an undisclosed amount' when amount_raised >= 1000 then printf('$%.0fK', cast(amount_raised as double) / 1000) else printf('$%.0f', cast(amount_raised as double)) end || coalesce(' (' || round_type || ')', '') as title from rounds r join companies c on company_id = c.id")
q("D4_math", lambda t: t.rounds.where("amount_raised > 0").select("id", F.round(F.log10(F.col("amount_raised").cast("double")), 6).alias("lg"), F.round(F.sqrt(F.col("amount_raised").cast("double")), 6).alias("root"), F.least(F.greatest(F.col("id") % 7 - 3, F.lit(-1)), F.lit(2)).alias("clip")), "select id, round(log10(cast(amount_raised as double)), 6) as lg, round(sqrt(cast(amount_raised as double)), 6) as root, least(greatest(id % 7 - 3, -1), 2) as clip from rounds where amount_raised > 0")
q("D7_arrays", lambda t: t.companies.select("id", F.array_join(F.slice(F.array_distinct(F.array_append(F.array(F.col("id") % 2, F.col("id") % 3), F.col("id") % 5)), 1, 2).cast("array<string>"), "-").alias("a")), "select id, case when id % 2 <> id % 3 then id % 2 || '-' || id % 3 when id % 5 <> id % 2 then id % 2 || '-' || id % 5 else '' || id % 2 end as a from companies")
q("D8_map_lookup", lambda t: (lambda m: t.runs.select("id", F.coalesce(F.try_element_at(m, F.col("stage")), F.lit("Other")).alias("label")))(F.create_map(*[F.lit(x) for x in ("view", "Views", "click", "Clicks")])), "select id, case stage when 'view' then 'Views' when 'click' then 'Clicks' else 'Other' end as label from runs")
q("D10_conditionals", lambda t: t.competitors.select("company_id", "rank", F.greatest(F.lit(0.2), 1 / F.col("rank")).cast("double").alias("score")), "select company_id, rank, greatest(0.2, 1.0 / rank) as score from competitors")
q("X6_ledger_idempotent", lambda t: t.runs.unionByName(t.runs.where("id % 4 = 0")).dropDuplicates(["id"]).groupBy("stage").agg(F.count("*").alias("n")), "select stage, count(*) as n from runs group by 1")
q("E1_table_function", lambda t: V.nearest(t.raw("embeddings").where("vec_id <> 5"), t.raw("embeddings").where("vec_id = 5"), 4).select("vec_id"), "select e.vec_id from embeddings e, embeddings s where s.vec_id = 5 and e.vec_id <> 5 order by list_cosine_similarity(cast(e.embedding as double[]), cast(s.embedding as double[])) desc, 1 limit 4")

# worklists and lookups
q("Z1_unprocessed_news", lambda t: news(t).where("round_id is null").join(t.shown.select(F.col("id").alias("company_id")), "company_id", "left_semi").orderBy(F.desc("published_date"), "id").limit(100).select("id"), f"with {NEWS} select id from news where round_id is null and company_id in (select id from shown) order by published_date desc, id limit 100")
q("Z3_redescribe_worklist", lambda t: t.companies.where("description_short is not null and (prompt_version is null or prompt_version < 'v3')").orderBy(F.desc_nulls_last("total_raised_usd"), "id").limit(50).select("id"), "select id from companies where description_short is not null and (prompt_version is null or prompt_version < 'v3') order by total_raised_usd desc nulls last, id limit 50")
q("Z5_judgement_worklist", lambda t: t.companies.where("exclusion_reason is null and description_short is null").join(t.rounds.select(F.col("company_id").alias("id")), "id", "left_semi").select("id"), "select id from companies where exclusion_reason is null and description_short is null and id in (select company_id from rounds)")
q("Z6_evidence_source", lambda t: news(t).where(F.lower("title").contains("the ")).groupBy("company_id").agg(F.min_by("url", "id").alias("url")), f"with {NEWS} select company_id, arg_min(url, id) as url from news where contains(lower(title), 'the ') group by 1")
q("Z7_analysis_worklist", lambda t: t.shown.join(t.competitors.groupBy(F.col("company_id").alias("id")).agg(F.max("rank").alias("r")), "id", "left").where("r is null or r < 3").select("id"), "select s.id from shown s left join (select company_id, max(rank) as r from competitors group by 1) on company_id = s.id where r is null or r < 3")
q("Z8_fallback_worklist", lambda t: t.companies.where("description_short is null and website is null and exclusion_reason is null").select("id"), "select id from companies where description_short is null and website is null and exclusion_reason is null")
q("Z9_website_candidates", lambda t: t.companies.where("website is null").join(news(t).groupBy(F.col("company_id").alias("id")).agg(F.min("url").alias("candidate")), "id").select("id", "candidate"), f"with {NEWS} select c.id, min(url) as candidate from companies c join news n on n.company_id = c.id where website is null group by 1")
q("Z11_two_semi_joins", lambda t: t.companies.join(t.rounds.select(F.col("company_id").alias("id")), "id", "left_semi").join(t.competitors.where("rank = 3").select(F.col("company_id").alias("id")), "id", "left_semi").select("id"), "select id from companies where id in (select company_id from rounds) and id in (select company_id from competitors where rank = 3)")
q("Z19_staff_worklist", lambda t: t.companies.where("employee_count_min is null and (checked_at is null or checked_at < date '2001-06-01')").select("id"), "select id from companies where employee_count_min is null and (checked_at is null or checked_at < date '2001-06-01')")
q("H1_exact_name", lambda t: incoming(t).distinct().join(t.companies.select("id", "name"), "name").select("name", "id"), f"with {INCOMING} select distinct i.name, id from incoming i join companies c on i.name = c.name")
q("H3_casing_variant", lambda t: t.raw("part").select("p_partkey", ((F.initcap("p_name") != F.col("p_name")) & (F.col("p_name") == F.lower("p_name"))).alias("upgrade")), "select p_partkey, p_name = lower(p_name) as upgrade from part")
q("H4_confidence_rank", lambda t: t.rounds.select("id", (R.confidence_rank() > 0).alias("sure")), "select id, confidence in ('medium', 'high') as sure from rounds")
q("H6_exploded_links", lambda t: t.rounds.select("id", F.array(F.col("id") % 5).alias("lead"), F.array(F.col("id") % 5, F.col("id") % 7).alias("other")).select("id", F.explode(F.concat(F.transform("lead", lambda x: F.struct(x.alias("i"), F.lit(True).alias("l"))), F.transform("other", lambda x: F.struct(x.alias("i"), F.lit(False).alias("l"))))).alias("s")).groupBy("id", F.col("s.i").alias("investor")).agg(F.bool_or("s.l").alias("is_lead")),
  "select id, id % 5 as investor, true as is_lead from rounds union all select id, id % 7, false from rounds where id % 7 <> id % 5")
q("H10_newest_of_source", lambda t: news(t).where("source ilike 'SRC3'").orderBy(F.desc_nulls_last("published_date"), "id").limit(10).select("id"), f"with {NEWS} select id from news where source ilike 'SRC3' order by published_date desc nulls last, id limit 10")
q("H15_has_children", lambda t: t.companies.join(t.competitors.select(F.col("company_id").alias("id")).distinct().withColumn("has", F.lit(True)), "id", "left").select("id", F.coalesce("has", F.lit(False)).alias("has")), "select id, id in (select company_id from competitors) as has from companies")
q("H17_grouped_lookback", lambda t: t.rounds.where((F.col("announced_date") <= day()) & (F.col("announced_date") >= F.date_sub(day(), 70))).groupBy("company_id").agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list("announced_date"))), lambda d: d.cast("string")), ",").alias("days")), f"select company_id, string_agg(cast(announced_date as varchar), ',' order by announced_date desc) as days from rounds where announced_date <= {D} and announced_date >= {D} - 70 group by 1")
q("H18_mean_or_null", lambda t: t.rounds.groupBy("company_id").agg(F.round(F.avg(F.when(F.col("id") % 4 == 0, F.col("amount_raised").cast("double"))), 4).alias("mean")), "select company_id, round(avg(cast(amount_raised as double)) filter (id % 4 = 0), 4) as mean from rounds group by 1")
q("H20_member_rounds", lambda t: t.rounds.where("announced_date >= date '2001-01-01'").join(t.companies.where("industry_group = 'AUTOMOBILE'").select(F.col("id").alias("company_id")), "company_id", "left_semi").select("id"), "select id from rounds where announced_date >= date '2001-01-01' and company_id in (select id from companies where industry_group = 'AUTOMOBILE')")
SQUEEZED = r"concat_ws(' ', source, lang, trim(regexp_replace(text, '\s+', ' ', 'g')))"
q("H23_evidence", lambda t: t.raw("documents").select("doc_id", X.truncate_words(F.concat_ws(" ", "source", "lang", X.squeeze(F.col("text"))), 120).alias("evidence")),
  rf"select doc_id, case when length(e) <= 120 then e when regexp_replace(substring(e, 1, 120), '\s+\S*$', '') <> '' then regexp_replace(substring(e, 1, 120), '\s+\S*$', '') else substring(e, 1, 120) end as evidence from (select doc_id, {SQUEEZED} as e from documents)")
q("H25_ladder", lambda t: t.companies.select("id", F.when(F.col("description_short").isNull(), "null").when(F.col("website").isNull(), "ungrounded").when(F.col("status") == "acquired", "held").otherwise("accepted").alias("verdict")), "select id, case when description_short is null then 'null' when website is null then 'ungrounded' when status = 'acquired' then 'held' else 'accepted' end as verdict from companies")
q("H26_conditional_write", lambda t: t.companies.select("id", F.coalesce("description_short", F.concat(F.lit("New text of "), "name")).alias("description")), "select id, coalesce(description_short, 'New text of ' || name) as description from companies")
q("H30_normalizers", lambda t: t.companies.select("id", X.squeeze(F.concat(F.lit("  "), "hq_country", F.lit("  x "))).alias("squeezed"), F.when(F.upper(F.substring("hq_country", 1, 2)).rlike("^[A-Z]{2}$"), F.upper(F.substring("hq_country", 1, 2))).alias("code")), "select id, hq_country || ' x' as squeezed, substring(hq_country, 1, 2) as code from companies")
q("H32_ingest_rows", lambda t: news(t).dropDuplicates(["id"]).join(t.rounds.select(F.col("news_url").alias("url")), "url", "left_anti").select("id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), "url").alias("content")).select("id", F.length("content").alias("n")), f"with {NEWS} select id, cast(length(coalesce(nullif(trim(title), ''), url)) as int) as n from news where url not in (select news_url from rounds where news_url is not null)")
q("H34_first_line", lambda t: t.raw("documents").select("doc_id", F.filter(F.transform(F.split("text", "\n"), lambda s: F.btrim(s, F.lit(X.SPACES))), lambda s: s != "").alias("lines")).select("doc_id", F.try_element_at("lines", F.lit(1)).alias("line")).select("doc_id", F.length("line").alias("n")), "select doc_id, cast(length(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '')[1]) as int) as n from documents")
q("H39_phantom_rows", lambda t: t.rounds.where("amount_raised is null and valuation is not null and announced_date is null").select("id"), "select id from rounds where amount_raised is null and valuation is not null and announced_date is null")
q("H40_alias_names", lambda t: t.companies.select("id", F.initcap(F.regexp_replace(F.regexp_replace(N.disambiguated(F.col("slug"), F.col("id")), "-[0-9a-f]{6}$", ""), "-", " ")).alias("alias")), "select id, 'Co ' || id as alias from companies")
q("H43_bucket_tally", lambda t: t.rounds.groupBy("confidence", F.col("news_url").isNotNull().alias("has_url")).agg(F.count("*").alias("n")), "select confidence, news_url is not null as has_url, count(*) as n from rounds group by 1, 2")
q("H47_headcount_regex", lambda t: t.raw("customer").select("c_custkey", F.concat(F.lit("<b>Team</b> "), F.col("c_custkey") % 300, F.lit(" employees")).alias("h")).select("c_custkey", N.employee_range(F.col("h"))["low"].alias("low")), "select c_custkey, cast(c_custkey % 300 as int) as low from customer")
q("H50_star_counts", lambda t: t.raw("orders").select("o_orderkey", F.format_number(F.floor("o_totalprice"), 0).alias("s")).select("o_orderkey", F.expr("try_cast(replace(s, ',', '') as int)").alias("stars")), "select o_orderkey, cast(floor(o_totalprice) as int) as stars from orders")
q("H52_leading_segment", lambda t: t.raw("pages").select("page_id", F.trim(F.element_at(F.split(F.regexp_extract("html", "<title>([^<]*)</title>", 1), r" [|–—-] "), 1)).alias("lead")), r"select page_id, trim(regexp_split_to_array(regexp_extract(html, '<title>([^<]*)</title>', 1), ' [|–—-] ')[1]) as lead from pages")
q("H55_keys", lambda t: t.raw("part").select("p_partkey", F.trim(F.regexp_replace(F.lower("p_type"), r"[\s\-_/]+", " ")).alias("key")), r"select p_partkey, trim(regexp_replace(lower(p_type), '[\s\-_/]+', ' ', 'g')) as key from part")
q("H56_prominent", lambda t: t.rounds.groupBy("company_id").agg((F.max("amount_raised") >= 400000).alias("prominent")), "select company_id, max(amount_raised) >= 400000 as prominent from rounds group by 1")
q("H60_proper_nouns", lambda t: t.raw("benchmark").select("item_id", F.size(X.capitalised(F.col("text"))).alias("n")), f"select item_id, cast(len({CAPS.format('text')}) as int) as n from benchmark")
q("H62_radius", lambda t: t.companies.select("id", F.round(F.least(4 + F.sqrt(F.greatest(F.coalesce(F.col("total_raised_usd").cast("double"), F.lit(0.0)), F.lit(0.0)) / 1000), F.lit(24.0)), 6).alias("radius")), "select id, round(least(4 + sqrt(greatest(coalesce(cast(total_raised_usd as double), 0), 0) / 1000), 24), 6) as radius from companies")
q("H63_date_seed", lambda t: t.rounds.where("announced_date is not null").select("id", (F.year("announced_date") * 10000 + F.month("announced_date") * 100 + F.dayofmonth("announced_date")).alias("seed")), "select id, cast(strftime(announced_date, '%Y%m%d') as int) as seed from rounds where announced_date is not null")
q("H64_latest_activity", lambda t: t.runs.where("status <> 'error'").agg(F.max("started_at").alias("at")), "select max(started_at) as at from runs where status <> 'error'")
q("H65_verification_keys", lambda t: t.rounds.select(F.concat_ws(":", F.lit("round"), "company_id", F.coalesce("round_type", F.lit("none"))).alias("key")).distinct(), "select distinct concat_ws(':', 'round', company_id, coalesce(round_type, 'none')) as key from rounds")
q("H67_compare_set", lambda t: t.companies.select("id", F.array_join(F.slice(F.array_distinct(F.array("slug", F.lit("co-1"), F.lit("co-2"), F.lit("co-1"), F.lit("co-3"))), 1, 4), ",").alias("picked")), "select id, array_to_string(list_filter([slug, 'co-1', 'co-2', 'co-3'], lambda x, i: i = 1 or x <> slug)[1:4], ',') as picked from companies")
q("T14_dominant_subject", lambda t: t.companies.select("id", S.dominant_subject(F.expr("case id % 5 when 0 then concat(name, ' — tagline') when 1 then concat('Other | ', name) when 2 then concat('Polymarket, ', name) when 3 then concat('Welcome to ', name) else name end"), F.col("name")).alias("subject")), "select id, id % 5 in (0, 3, 4) as subject from companies")
q("T15_subject_mismatch", lambda t: t.companies.select("id", S.subject_mismatch(F.expr("case id % 3 when 0 then 'Series V provides capital.' when 1 then concat(name, ' is a maker.') else 'We help teams.' end"), F.col("name")).alias("mismatch")), "select id, id % 3 = 0 as mismatch from companies")
q("T16_article_mentions", lambda t: t.companies.select("id", S.mentions(F.expr("case id % 4 when 0 then 'Away' when 1 then 'Acme Robot Works' when 2 then 'Acme' else 'Clear' end"), F.expr("case id % 4 when 0 then 'Away from China they need funding' when 1 then 'Robots everywhere' when 2 then 'Acme raises cash' else 'Travel startup Clear hires' end"), F.lit("Acme Robot Works said")).alias("about")), "select id, id % 4 <> 0 as about from companies")
