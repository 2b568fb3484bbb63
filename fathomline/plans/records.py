"""Sources read from landed pages, entity checks, worklists and drivers over the bound tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomline.functions import names as N
from fathomline.functions import places as L
from fathomline.functions import subjects as S
from fathomline.functions import text as X
from fathomline.functions import urls as U
from fathomline.operators import clusters as C
from fathomline.operators import corroborate as K
from fathomline.operators import resolve as M
from fathomline.operators import scorecard as R
from fathomline.operators import similarity as V
from fathomline.operators import windows as W
from fathomline.plans.aggregates import D
from fathomline.plans.registry import q
from fathomline.plans.relational import NEWS, news
from fathomline.plans.scores import centroids
from fathomline.sources import feeds as E
from fathomline.sources import pages as P


# portfolio pages, a page for each twenty parts
def card_pages(t, card, joint=""):
    rows = t.raw("part").select(F.floor(F.col("p_partkey") / 20).alias("page"), card.alias("card"))
    return rows.groupBy("page").agg(F.array_join(F.array_sort(F.collect_list("card")), joint).alias("html"))


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("$") else F.col(p[1:]).cast("string") for p in parts])


PART_NAMES = "select distinct p_name as name from part"
q("S15_portfolio_cards", lambda t: E.nonempty(E.read_cards(card_pages(t, text('<div class="card"><a href="/p/', "$p_partkey", '">', "$p_name", "</a></div>")), "html", "card"), "cards").select("name"), PART_NAMES)
q("S16_nonempty_source", lambda t: E.nonempty(t.raw("part").select(F.col("p_name").alias("name")).distinct(), "parts"), PART_NAMES)
q("S19_pushed_chunks", lambda t: E.islands(t.raw("events").select("event_id", F.concat(F.lit("self.next.push("), F.to_json(F.array(F.lit("1"), "props")), F.lit(");x()")).alias("html")), "html", "push(", "array<string>").select("event_id", F.get_json_object(F.get("island", F.lit(1)), "$.k").cast("int").alias("k")),
  "select event_id, cast(json_extract(props, '$.k') as int) as k from events")
q("S20_script_objects", lambda t: E.islands(t.raw("part").select("p_partkey", F.concat(F.lit("<script>window.team = "), F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"))), F.lit("; run({</script>")).alias("html")), "html", "team", "name string, size int").select("p_partkey", "island.name", "island.size"),
  "select p_partkey, p_name as name, p_size as size from part")
q("S21_logo_names", lambda t: card_pages(t, text('<img src="/l.png" alt="', "$p_name", ' logo in grey">')).select(F.explode(F.regexp_extract_all("html", F.lit('alt="([^"]*)"'), F.lit(1))).alias("alt")).select(F.regexp_replace("alt", r"(?i)\s+logo\b.*$", "").alias("name")).distinct(), PART_NAMES)
q("S23_listing_without_aggregators", lambda t: t.raw("part").select(F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("https://www.linkedin.com/"), "p_partkey")).otherwise(F.concat(F.lit("https://c"), "p_partkey", F.lit(".com/"))).alias("website")).select("name", F.when(~U.on_host(U.hostname(F.col("website")), U.AGGREGATORS), F.col("website")).alias("website")).groupBy("name").agg(F.min("website").alias("website")),
  "select p_name as name, min(case when p_partkey % 4 <> 0 then 'https://c' || p_partkey || '.com/' end) as website from part group by 1")
def repo_card():
    return text('<article class="Box-row"><h2><a href="/', "$owner", "/repo-", "$p_partkey", '">x</a></h2><p> About  ', "$p_type", '</p><span itemprop="programmingLanguage">', "$p_brand", '</span><a href="/', "$owner", "/repo-", "$p_partkey", '/stargazers"><svg/> ', "$stars", " </a></article>")



def repo_pages(t):
    rows = t.raw("part").withColumn("owner", F.when(F.col("p_partkey") % 9 == 0, "a/b").otherwise(F.regexp_replace("p_brand", "#", "-"))).withColumn("stars", F.format_number(F.col("p_size") * 100, 0))
    return rows.groupBy(F.floor(F.col("p_partkey") / 20).alias("page")).agg(F.array_join(F.collect_list(repo_card()), "").alias("html"))


REPOS = "select replace(p_brand, '#', '-') as owner, 'repo-' || p_partkey as repo, 'About ' || p_type as description, p_brand as language, cast(p_size * 100 as int) as stars from part where p_partkey % 9 <> 0"
q("S26_trending_repos", lambda t: P.trending_repos(repo_pages(t)), REPOS)
q("Z13_new_companies", lambda t: P.trending_repos(repo_pages(t)).groupBy("owner").agg(F.max("stars").alias("stars")).join(t.raw("part").where("p_size > 48").select(F.regexp_replace("p_brand", "#", "-").alias("owner")), "owner", "left_anti"),
  f"select owner, max(stars) as stars from ({REPOS}) where owner not in (select replace(p_brand, '#', '-') from part where p_size > 48) group by 1")


def entity_docs(t):
    """Customers as entity documents: some absent, some without claims, some not JSON."""
    one = lambda value, kind: F.array(F.struct(F.struct(F.struct(value.cast(kind).alias("value")).alias("datavalue")).alias("mainsnak")))
    item = lambda name: F.array(*[F.struct(F.struct(F.struct(F.struct(v.alias("id")).alias("value")).alias("datavalue")).alias("mainsnak")) for v in name])
    c = F.col("c_custkey")
    time = F.array(*[F.struct(F.struct(F.struct(F.struct(F.concat(F.lit("+"), F.lit(y) + c % 9, F.lit("-00-00T00:00:00Z")).alias("time")).alias("value")).alias("datavalue")).alias("mainsnak")) for y in (2001, 1990)])
    claims = F.struct(item([F.lit("Q1"), F.lit("Q1")]).alias("P31"), item([F.concat(F.lit("Q"), c % 4)]).alias("P17"), item([F.concat(F.lit("Q9"), c % 3), F.lit("Q90")]).alias("P159"), time.alias("P571"),
                      F.when(c % 5 == 0, one(F.lit("ftp://no"), "string")).otherwise(one(F.concat(F.lit("https://www.C"), c, F.lit(".com/a?b")), "string")).alias("P856"))
    doc = F.to_json(F.struct(F.struct(F.struct(F.col("c_name").alias("value")).alias("en")).alias("labels"), F.when(c % 7 != 0, claims).alias("claims")))
    return t.raw("customer").select(c.alias("id"), "c_name", F.when(c % 11 == 0, '{"missing": ""}').when(c % 13 == 0, "{broken").otherwise(doc).alias("json"))


HELD = "id % 11 <> 0 and id % 13 <> 0"
q("S28_entity_facts", lambda t: P.entity_claims(entity_docs(t)).where(~F.col("absent") & (N.normalize_name(F.col("label")) == N.normalize_name(F.col("c_name")))).select("id", "inception", F.array_join("places", ",").alias("places"), P.usable_site(F.col("sites")).alias("site")),
  f"select id, cast(case when id % 7 <> 0 then 1990 + id % 9 end as int) as inception, case when id % 7 = 0 then '' when id % 3 = 0 then 'Q90' else 'Q9' || id % 3 || ',Q90' end as places, case when id % 7 <> 0 and id % 5 <> 0 then 'https://www.C' || id || '.com/' end as site from (select c_custkey as id from customer) where {HELD}")
q("H51_claims", lambda t: P.entity_claims(entity_docs(t)).where("not absent").select("id", F.array_join("kinds", ",").alias("kinds"), F.array_join("countries", ",").alias("countries"), F.size("sites").alias("sites")),
  "select id, case when id % 7 = 0 or id % 13 = 0 then '' else 'Q1' end as kinds, case when id % 7 = 0 or id % 13 = 0 then '' else 'Q' || id % 4 end as countries, cast(case when id % 7 = 0 or id % 13 = 0 then 0 else 1 end as int) as sites from (select c_custkey as id from customer) where id % 11 <> 0")
ICONS = """concat('<head><link rel="stylesheet" href="/x.css">', case page_id % 4 when 0 then '<link rel="icon" sizes="32x32" href="a.png"><link rel="Shortcut Icon" sizes="16x16 64x64" href="/b.png">' when 1 then '<link rel="icon" sizes="512x512" href="/big.png"><link rel="apple-touch-icon" href="//cdn.example.com/t.png">' when 2 then '<link rel="icon" href="data:image/png;base64,AA">' else '' end, '</head>')"""
q("S31_best_logo", lambda t: t.raw("pages").select("page_id", P.best_logo(F.expr(ICONS), F.concat(F.lit("https://Site.example.com/p/"), "page_id")).alias("logo")),
  "select page_id, case page_id % 4 when 0 then 'https://site.example.com/b.png' when 1 then 'https://cdn.example.com/t.png' else 'https://site.example.com/favicon.ico' end as logo from pages")
q("H54_meta_signals", lambda t: t.raw("pages").select("page_id", F.concat(F.lit('<meta content="A page" name="description"><meta property="og:title" content="'), F.lit("Own title"), F.lit('"><meta name="twitter:description" content="A page">'), "html").alias("h")).select("page_id", F.array_join(P.meta_signals(F.col("h")), "|").alias("signals")),
  r"select page_id, array_to_string(list_filter([trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')), 'A page', 'Own title'], lambda x: x <> ''), '|') as signals from pages")
q("H49_strong_position", lambda t: t.raw("pages").select("page_id", F.exists(F.concat(P.inner(F.col("html"), "title"), P.inner(F.col("html"), "h1")), lambda x: S.dominant_subject(x, F.lit("Example"))).alias("strong")))

# who articles are about
VARIANT_COMMON = ", ".join(f"'{w}'" for w in S.COMMON)
q("H53_name_variants", lambda t: t.raw("part").select("p_partkey", F.array_join(K.name_variants(F.col("p_name")), "|").alias("variants")),
  f"select p_partkey, array_to_string(list_filter([p_name, case when n > 1 then array_to_string(w, '') end, case when n > 1 and length(w[1]) >= 4 and w[1] not in ({VARIANT_COMMON}) then w[1] end], lambda x: x is not null), '|') as variants from (select p_partkey, p_name, string_split(lower(p_name), ' ') as w, len(string_split(lower(p_name), ' ')) as n from part)")
ENTITY = "initcap(split_part(text, ' ', 2))"


def told(t):
    """Articles with the name of an entity that the text may or may not be about: the second word of the text before it."""
    d = t.raw("documents").select("doc_id", "text", "source")
    named = d.select((F.col("doc_id") + 1).alias("doc_id"), F.expr(ENTITY).alias("name"), F.substring_index("text", ". ", 2).alias("description"))
    return d.join(named, "doc_id")


q("T17_corroborated", lambda t: K.best_corroboration(told(t), ["doc_id"]).select("doc_id", "occurrences", "proper", "overlap", "suspect", F.array_join("reasons", ",").alias("reasons")))
q("T18_attributed", lambda t: told(t).select("doc_id", K.attributed(F.col("name"), F.array(F.lit("Series A")), F.substring_index("text", ". ", 1), F.lit("https://a.example.com/x"), F.col("text")).alias("mine")))
q("G28_entity_audit", lambda t: (lambda audit: audit.select(F.explode(F.when(~F.col("read"), F.array(F.lit("unknown"))).when(F.col("suspect"), F.col("reasons")).otherwise(F.array(F.lit("clear")))).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n")))(K.best_corroboration(told(t), ["doc_id"])))
q("H24_surviving_articles", lambda t: W.first_per(K.best_corroboration(told(t), ["doc_id"]).where("not suspect"), ["source"], [F.desc("doc_id")], 6).select("source", "doc_id"))
q("Z20_entity_guard", lambda t: K.best_corroboration(told(t), ["doc_id"]).select("doc_id", F.when(~F.col("suspect"), "keep").when(F.col("proper") >= 2, "ask").otherwise("drop").alias("verdict")))
q("H48_common_word_in_context", lambda t: t.companies.select("id", F.expr("case id % 5 when 0 then 'Take funding away from schools' when 1 then 'Away raises more' when 2 then 'travel startup Away opens' when 3 then 'Away, the luggage brand' else 'Away''s Series D' end").alias("title")).select("id", S._meant(F.lit("away"), X.tokens(F.col("title"))).alias("meant")),
  "select id, id % 5 <> 0 as meant from companies")

# look-ups and guards
q("H2_slug_taken", lambda t: t.raw("part").select("p_partkey", N.slugify(F.col("p_name")).alias("slug")).join(t.raw("part").where("p_size > 25").select(N.slugify(F.col("p_name")).alias("slug")).distinct().withColumn("taken", F.lit(True)), "slug", "left").select("p_partkey", F.coalesce("taken", F.lit(False)).alias("taken")),
  "select p_partkey, p_name in (select p_name from part where p_size > 25) as taken from part")
q("H5_recordable_aliases", lambda t: t.competitors.where("competitor_company_id is not null").select(F.concat(F.lit("co-"), "competitor_company_id").alias("alias"), F.concat(F.lit("co-"), "company_id").alias("slug")).where("alias <> slug").join(t.companies.select(F.col("slug").alias("alias")), "alias", "left_anti").distinct(),
  "select distinct 'co-' || competitor_company_id as alias, 'co-' || company_id as slug from competitors where competitor_company_id is not null and competitor_company_id not in (select id from companies)")
q("H8_publisher_url", lambda t: news(t).select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://news.google.com/rss/articles/"), "id")).otherwise(F.col("url")).alias("u"), "url").select("id", F.when(U.hostname(F.col("u")) == K.NEWS_HOST, F.when(F.col("id") % 2 == 0, F.col("url"))).otherwise(F.col("u")).alias("source")),
  f"with {NEWS} select id, case when id % 3 <> 0 or id % 2 = 0 then url end as source from news")
q("H9_unambiguous_names", lambda t: t.raw("part").groupBy(F.lower("p_name").alias("name")).agg(F.when(F.count("*") == 1, F.min("p_partkey")).alias("id")), "select lower(p_name) as name, case when count(*) = 1 then min(p_partkey) end as id from part group by 1")
q("H11_replaced_competitors", lambda t: M.replace_children(t.competitors.select("company_id", "rank", "competitor_company_id"), t.competitors.where("company_id % 3 = 0 and competitor_company_id is not null").withColumn("rank", F.row_number().over(Window.partitionBy("company_id").orderBy("competitor_company_id"))).select("company_id", "rank", "competitor_company_id"), "company_id"),
  "with n as (select company_id, row_number() over (partition by company_id order by competitor_company_id) as rank, competitor_company_id from competitors where company_id % 3 = 0 and competitor_company_id is not null) select company_id, rank, competitor_company_id from competitors where company_id not in (select company_id from n) union all select * from n")
q("H19_cohort_order", lambda t: t.raw("embeddings").select("label", "vec_id", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("place")), "select label, vec_id, row_number() over (partition by label order by vec_id) as place from embeddings")
q("H21_unit_length", lambda t: t.raw("embeddings").select("vec_id", F.round(V.norm(V.unit("embedding")), 6).alias("length")), "select vec_id, case when list_dot_product(cast(embedding as double[]), cast(embedding as double[])) > 0 then 1.0 else 0.0 end as length from embeddings")
q("H27_stale_hashes", lambda t: t.companies.select("id", F.sha2(F.concat_ws("\n", "name", F.coalesce("description_short", F.lit(""))), 256).alias("now"), F.when(F.col("id") % 6 != 0, F.sha2(F.concat(F.col("name"), F.lit("\n"), F.when(F.col("id") % 4 == 0, "old").otherwise(F.coalesce("description_short", F.lit("")))), 256)).alias("stored")).where("stored is null or stored <> now").select("id"),
  "select id from companies where id % 6 = 0 or (id % 4 = 0 and coalesce(description_short, '') <> 'old')")
q("H28_roster", lambda t: t.competitors.groupBy("company_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "competitor_name"))), lambda s: s["competitor_name"]), "; ").alias("roster")), "select company_id, string_agg(competitor_name, '; ' order by rank, competitor_name) as roster from competitors group by 1")
q("H29_replaced_edges", lambda t: M.replace_children(t.company_links.select("company_id", "investor_id"), t.links.where("is_lead").join(t.rounds.select(F.col("id").alias("round_id"), "company_id"), "round_id").select("company_id", "investor_id").distinct(), "company_id"),
  "with n as (select distinct company_id, investor_id from links join rounds r on round_id = r.id where is_lead) select company_id, investor_id from company_links where company_id not in (select company_id from n) union all select * from n")
q("H31_country_judged", lambda t: t.companies.select("id", F.when(F.col("id") % 4 != 0, F.col("hq_country")).alias("hq"), F.expr("case id % 3 when 0 then 'low' when 1 then 'medium' else 'high' end").alias("sure")).select("id", F.coalesce("hq", F.when(F.col("sure") != "low", "Elsewhere")).alias("hq_country")),
  "select id, case when id % 4 <> 0 then hq_country when id % 3 <> 0 then 'Elsewhere' end as hq_country from companies")
q("H33_discovered_via", lambda t: t.raw("pages").select("page_id", (lambda h: F.when(h.endswith("example.org"), "example_org").when(h.endswith("example.net"), "example_net").otherwise("search"))(U.hostname(F.col("url"))).alias("via")),
  "select page_id, case when regexp_matches(url, '//[^/:?#]*example[.]org([/:?#]|$)') then 'example_org' when regexp_matches(url, '//[^/:?#]*example[.]net([/:?#]|$)') then 'example_net' else 'search' end as via from pages")
STATE = "case id % 6 when 0 then 'texas' when 1 then ' California ' when 2 then 'ny' when 3 then 'Bavaria' when 4 then 'New York' end"
STATED = "case id % 6 when 0 then 'TX' when 1 then 'CA' when 2 then 'NY' when 3 then 'Bavaria' when 4 then 'NY' end"
q("H35_normalized_states", lambda t: (lambda rows: rows.join(rows.where("state is not null").select("state").distinct().withColumn("now", L.state_code(F.col("state"))).where("now <> state"), "state").select("id", "now"))(t.companies.select("id", F.expr(STATE).alias("state"))), f"select id, {STATED} as now from companies where id % 6 not in (3, 5)")
q("H66_state_codes", lambda t: t.companies.select("id", L.state_code(F.expr(STATE)).alias("code")), f"select id, {STATED} as code from companies")
q("T27_every_state", lambda t: t.spark.createDataFrame(sorted(L.STATES.items()), "name string, code string").join(t.companies.select("id"), F.col("id") % 51 == F.length("name"), "inner").select("id", "name", L.state_code(F.initcap("name")).alias("code")),
  "with s(name, code) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in sorted(L.STATES.items())) + ") select c.id, s.name, code from s join companies c on c.id % 51 = length(s.name)")
q("H36_refetch_worklist", lambda t: t.raw("documents").where("length(text) < 800").select("doc_id", F.concat(F.lit("https://"), "source", F.lit(".com/"), "doc_id").alias("url")).where(~U.on_host(U.hostname(F.col("url")), U.AGGREGATORS)).orderBy("doc_id").limit(60).select("doc_id"), "select doc_id from documents where length(text) < 800 order by doc_id limit 60")
q("H37_renamed", lambda t: t.companies.join(t.rounds.select(F.col("company_id").alias("id")).distinct().withColumn("funded", F.lit(True)), "id", "left").select("id", F.when(F.coalesce("funded", F.lit(False)) & F.col("name").endswith("7"), F.concat("name", F.lit(" Group"))).otherwise(F.col("name")).alias("name")),
  "select id, case when name like '%7' and id in (select company_id from rounds) then name || ' Group' else name end as name from companies")


# drivers
def wrong_sites(t):
    return t.companies.where(F.col("website").rlike(r"//www\.c6\d\.")).select("id")


WRONG = r"wrong as (select id from companies where regexp_matches(website, '//www\.c6\d\.'))"
q("H41_reset_companies", lambda t: t.companies.join(wrong_sites(t).withColumn("wrong", F.lit(True)), "id", "left").select("id", *[F.when(F.col("wrong").isNull(), F.col(c)).alias(c) for c in ("website", "description_short", "logo_url")]),
  f"with {WRONG} select id, case when id not in (select id from wrong) then website end as website, case when id not in (select id from wrong) then description_short end as description_short, case when id not in (select id from wrong) then logo_url end as logo_url from companies")
q("H41_reset_children", lambda t: t.competitors.join(wrong_sites(t).withColumnRenamed("id", "company_id"), "company_id", "left_anti").select("company_id", "rank"), f"with {WRONG} select company_id, rank from competitors where company_id not in (select id from wrong)")
q("H42_site_candidates", lambda t: (lambda c: c.join(t.companies.where("website is null").select(F.col("id").alias("company_id")), "company_id", "left_semi").where(~U.on_host(U.hostname(F.col("u")), U.AGGREGATORS) & ~F.coalesce(U.dated_article(F.col("u")), F.lit(False))).groupBy("company_id").agg(F.min("u").alias("candidate"), F.countDistinct("u").alias("n")).where("n = 1").select("company_id", "candidate"))(
    news(t).select("company_id", F.expr("case id % 4 when 0 then 'https://www.linkedin.com/x' when 1 then 'https://a.example.com/2020/01/x' else concat('https://site', company_id, '.com/') end").alias("u"))),
  f"with {NEWS} select company_id, 'https://site' || company_id || '.com/' as candidate from news where id % 4 in (2, 3) and company_id in (select id from companies where website is null) group by 1")
q("H44_floor_breaches", lambda t: t.runs.groupBy("stage").agg(F.count("*").alias("n")).withColumn("floor", F.coalesce(F.try_element_at(F.create_map(F.lit("click"), F.lit(1_000_000), F.lit("error"), F.lit(2)), F.col("stage")), F.lit(1))).where("n < floor").select("stage", "n"),
  "select stage, count(*) as n from runs group by 1 having count(*) < case stage when 'click' then 1000000 when 'error' then 2 else 1 end")
q("H45_health_notes", lambda t: t.runs.groupBy("stage").agg(F.count_if(F.col("status") == "error").alias("errors"), F.count("*").alias("n"), F.max_by("status", F.struct("started_at", "id")).alias("last")).select("stage", F.when(F.col("last") == "error", "failing").when(F.col("errors") * 20 > F.col("n"), "shaky").otherwise("ok").alias("note")),
  "select stage, case when arg_max(status, struct_pack(a := started_at, b := id)) = 'error' then 'failing' when count(*) filter (status = 'error') * 20 > count(*) then 'shaky' else 'ok' end as note from runs group by 1")
q("H46_yield_lines", lambda t: t.runs.groupBy("stage").agg(F.count_if(F.col("status") == "success").alias("ok"), F.count("*").alias("n")).select(F.concat(F.lit("| "), "stage", F.lit(" | "), "ok", F.lit(" | "), "n", F.lit(" |")).alias("line")),
  "select '| ' || stage || ' | ' || count(*) filter (status = 'success') || ' | ' || count(*) || ' |' as line from runs group by stage")
q("Z12_unverified_rounds", lambda t: t.rounds.where("news_url is not null and amount_raised is not null").join(t.rounds.where("confidence = 'high' and id % 4 <> 3").select("id"), "id", "left_anti").orderBy(F.desc("amount_raised"), "id").limit(100).select("id"),
  "select id from rounds where news_url is not null and amount_raised is not null and not (confidence = 'high' and id % 4 <> 3) order by amount_raised desc, id limit 100")
q("Z15_ingested", lambda t: (lambda fresh: W.first_per(fresh.join(t.rounds.select(F.col("news_url").alias("url")).distinct(), "url", "left_anti"), ["url"], [F.asc("id")]).select("url", "id"))(news(t).where(F.col("published_date") >= F.date_sub(F.lit("2001-08-01").cast("date"), 120))),
  f"with {NEWS} select url, min(id) as id from news where published_date >= {D} - 120 and url not in (select news_url from rounds where news_url is not null) group by 1")
q("Z18_re_resolved", lambda t: t.companies.where("slug = 'co-8'").select("slug", F.lit(None).cast("string").alias("website"), F.lit(None).cast("date").alias("checked_at")), "select slug, cast(null as varchar) as website, cast(null as date) as checked_at from companies where slug = 'co-8'")
q("E2_empty_on_error", lambda t: E.or_empty(lambda: t.raw("no_such_table"), "vec_id long, score double").unionByName(E.or_empty(lambda: V.nearest(t.raw("embeddings"), t.raw("embeddings").where("vec_id = 2"), 3).select("vec_id", F.round("score", 6).alias("score")), "vec_id long, score double")),
  "select e.vec_id, round(list_cosine_similarity(cast(e.embedding as double[]), cast(s.embedding as double[])), 6) as score from embeddings e, embeddings s where s.vec_id = 2 order by list_cosine_similarity(cast(e.embedding as double[]), cast(s.embedding as double[])) desc, 1 limit 3")
q("S39_outside_records", lambda t: E.external(t.companies.select("id", "name"), lambda rows: [{"id": r["id"], "label": r["name"].lower()} for r in rows], "id long, label string"), "select id, lower(name) as label from companies")
q("S40_outside_vectors", lambda t: E.external(t.companies.select("id", "name"), lambda rows: [{"id": r["id"], "vector": [float(len(r["name"])), float(r["id"] % 7)]} for r in rows], "id long, vector array<double>").select("id", F.assert_true(F.size("vector") == 2, "two numbers").isNull().alias("checked"), F.get("vector", F.lit(0)).alias("x"), F.get("vector", F.lit(1)).alias("y")),
  "select id, true as checked, cast(length(name) as double) as x, cast(id % 7 as double) as y from companies")


def theme_pairs(t):
    """This week's cluster centroids against last week's, which knew only even rows."""
    class Earlier:
        def raw(self, name):
            return t.raw(name).where("vec_id % 2 = 0") if name == "embeddings" else t.raw(name)

    now, before = centroids(t), centroids(Earlier())
    return now.select(F.col("label").alias("cluster"), "centroid").crossJoin(F.broadcast(before.select(F.col("label").alias("theme"), F.col("centroid").alias("old")))).select("cluster", "theme", V.cosine("centroid", "old").alias("similarity"))


q("G18_matched_themes", lambda t: C.matched(theme_pairs(t), "cluster", "theme", "similarity", 0.3).select("cluster", "theme"))
q("G19_replaced_themes", lambda t: (lambda m: t.raw("embeddings").select(F.col("label").alias("cluster")).distinct().join(m, "cluster", "left").select("cluster", F.coalesce(F.concat(F.lit("theme-"), "theme"), F.concat(F.lit("new-"), "cluster")).alias("theme_slug")))(C.matched(theme_pairs(t), "cluster", "theme", "similarity", 0.3).select("cluster", "theme")))
q("L11_shuffled_pool", lambda t: t.shown.orderBy(F.desc_nulls_last("total_raised_usd"), "id").limit(10).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.coalesce("total_raised_usd", F.lit(0))).alias("o"), "id"))), lambda s: s["id"]).alias("pool")).select(F.posexplode(X.seeded_shuffle(F.col("pool"), 20010801)).alias("place", "id")))


# recorded answers against expected ones
def cases(t):
    return t.companies.select("id", F.col("industry_group").alias("want_industry"), F.col("hq_country").alias("want_country"), F.expr("case when id % 4 = 0 then null when id % 9 = 0 then 'OTHER' else industry_group end").alias("got_industry"), F.expr("case when id % 5 = 0 then upper(hq_country) || 'X' else hq_country end").alias("got_country"))


CASES = "k as (select industry_group as a, hq_country as b, case when id % 4 = 0 then null when id % 9 = 0 then 'OTHER' else industry_group end as c, case when id % 5 = 0 then upper(hq_country) || 'X' else hq_country end as d from companies), y as (select count(*) filter (a = c) + count(*) filter (b = d) as hits, count(c) + count(d) as given, count(a) + count(b) as wanted from k)"
q("H57_slot_scores", lambda t: R.slot_scores(cases(t), ["industry", "country"]).select("hits", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1")),
  f"with {CASES} select hits, round(hits / given, 6) as precision, round(hits / wanted, 6) as recall, round(2.0 * hits / (given + wanted), 6) as f1 from y")
q("H58_structure_checks", lambda t: t.companies.select("id", R.structure_ok(F.col("description_short"), 20, 24).alias("ok")), "select id, coalesce(length(description_short) between 20 and 24 and regexp_matches(description_short, '[.!?0-9]$'), false) as ok from companies")
q("H59_loaded_cases", lambda t: R.load_cases(t.companies.select(F.when(F.col("id") % 6 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("id").alias("case_id"), F.when(F.col("id") % 2 == 0, "live").otherwise("hand").alias("provenance"), F.when(F.col("id") % 5 != 0, F.struct("name")).alias("recorded")))).alias("value")), "name string").groupBy("provenance").agg(F.count("*").alias("n"), F.count_if("parsed").alias("parsed")),
  "select case when id % 2 = 0 then 'live' else 'hand' end as provenance, count(*) as n, count(*) filter (id % 5 <> 0) as parsed from companies where id % 6 <> 0 group by 1")
q("E4_gated_scores", lambda t: R.gate(cases(t), R.Spec("description", ("industry", "country"), {"precision": 0.7, "recall": 0.99})).select("spec", "metric", F.round("value", 6).alias("value"), "floor", "ok"),
  f"with {CASES} select 'description' as spec, 'precision' as metric, round(hits / given, 6) as value, 0.7::double as floor, hits / given >= 0.7 as ok from y union all select 'description', 'recall', round(hits / wanted, 6), 0.99::double, hits / wanted >= 0.99 from y")
