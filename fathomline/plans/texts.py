"""Scalar functions over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions import labels as B
from fathomline.functions import names as N
from fathomline.functions import text as X
from fathomline.functions import urls as U
from fathomline.plans.aggregates import day, D
from fathomline.operators.timeline import RAISE, STOP, UNITS, title_sums, title_words, url_key
from fathomline.plans.registry import q
from fathomline.sources.tables import AS_OF

FORMS = "case p_partkey % 6 when 0 then ', Inc.' when 1 then ' Holdings LLC' when 2 then ' Corp' when 3 then ' Co. Ltd.' when 4 then '' else ' Limited Edition' end"
NAMED = f"p_name || {FORMS}"
SUFFIX = "corporation|corporations|holding|holdings|incorporated|inc|llc|l\\.l\\.c|corp|co|ltd|lp|llp"
BARE = rf"trim(regexp_replace(trim({NAMED}), '(?i)(?:\s*,?\s*\b(?:{SUFFIX})\b\.?)+$', ''))"


def named(t):
    return t.raw("part").select(F.col("p_partkey").alias("id"), F.expr(f"concat(p_name, {FORMS})").alias("name"))


q("T2_strip_suffix", lambda t: named(t).select("id", N.strip_suffix(F.col("name")).alias("name")), f"select p_partkey as id, {BARE} as name from part")
q("T3_slugify", lambda t: named(t).select("id", N.slugify(F.col("name")).alias("slug")), f"select p_partkey as id, trim(regexp_replace(lower({BARE}), '[^a-z0-9]+', '-', 'g'), '-') as slug from part")
q("T4_match_key", lambda t: named(t).select("id", N.normalize_name(F.col("name")).alias("key")), f"select p_partkey as id, regexp_replace(lower({BARE}), '[^a-z0-9]+', '', 'g') as key from part")
q("T1_fold_marks", lambda t: t.raw("documents").select("doc_id", N.fold(F.col("text")).alias("folded")), "select doc_id, strip_accents(text) as folded from documents")
q("T5_token_subset", lambda t: named(t).select("id", N.token_subset(F.col("name"), F.lit("lemon small goods corp")).alias("subset")),
  f"with w as (select p_partkey as id, list_filter(regexp_split_to_array(lower({BARE}), '[^a-z0-9]+'), lambda x: x <> '') as a from part) select id, len(a) > 0 and (len(list_filter(a, lambda x: not list_contains(['lemon', 'small', 'goods'], x))) = 0 or len(list_filter(['lemon', 'small', 'goods'], lambda x: not list_contains(a, x))) = 0) as subset from w")
q("T6_disambiguator", lambda t: t.companies.select("id", N.disambiguated(F.col("slug"), F.col("id")).alias("slug")), "select id, slug || '-' || substring(sha256(cast(id as varchar)), 1, 6) as slug from companies")

URLS = "case when page_id % 4 = 0 then replace(url, '?', '?utm_source=x&') when page_id % 4 = 1 then replace(replace(url, 'http://', 'HTTP://'), '.example.com/', '.Example.com:80/') else url end"


def urls(t):
    return t.raw("pages").select("page_id", F.expr(URLS).alias("url"))


q("T8_canonical_url", lambda t: urls(t).select("page_id", U.canonical_url(F.col("url")).alias("url")),
  f"with u as (select page_id, {URLS} as url from pages), p as (select page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) as s, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1)) as h, regexp_extract(url, '^[A-Za-z]+://[^/:?#]*:([0-9]+)', 1) as port, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path, list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: x <> '' and split_part(x, '=', 1) not in ('ref', 'gclid', 'fbclid', 'ref_src') and x not like 'utm!_%' escape '!') as kept from u) select page_id, s || '://' || h || case when port = '' or (s = 'http' and port = '80') or (s = 'https' and port = '443') then '' else ':' || port end || case when path = '/' then path else regexp_replace(path, '/+$', '') end || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as url from p")
HOST = "regexp_replace(lower(regexp_extract({0}, '^[A-Za-z]+://([^/:?#]*)', 1)), '^www\\.', '')"
q("T9_hostname", lambda t: urls(t).select("page_id", U.hostname(F.col("url")).alias("host")), f"select page_id, {HOST.format(URLS)} as host from pages")
q("T10_canonical_domain", lambda t: t.companies.select("id", F.expr("case id % 4 when 0 then 'https://a.github.io/x' when 1 then 'https://shop.myshopify.com' when 2 then website else 'mailto:x' end").alias("u")).select("id", U.canonical_domain(F.col("u")).alias("domain")),
  f"select id, case when id % 4 = 2 and website is not null then {HOST.format('website')} end as domain from companies")
q("T11_storable", lambda t: urls(t).select("page_id", U.storable(F.expr("case page_id % 4 when 0 then concat('ftp://', substring(url, 9)) when 1 then 'javascript:alert(1)' when 2 then concat(' ', upper(url)) else url end")).alias("ok")), "select page_id, page_id % 4 >= 2 as ok from pages")
q("T12_listed_hosts", lambda t: urls(t).select("page_id", U.on_host(U.hostname(F.col("url")), ["example.org", "example.net"]).alias("listed")), f"select page_id, regexp_matches({HOST.format(URLS)}, '(^|\\.)example\\.(org|net)$') as listed from pages")
q("T13_dated_article", lambda t: t.rounds.select("id", F.concat(F.lit("https://n.example.com/"), F.date_format("announced_date", "yyyy/M"), F.when(F.col("id") % 2 == 0, "/title").otherwise("")).alias("url")).select("id", U.dated_article(F.regexp_replace("url", "/19", "/20")).alias("dated")), "select id, case when announced_date is not null then true end as dated from rounds")
q("T54_display_name", lambda t: urls(t).select("page_id", U.display_name(F.col("url")).alias("name")), f"select page_id, array_to_string(list_transform(string_split(replace(split_part({HOST.format(URLS)}, '.', 1), '-', ' '), ' '), lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), ' ') as name from pages")
q("T51_url_key_and_gap", lambda t: t.rounds.select("id", url_key(F.concat("news_url", F.when(F.col("id") % 2 == 0, "/?utm_source=x#top").otherwise(""))).alias("key"), F.abs(F.datediff(F.col("announced_date"), day())).alias("gap")), f"select id, replace(news_url, 'https://', '') as key, abs(announced_date - {D}) as gap from rounds")
q("T19_funding_words", lambda t: t.raw("documents").select("doc_id", X.funding_words(F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, " Series-A round").otherwise(" evaluations praised"))).alias("hit")),
  r"select doc_id, regexp_matches(lower(text || case when doc_id % 3 = 0 then ' Series-A round' else ' evaluations praised' end), '\b(?:raised|raises|funding|series[\s\-]+a|series[\s\-]+b|series[\s\-]+c|series[\s\-]+d|series[\s\-]+e|seed|led[\s\-]+by|valuation|closes)\b') as hit from documents")
q("T20_phrase_in_tokens", lambda t: t.raw("documents").select("doc_id", X.phrase_in(F.col("text"), F.lit("of the")).alias("hit")), "select doc_id, contains(' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ', ' of the ') as hit from documents")
PLACED = "case p_partkey % 5 when 0 then '[' || p_name || ']' when 1 then 'TBD' when 2 then ' Stealth' else p_name end"
q("T24_placeholder_name", lambda t: t.raw("part").select(F.col("p_partkey").alias("id"), F.expr(PLACED).alias("name")).select("id", (F.trim("name").rlike(r"^\[.*\]$") | F.lower(F.trim("name")).isin("tbd", "stealth")).alias("placeholder")), f"select p_partkey as id, regexp_matches(trim({PLACED}), '^\\[.*\\]$') or lower(trim({PLACED})) in ('tbd', 'stealth') as placeholder from part")
q("T27_state_codes", lambda t: (lambda m: t.companies.select("id", F.coalesce(F.element_at(m, F.lower(F.trim(F.expr("case id % 4 when 0 then ' Texas' when 1 then 'CALIFORNIA' when 2 then 'ny' else 'Elsewhere' end")))), F.lit("other")).alias("state")))(F.create_map(*[F.lit(x) for p in (("texas", "TX"), ("california", "CA"), ("ny", "NY")) for x in p])),
  "select id, case id % 4 when 0 then 'TX' when 1 then 'CA' when 2 then 'NY' else 'other' end as state from companies")
EMP = "case c_custkey % 6 when 0 then '11-50' when 1 then '1,001 employees' when 2 then '5000+' when 3 then '250' when 4 then '90 to 20 people' else 'unknown' end"
q("T29_employee_range", lambda t: t.raw("customer").select(F.col("c_custkey").alias("id"), N.employee_range(F.expr(EMP)).alias("r")).select("id", "r.low", "r.high"),
  "select c_custkey as id, cast(case c_custkey % 6 when 0 then 11 when 1 then 1001 when 2 then 5000 when 3 then 250 when 4 then 20 end as int) as low, cast(case c_custkey % 6 when 0 then 50 when 1 then 1001 when 2 then 100000 when 3 then 250 when 4 then 90 end as int) as high from customer")
q("T30_buckets", lambda t: t.rounds.groupBy("company_id").agg(F.count("*").alias("n")).select("company_id", F.when(F.col("n") <= 5, "1-10").when(F.col("n") <= 25, "11-50").otherwise("51-200").alias("bucket")), "select company_id, case when count(*) <= 5 then '1-10' when count(*) <= 25 then '11-50' else '51-200' end as bucket from rounds group by 1")
RT = "case id % 6 when 0 then ' Series E extension' when 1 then 'Series ?' when 2 then 'Seed (top-up)' when 3 then 'undisclosed' when 4 then null else 'Series B' end"
q("T31_round_type", lambda t: t.rounds.select("id", F.expr(RT).alias("r")).select("id", N.normalized_round_type(F.col("r")).alias("kind"), N.clean_round_type(F.col("r")).alias("clean"), N.compatible_types(F.col("r"), F.lit("series b")).alias("fits")),
  "select id, case id % 6 when 0 then 'series e' when 2 then 'seed' when 5 then 'series b' end as kind, case id % 6 when 0 then 'Series E extension' when 2 then 'Seed (top-up)' when 5 then 'Series B' end as clean, id % 6 in (1, 3, 4, 5) as fits from rounds")
q("T32_visible_text", lambda t: t.raw("pages").select("page_id", X.visible_text("html").alias("text")).select("page_id", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest")))
q("T33_truncated", lambda t: t.raw("documents").select("doc_id", X.truncate_words(F.col("text"), 80).alias("text")), r"select doc_id, case when length(text) <= 80 then text when regexp_replace(substring(text, 1, 80), '\s+\S*$', '') <> '' then regexp_replace(substring(text, 1, 80), '\s+\S*$', '') else substring(text, 1, 80) end as text from documents")
q("T34_tag_strip", lambda t: t.raw("pages").select("page_id", X.squeeze(F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")).alias("text")).select("page_id", F.md5(F.col("text").cast("binary")).alias("digest")),
  r"select page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) as digest from pages")
q("T35_outbound_links", lambda t: t.raw("pages").select("page_id", F.explode(X.page_links("html")).alias("l")).groupBy("page_id").agg(F.count("*").alias("links"), F.min("l.url").alias("first_url")))
q("T37_for_sale", lambda t: t.raw("documents").select("doc_id", X.for_sale(F.concat(F.col("text"), F.when(F.col("doc_id") % 5 == 0, " Acme.com is for sale").otherwise(""))).alias("parked")), "select doc_id, doc_id % 5 = 0 or contains(lower(text), 'parked domain') or contains(lower(text), 'buy this domain') as parked from documents")
CAREERS = "text || case doc_id % 4 when 0 then ' Previously at Stripe Labs, formerly at stripe. Veteran of Stripe Labs and ex-Google' when 1 then ' He led the big thing at work; our team' else '' end"
q("T38_career_signals", lambda t: t.raw("documents").withColumn("text", F.expr(CAREERS)).select("doc_id", F.col("text").rlike(B.CAREER).alias("signal"), F.col("text").rlike(B.TEAM).alias("team"), F.array_join(B.earlier_employers(F.col("text")), "|").alias("employers")),
  f"select doc_id, regexp_matches(text, '{B.CAREER}') as signal, regexp_matches(text, '{B.TEAM}') as team, array_to_string(list_filter(e, lambda x, i: not list_contains(list_transform(e[1:i - 1], lambda y: lower(y)), lower(x))), '|') as employers from (select *, list_transform(regexp_extract_all(text, '{B.EMPLOYER}', 1), lambda x: trim(x)) as e from (select doc_id, {CAREERS} as text from documents))")
QUOTED = "case doc_id % 6 when 0 then substring(text, 5, 30) when 1 then concat(substring(text, 1, 20), ' ... ', substring(text, 41, 20)) when 2 then 'never said so' when 3 then concat(substring(text, 41, 20), '...', substring(text, 1, 20)) when 4 then concat(substring(text, 1, 30), '...', substring(text, 60, 8)) end"
SQUEEZED = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
q("T39_quote_grounded", lambda t: t.raw("documents").select("doc_id", X.quote_grounded(F.expr(QUOTED), F.col("text")).alias("grounded")),
  rf"""with a as (select doc_id, {SQUEEZED.format('text')} as src, {QUOTED} as quote from documents),
 b as (select *, list_filter(list_transform(regexp_split_to_array(quote, '\.\.\.|…'), lambda p: {SQUEEZED.format('p')}), lambda p: p <> '') as parts from a)
 select doc_id, case when quote is null or len(parts) = 0 then false when len(parts) = 1 then contains(src, parts[1]) else list_reduce(list_concat([{{'at': 1, 'p': ''}}], list_transform(parts, lambda p: {{'at': 0, 'p': p}})),
  lambda a, b: {{'at': cast(case when a.at < 0 or length(b.p) < {X.FRAGMENT} or strpos(substring(src, a.at), b.p) = 0 then -1 else a.at - 1 + strpos(substring(src, a.at), b.p) + length(b.p) end as int), 'p': ''}}).at > 0 end as grounded from b""")


CAPS = r"list_distinct(list_filter(list_transform(flatten(list_transform(regexp_split_to_array({0}, '[.!?\n]+\s*'), lambda s: list_filter(regexp_split_to_array(trim(s), '\s+'), lambda w: w <> '')[2:])), lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}]', '', 'g')), lambda w: regexp_matches(w, '^[A-Z].{{2,}}')))"
CLAIMS = f"claims as (select a.item_id, {CAPS.format('a.text')} as c, string_split(a.text, ' ') as w, lower(b.text) as s from benchmark a join benchmark b on b.item_id = a.item_id + 1)"


def claims(t):
    """Each item's text as a claim, the next item's as its evidence."""
    b = t.raw("benchmark")
    return b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("evidence")), "item_id")


q("T40_grounded_share", lambda t: claims(t).select("item_id", F.size(X.capitalised(F.col("text"))).alias("words"), F.round(X.grounded_share(X.capitalised(F.col("text")), F.col("evidence")), 6).alias("share")),
  f"with {CLAIMS} select item_id, cast(len(c) as int) as words, round(case when len(c) = 0 then 1 else len(list_filter(c, lambda x: contains(s, lower(x)))) / len(c) end, 6) as share from claims")
q("T41_claim_grounded", lambda t: claims(t).select("item_id", (X.grounded_share(F.split("text", " "), F.col("evidence")) >= 0.6).alias("grounded")), f"with {CLAIMS} select item_id, len(list_filter(w, lambda x: contains(s, lower(x)))) / len(w) >= 0.6 as grounded from claims")
q("T42_regex_flag", lambda t: t.companies.select("id", F.concat(F.coalesce("description_short", F.lit("")), F.expr("case id % 4 when 0 then ' of Berlin' when 1 then ', an INDIAN firm' when 2 then ' parisian' else '' end")).alias("d")).select("id", F.col("d").rlike(B.ABROAD).alias("abroad")), "select id, id % 4 in (0, 1) as abroad from companies")
q("T43_counts", lambda t: t.raw("documents").select("doc_id", X.word_count(F.col("text")).alias("words"), X.paragraph_count(F.col("text")).alias("paragraphs")),
  r"select doc_id, cast(len(regexp_extract_all(text, '\S+')) as int) as words, cast(len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda p: trim(p) <> '')) as int) as paragraphs from documents")
def quoted(words):
    return ", ".join(f"'{w}'" for w in words)


# without look-ahead: a suffix that begins with one of the words that no outlet's name begins with is left alone
_UNITS = "x0"
for _unit, _forms in UNITS.items():
    _UNITS = rf"regexp_replace({_UNITS}, '\$(\d+(?:\.\d+)?)\s*(?:{_forms})\b', '\1 {_unit}', 'g')"
SIGNATURE = rf"""with a as (select doc_id, regexp_replace(lower(case when regexp_matches(text, '(?i)\s+[-–—|]\s+(?:and|but|as|a|an|the|it|its|here|what|why|how|not)\b[^-–—|]*$') then text
   else regexp_replace(text, '\s+[-–—|]\s+[^-–—|]{{1,40}}$', '') end), '[’'']s\b', '', 'g') as x0 from documents),
 b as (select doc_id, regexp_replace({_UNITS}, '\$(\d)', '\1', 'g') as x from a)
select doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(x, '[^a-z0-9.]+'), lambda w: w <> '' and w not in ({quoted(STOP)})), lambda w: case when w in ({quoted(RAISE)}) then 'raise' else w end))), ' ') as words,
 coalesce((select string_agg(s, '|' order by i) from (select s, min(i) as i from (select unnest(list_transform(regexp_extract_all(x, '\b\d+(?:\.\d+)?\s+(?:{'|'.join(UNITS)})\b'), lambda m: regexp_replace(m, '\s+', ' ', 'g'))) as s, generate_subscripts(regexp_extract_all(x, '\b\d+(?:\.\d+)?\s+(?:{'|'.join(UNITS)})\b'), 1) as i) group by s)), '') as sums from b"""
q("T44_title_signature", lambda t: t.raw("documents").select("doc_id", F.array_join(F.array_sort(title_words(F.col("text"))), " ").alias("words"), F.array_join(title_sums(F.col("text")), "|").alias("sums")), SIGNATURE)
q("T46_embedding_text", lambda t: t.companies.select("id", F.sha2(F.concat_ws("\n", "name", F.coalesce("description_short", F.lit(""))), 256).alias("hash")), "select id, sha256(name || chr(10) || coalesce(description_short, '')) as hash from companies")
USD = "cast(case when o_orderkey % 17 = 0 then null else round(o_totalprice * power(10, o_orderkey % 5)) end as double)"
q("T47_format_usd", lambda t: t.raw("orders").select(F.col("o_orderkey").alias("id"), F.expr(USD).alias("x")).select("id", N.format_usd(F.col("x")).alias("short"), N.format_usd_exact(F.col("x")).alias("exact")),
  f"with u as (select o_orderkey as id, {USD} as x from orders), f as (select id, x, case when x >= 1e9 then x / 1e9 when x >= 1e6 then x / 1e6 when x >= 1e3 then x / 1e3 else x end as y, case when x >= 1e9 then 'B' when x >= 1e6 then 'M' when x >= 1e3 then 'K' else '' end as s from u) select id, case when x is null then '—' when s = '' then '$' || format('{{:,}}', cast(round(x) as bigint)) else '$' || regexp_replace(format('{{:,.1f}}', round(y, 1)), '\\.0$', '') || s end as short, case when x is null then '—' else '$' || format('{{:,}}', cast(round(x) as bigint)) end as exact from f")
q("T48_round_claim", lambda t: t.rounds.join(t.companies.select(F.col("id").alias("company_id"), "name"), "company_id").select("id", N.round_claim(F.col("name"), F.col("amount_raised"), F.col("round_type"), F.col("valuation"), F.col("announced_date")).alias("claim")),
  "with c as (select r.*, name, cast(amount_raised as double) as a, cast(valuation as double) as v from rounds r join companies c on company_id = c.id) select id, name || ' raised ' || " + "{a}" .replace("{a}", "case when a is null or a < 0 then 'an undisclosed amount' when a >= 1e6 then printf('$%.1fM', a / 1e6) when a >= 1e3 then printf('$%.0fK', a / 1e3) else printf('$%.0f', a) end") + " || case when coalesce(round_type, '') <> '' then ' in its ' || round_type || ' round' else '' end || case when v is not null then ' at a ' || case when v >= 1e6 then printf('$%.1fM', v / 1e6) when v >= 1e3 then printf('$%.0fK', v / 1e3) else printf('$%.0f', v) end || ' post-money valuation' else '' end || case when announced_date is not null then ', announced ' || cast(announced_date as varchar) else '' end || '.' as claim from c")
q("T49_labels", lambda t: t.companies.select("id", X.long_date(F.col("checked_at")).alias("day"), X.range_label(F.col("employee_count_min"), F.col("employee_count_max")).alias("staff"), X.relative_time(F.datediff(day(), F.col("created_at")) * 86400).alias("age")),
  f"select id, coalesce(strftime(checked_at, '%B %-d, %Y'), '—') as day, case when employee_count_min is null then '—' else employee_count_min || '–' || employee_count_max end as staff, case when d = 0 then 'just now' when d * 24 < 36 then d * 24 || ' hours ago' when d = 1 then '1 day ago' else d || ' days ago' end as age from (select *, {D} - created_at as d from companies)")
q("T49_growth_labels", lambda t: t.companies.select("id", X.growth_label(F.col("id"), F.when(F.col("id") % 3 != 0, (F.col("id") % 17 - 8) / F.lit(16.0))).alias("growth")),
  "select id, case when g is null then case when id > 0 then 'new' else '—' end when floor(g * 100 + 0.5) < 0 then '−' || cast(abs(floor(g * 100 + 0.5)) as bigint) || '%' else '+' || cast(floor(g * 100 + 0.5) as bigint) || '%' end as growth from (select id, case when id % 3 <> 0 then (id % 17 - 8) / 16.0 end as g from companies)")
q("T50_industry_slug", lambda t: t.companies.where("industry_group is not null").select(F.regexp_replace(F.lower("industry_group"), "[^a-z0-9]+", "-").alias("slug"), "industry_group").groupBy("slug").agg(F.min("industry_group").alias("industry")), "select regexp_replace(lower(industry_group), '[^a-z0-9]+', '-', 'g') as slug, min(industry_group) as industry from companies where industry_group is not null group by 1")
q("T53_xml_and_dates", lambda t: t.raw("pages").select("page_id", X.xml_escape(F.col("html")).alias("xml"), X.rfc822(F.expr("date '2001-07-31' - cast(page_id as int)").cast("timestamp")).alias("day")),
  "select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') as xml, strftime(date '2001-07-31' - cast(page_id as int), '%a, %d %b %Y %H:%M:%S GMT') as day from pages")
q("T55_pair_key", lambda t: t.competitors.where("competitor_company_id is not null").select(F.concat_ws("-", F.least("company_id", "competitor_company_id"), F.greatest("company_id", "competitor_company_id")).alias("key")).distinct(), "select distinct concat(least(company_id, competitor_company_id), '-', greatest(company_id, competitor_company_id)) as key from competitors where competitor_company_id is not null")
q("S25_json_islands", lambda t: t.raw("events").select("event_id", X.json_island(F.concat(F.lit("window.x = "), F.col("props"), F.lit("; {broken"))).alias("props")).select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")), "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
q("D1_quarters", lambda t: t.rounds.select("id", F.trunc("announced_date", "quarter").alias("start"), F.add_months(F.trunc("announced_date", "quarter"), -6).alias("before")), "select id, cast(date_trunc('quarter', announced_date) as date) as start, cast(date_trunc('quarter', announced_date) - interval 6 months as date) as before from rounds")
q("D2_iso_week", lambda t: t.rounds.select("id", F.date_trunc("week", "announced_date").cast("date").alias("week")), "select id, cast(date_trunc('week', announced_date) as date) as week from rounds")
q("D3_days_clamped", lambda t: t.rounds.select("id", F.greatest(F.datediff(F.lit("1999-01-01").cast("date"), "announced_date"), F.lit(0)).alias("days")), "select id, greatest(date '1999-01-01' - announced_date, 0) as days from rounds where announced_date is not null union all select id, 0 from rounds where announced_date is null")
q("D5_midpoint", lambda t: t.companies.select("id", ((F.coalesce("employee_count_min", "employee_count_max") + F.coalesce("employee_count_max", "employee_count_min")) / 2).alias("mid")), "select id, (employee_count_min + employee_count_max) / 2.0 as mid from companies")
q("D6_amount_bands", lambda t: t.rounds.where("amount_raised > 0").select("id", ((F.greatest("amount_raised", F.lit(150000)).cast("double") - F.least("amount_raised", F.lit(150000)).cast("double")) / F.greatest("amount_raised", F.lit(150000)).cast("double") <= 0.15).alias("near")), "select id, (greatest(cast(amount_raised as double), 150000) - least(cast(amount_raised as double), 150000)) / greatest(cast(amount_raised as double), 150000) <= 0.15 as near from rounds where amount_raised > 0")
q("D9_json_documents", lambda t: t.raw("events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.to_json(F.struct(F.col("event_type").alias("stage"))).alias("summary")), "select event_id, cast(json_extract(props, '$.k') as int) as k, '{\"stage\":\"' || event_type || '\"}' as summary from events")
q("D11_stable_key", lambda t: t.runs.select("id", F.sha2(F.concat_ws("|", F.col("stage"), F.col("id")), 256).alias("key")), "select id, sha256(stage || '|' || id) as key from runs")
q("H14_staleness", lambda t: t.companies.select("id", F.when(F.col("checked_at").isNull(), "never").when(F.datediff(F.lit(AS_OF).cast("date"), "checked_at") < 30, "fresh").otherwise("old").alias("bucket")), f"select id, case when checked_at is null then 'never' when {D} - checked_at < 30 then 'fresh' else 'old' end as bucket from companies")
