"""Whether an article is about the company of a name, or about another one of a similar name.

An article's words, and what stands between them, are two arrays of equal length. A name's occurrences are the places
where its tokens follow each other. Three signs speak against the company: the name only occurs as a common
word; it mostly stands within a longer name; nothing else of the company's description occurs and the name hardly does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.names import strip_suffix
from fathomline.functions.subjects import COMMON, mentions
from fathomline.functions.text import tokens
from fathomline.functions.urls import hostname

# fixed values: words after a name that don't make it a longer name
FOLLOWERS = [
    "inc", "llc", "corp", "corporation", "ltd", "co", "ceo", "cto", "coo", "cfo", "founder", "cofounder", "co-founder", "president", "chairman",
    "chief", "series", "ipo", "raises", "raised", "raise", "raising", "secures", "secured", "lands", "landed", "closes", "closed", "announces",
    "announced", "nabs", "nabbed", "banks", "bags", "bagged", "grabs", "grabbed", "gets", "got", "adds", "attracts", "receives", "received",
    "completes", "completed", "reaches", "scores", "launches", "launched", "expands", "acquires", "acquired", "valued", "hits", "tops", "joins",
    "opens", "brings", "wins", "won", "plans", "aims", "seeks", "files", "reports", "reveals", "says", "said", "targets", "enters", "moves", "hires",
    "buys", "sells", "starts", "begins", "makes", "sets", "eyes", "unveils", "debuts", "partners", "taps", "picks", "names", "will", "has", "was",
    "is", "to", "also", "now", "just", "still", "may", "might", "could", "can", "reportedly", "officially", "finally", "nearly", "almost", "again",
    "soon", "more", "private", "funding", "round", "deal", "valuation", "investment", "investors", "stock", "shares", "lets", "strikes", "signs",
    "seals", "represents", "chatbot", "ai",
]
# fixed values: words before a name that don't make it a longer name, and the pattern of endings that don't
PRECEDERS = [
    "startup", "startups", "company", "firm", "maker", "developer", "platform", "app", "giant", "unicorn", "rival", "competitor", "fintech",
    "biotech", "insurtech", "edtech", "healthtech", "proptech", "exclusive", "breaking", "report", "reports", "sources", "update", "watch",
    "venture-backed", "the", "a", "an", "industry", "start-up", "startup's",
]
ATTRIBUTIVE = r"(?i)-(backed|based|led|founded|owned|focused|native|headquartered)$"
# fixed values: words that describe any company
GENERIC = [
    "a", "an", "and", "as", "at", "based", "building", "builds", "business", "companies", "company", "customers", "data", "develops", "digital",
    "enables", "for", "from", "helps", "in", "into", "is", "its", "of", "offering", "offers", "on", "platform", "products", "provides", "services",
    "software", "solution", "solutions", "startup", "startups", "technology", "that", "the", "their", "through", "to", "tools", "us", "users",
    "using", "with", "ai", "app", "apps",
]
# fixed values: what may stand within a name, and what ends a phrase
WITHIN, BOUNDARY = r"^[\s\-.,:;'’]+$", r"[.!?:]|\s[-–—|]|[-–—|]\s"
CANDIDATES, OVERLAP, COVERED, TOP = 4, 2, 0.6, 3  # fixed values
ALONE = r"\p{Alnum}++(?:['’]\p{Alnum}++)*+"  # ASCII letters and digits
WORD = r"(\P{Alnum}*+)" + ALONE
HYPHENED = r"\p{Alnum}++(?:['’-]\p{Alnum}++)*+"


def _plain(words: Column) -> Column:
    """Lower case, without possessives."""
    return F.transform(words, lambda w: F.when(w.contains("'") | w.contains("’"), F.regexp_replace(F.lower(w), "['’]s$", "")).otherwise(F.lower(w)))


def _squashed(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def name_variants(name: Column) -> Column:
    """The name, its tokens as one word, and a distinctive first token."""
    parts = F.split(F.lower(F.trim(strip_suffix(name))), r"\s+")
    head = F.get(parts, F.lit(0))
    several = F.size(parts) >= 2
    return F.array_distinct(F.array_compact(F.array(name, F.when(several, F.array_join(parts, "")), F.when(several & (F.length(head) >= 4) & ~head.isin(COMMON), head))))


def _chains(text: Column, cut) -> Column:
    """At each word of a text what hyphens join to it, by ``cut(parts, place)``."""
    joined = F.regexp_extract_all(text, F.lit(HYPHENED), F.lit(0))
    return F.flatten(F.transform(joined, lambda w: F.when(w.contains("-"), F.transform(F.split(w, "-"), lambda p, k: F.array_join(cut(F.split(w, "-"), k), "-"))).otherwise(F.array(w))))


def _once(value: Column, use) -> Column:
    """``use(value)``, with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _beside(i: Column, n: Column, left: bool) -> Column:
    """The phrase of the occurrence at ``i`` and the next capitalised word beside it, past the company's own; null if there is none."""
    words, gaps = F.col("_words"), F.col("_gaps")
    end = i + n - 1

    def phrased(at: Column, word: Column) -> Column:
        between = F.slice(gaps, at + 1, i - at) if left else F.slice(gaps, end + 1, at - end)
        phrase = F.array_join(F.concat(F.array(word), F.slice(words, at + 1, end - at)) if left else F.concat(F.slice(words, i, at - i), F.array(word)), " ")
        plain = F.lower(word)
        fits = at.isNotNull() & word.rlike("^[A-Za-z]") & word.rlike("[A-Z]") & ~plain.isin(FOLLOWERS)
        if left:
            owner = word.rlike("['’]s?$") | F.get(between, F.lit(0)).rlike("^['’]")
            fits = fits & ~plain.isin(PRECEDERS) & ~owner & ~word.rlike(ATTRIBUTIVE)
        fits = fits & ~F.exists(between, lambda g: g.rlike(BOUNDARY))
        return F.when(fits, _once(phrase, lambda p: F.when(~F.col("_identity").contains(_squashed(p)), p)))

    # mostly the very next word is another's; all of the text's are only looked through where it is the company's own
    if left:
        at = F.when(F.array_contains("_own", F.lower(F.get("_back", i - 2))), F.array_max(F.filter("_foreign_back", lambda j: j < i))).when(i > 1, i - 1)
        return _once(at, lambda at: _once(F.regexp_replace(F.get("_back", at - 1), "^[^A-Za-z]+", ""), lambda word: phrased(at, word)))
    at = F.when(F.array_contains("_own", F.lower(F.get("_ahead", end))), F.array_min(F.filter("_foreign_ahead", lambda j: j > end))).when(end < F.size("_low"), end + 1)
    return _once(at, lambda at: _once(F.get("_ahead", at - 1), lambda word: phrased(at, word)))


VERDICT = ("occurrences", "proper", "extended", "overlap", "suspect", "reasons", "evidence")


def _read(pairs: DataFrame, name: str, description: str, text: str, context: str | None) -> DataFrame:
    """``pairs`` with what no variant of a name changes: the text and its words, the company's words and its identity."""
    blank = F.lit("")
    told = F.concat_ws(" ", F.coalesce(F.col(description), blank), F.coalesce(F.col(context), blank) if context else blank)
    df = pairs.withColumn("_text", F.coalesce(F.col(text), blank)).withColumn("_words", F.regexp_extract_all("_text", F.lit(ALONE), F.lit(0)))
    described = F.array_distinct(_plain(F.regexp_extract_all(F.coalesce(F.col(description), blank), F.lit(ALONE), F.lit(0))))
    told_words = F.filter(described, lambda w: (F.length(w) > 3) & w.rlike("^[a-z]") & ~w.isin(GENERIC))
    return df.withColumns({"_low": _plain(F.col("_words")), "_identity": _squashed(told), "_told": told_words, "_whole": tokens(F.coalesce(F.col(name), blank)), "_blank": F.trim(F.coalesce(F.col(text), blank)) == ""})


def _judge(df: DataFrame, name: str) -> DataFrame:
    """What ``_read`` gives, by the variant ``name``, with the columns of ``VERDICT``."""
    df = df.withColumn("_name", tokens(strip_suffix(F.coalesce(F.col(name), F.lit("")))))
    df = df.withColumns({"_own": F.array_union("_whole", "_name"), "_n": F.size("_name")})
    first = F.get("_name", F.lit(0))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("_low") - F.col("_n") + 1, F.lit(1))), lambda i: (F.get("_low", i - 1) == first) & (F.slice("_low", i, F.col("_n")) == F.col("_name")) & F.forall(F.slice("_gaps", i + 1, F.col("_n") - 1), lambda g: g.rlike(WITHIN)))
    # what stands between words, and what hyphens join, is only read where the name may occur
    df = df.withColumn("_may", (F.col("_n") > 0) & F.array_contains("_low", first))
    df = df.withColumn("_gaps", F.when(F.col("_may"), F.regexp_extract_all("_text", F.lit(WORD), F.lit(1))))
    df = df.withColumn("_at", F.when(F.col("_may"), starts).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_proper", F.filter("_at", lambda i: F.forall(F.slice("_words", i, F.col("_n")), lambda w: w.rlike("[A-Z]"))))
    occurs = F.size("_proper") > 0
    back, ahead = _chains(F.col("_text"), lambda parts, k: F.slice(parts, F.lit(1), k + 1)), _chains(F.col("_text"), lambda parts, k: F.slice(parts, k + 1, F.size(parts)))
    df = df.withColumns({"_back": F.when(occurs, back), "_ahead": F.when(occurs, ahead)})
    foreign = lambda side: F.when(occurs, F.filter(F.sequence(F.lit(1), F.size("_low")), lambda j: ~F.array_contains("_own", F.lower(F.get(side, j - 1)))))
    df = df.withColumns({"_foreign_back": foreign("_back"), "_foreign_ahead": foreign("_ahead")})
    df = df.withColumn("_longer", F.transform("_proper", lambda i: F.array_compact(F.array(_beside(i, F.col("_n"), True), _beside(i, F.col("_n"), False)))))
    df = df.withColumn("_phrases", F.flatten("_longer"))
    counted = F.transform(F.array_distinct("_phrases"), lambda p: F.struct((-F.size(F.filter("_phrases", lambda x: x == p))).alias("c"), F.array_position("_phrases", p).alias("first"), p.alias("phrase")))
    df = df.withColumn("_top", F.slice(F.array_sort(counted), 1, TOP))
    df = df.withColumn("_wanted", F.array_except("_told", "_own"))
    known = F.size("_wanted") >= CANDIDATES
    df = df.withColumns({"occurrences": F.size("_at"), "proper": F.size("_proper"), "extended": F.size(F.filter("_longer", lambda x: F.size(x) > 0)), "overlap": F.when(known, F.size(F.array_intersect("_wanted", "_low"))).otherwise(0)})
    covered = F.aggregate(F.filter("_top", lambda s: s["c"] <= -2), F.lit(0), lambda a, s: a - s["c"])
    signs = {
        "only a common word": (F.col("occurrences") > 0) & (F.col("proper") == 0) & (~known | (F.col("overlap") < OVERLAP)),
        "within a longer name": (F.col("proper") > 0) & (covered > 0) & (covered >= COVERED * F.col("proper")),
    }
    reasons = F.array_compact(F.array(*[F.when(sign, why) for why, sign in signs.items()]))
    unknown = known & (F.col("overlap") == 0) & (F.col("proper") <= 1) & (F.size(reasons) == 0)
    reasons = F.when(unknown, F.array(F.lit("no context"))).otherwise(reasons)
    speaks = ~F.col("_blank") & (F.col("_n") > 0)
    df = df.withColumn("reasons", F.when(speaks, reasons).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("evidence", F.when(F.col("proper") > 0, F.transform("_top", lambda s: F.concat(s["phrase"], F.lit(" ("), -s["c"], F.lit("x)")))))
    return df.withColumn("suspect", F.size("reasons") > 0)


def corroborate(pairs: DataFrame, name: str = "name", description: str = "description", text: str = "text", context: str | None = None) -> DataFrame:
    """``pairs`` with ``occurrences``, ``proper`` (occurrences as a proper noun), ``extended`` (those within a longer name), ``overlap``, ``suspect``, ``reasons`` and ``evidence``.

    ``context`` is what else identifies the company (site, slug). A null or blank text, or a name without a letter, is
    never suspect. Only expressions, so nothing leaves the JVM.
    """
    return _judge(_read(pairs, name, description, text, context), name).select(*pairs.columns, *VERDICT)


def best_corroboration(pairs: DataFrame, key: list[str], name: str = "name", description: str = "description", text: str = "text", context: str | None = None) -> DataFrame:
    """``corroborate`` by the variant of the name that speaks most for the company; the whole name's view if no variant occurs.

    Of the variants that occur one not suspect wins, then the most proper occurrences, then the most. The text is read
    once for all variants; it and the description stay behind, and ``read`` tells whether the text had anything.
    """
    kept = [c for c in pairs.columns if c not in (text, description)]
    read = _read(pairs, name, description, text, context)
    spread = read.select("*", F.posexplode(name_variants(F.coalesce(F.col(name), F.lit("")))).alias("variant_no", "variant"))
    seen = _judge(spread, "variant").select(*kept, *VERDICT, (~F.col("_blank")).alias("read"), "variant_no")
    order = [F.desc(F.col("occurrences") > 0), F.asc(F.when(F.col("occurrences") > 0, F.col("suspect"))), F.desc("proper"), F.desc("occurrences"), F.asc("variant_no")]
    return seen.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n", "variant_no")


NEWS_HOST = "news.google.com"  # fixed value: its rows hold a headline, no body


def attributed(name: Column, aliases: Column, title: Column, url: Column, body: Column) -> Column:
    """An article belongs to the company by its name, an alias, their tokens as one word or a distinctive first token."""
    content = F.when(hostname(url) != NEWS_HOST, body)
    names = F.flatten(F.transform(F.array_compact(F.concat(F.array(name), F.coalesce(aliases, F.array()))), name_variants))
    return F.exists(names, lambda n: mentions(n, title, content))
