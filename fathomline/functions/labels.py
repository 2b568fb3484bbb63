"""Investor names, tags and industries by canonical keys; signals in descriptions and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.functions.text import squeeze

# fixed values: endings that an investor's key is without, and names of one firm
FIRM_ENDINGS = r"capital|ventures?|partners?|management|group|fund|lp|llc"
SAME_FIRM = [("a16z", "andreessen horowitz"), ("gv", "google"), ("nea", "new enterprise associates"), ("ga", "general atlantic"), ("ivp", "institutional venture")]
# fixed values: keys that name no investor, and patterns of such keys
NO_INVESTOR = [
    "investors", "investor", "angel investors", "angel investor", "strategic investors", "strategic investor", "existing investors", "existing investor", "new investors",
    "new investor", "individual investors", "institutional investors", "private investors", "various investors", "other investors", "additional investors",
    "undisclosed investors", "unnamed investors", "a group of investors", "group of investors", "a consortium of investors", "consortium of investors",
    "a syndicate of investors", "syndicate of investors", "undisclosed", "undisclosed investor", "n/a", "na", "none", "unknown", "various", "anonymous", "confidential",
    "tbd", "tba", "others", "et al", "et al.", "self funded", "self-funded", "bootstrapped", "crowdfunding", "the public",
]
NO_INVESTOR_PATTERNS = [
    r"(a|an|the|several|multiple|numerous|various|other|existing|new|undisclosed|unnamed|anonymous|strategic|group of|number of|consortium of|syndicate of|\s)+(angel\s+|institutional\s+|individual\s+|strategic\s+|private\s+)?investors?",
    r"[\W_]+", r"n\.?\s*/?\s*a\.?",
]
# fixed values: countries of domain endings
COUNTRY_ENDINGS = {
    "co.uk": "GB", "org.uk": "GB", "me.uk": "GB", "uk": "GB", "co.in": "IN", "in": "IN", "de": "DE", "fr": "FR", "ca": "CA", "com.au": "AU", "net.au": "AU", "au": "AU",
    "com.br": "BR", "br": "BR", "nl": "NL", "se": "SE", "no": "NO", "dk": "DK", "fi": "FI", "com.sg": "SG", "sg": "SG", "co.jp": "JP", "jp": "JP", "co.kr": "KR", "kr": "KR",
    "co.il": "IL", "il": "IL", "es": "ES", "it": "IT", "co.nz": "NZ", "nz": "NZ", "ch": "CH", "be": "BE", "pl": "PL", "pt": "PT", "com.mx": "MX", "mx": "MX", "cn": "CN",
}
# fixed values: pattern of descriptions of firms outside the United States
ABROAD = (
    r"(?i)\b(?:indian|canadian|british|german|french|chinese|israeli|japanese|korean|australian|dutch|swedish|swiss|spanish|italian|brazilian|mexican|"
    r"singaporean|irish|finnish|norwegian|danish|belgian|austrian|polish|bengaluru|bangalore|london|berlin|munich|toronto|vancouver|montreal|"
    r"paris|tokyo|shanghai|beijing|shenzhen|singapore|sydney|melbourne|amsterdam|stockholm|zurich|dublin|seoul|mumbai|delhi|tel aviv|sao paulo|mexico city)\b"
)
# fixed values: patterns of career history, of a team's section, and of a named earlier employer
CAREER = (
    r"(?i)previously|formerly|prior to|before (?:founding|starting|joining)|worked at|spent \d+ years|\d+ years at|veteran of|early (?:employee|engineer|hire) at|"
    r"led .{0,40} at|built .{0,40} at|(?:^|[^a-z])ex-[a-z]|co-?founded"
)
TEAM = r"(?i)(?:co-?founders?|founders?|chief \w+ officer|head of|our team|leadership|the team|(?:^|[^a-z])(?:CEO|CTO|COO)(?:[^a-z]|$))"
EMPLOYER = (
    r"(?:[Pp]reviously|[Ff]ormerly|[Pp]rior to|[Bb]efore (?:founding|starting|joining)|[Ee]x-|[Vv]eteran of|[Ss]pent \d+ years|[Ee]arly (?:employee|engineer|hire))"
    r"\W*(?:[a-z]+\W+){0,6}?(?:(?:at|@)\W+)?([A-Z][A-Za-z0-9&-]+(?:\s+[A-Z][A-Za-z0-9&-]+){0,2})"
)
# fixed values: words of links that tell what a company does, and paths that never do
TELLING = ["about", "team", "company", "story", "mission", "product", "platform", "solution", "what-we-do", "how-it-works", "manifesto"]
UNTELLING = (
    r"(?i)(?:\.(?:pdf|png|jpg|jpeg|gif|svg|webp|css|js|ico|xml|zip|mp4|webm)$|/(?:privacy|terms|legal|cookie|gdpr|login|signin|signup|register|"
    r"contact|support|help|press|blog|news|careers|jobs|pricing|docs?|api)(?:/|$))"
)


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def investor_key(name: Column) -> Column:
    """Lower case without firm endings; names of one firm share the first of them."""
    bare = F.trim(F.regexp_replace(F.trim(name), rf"(?i)(?:\s+\b(?:{FIRM_ENDINGS})\b\.?)+$", ""))
    key = squeeze(F.lower(bare))
    return F.coalesce(F.try_element_at(_map({x: min(pair) for pair in SAME_FIRM for x in pair}), key), key)


def no_investor(name: Column) -> Column:
    """A placeholder in the place of an investor's name; blank too."""
    key = investor_key(name)
    hit = (key == "") | key.isin(NO_INVESTOR)
    for pattern in NO_INVESTOR_PATTERNS:
        hit = hit | key.rlike(f"^(?:{pattern})$")
    return hit


def country_of(host: Column) -> Column:
    """The country of a host's ending, longest ending first; a bare ending is no host."""
    parts = F.split(F.regexp_replace(F.lower(host), r"\.$", ""), r"\.")
    table = _map(COUNTRY_ENDINGS)
    return F.coalesce(*[F.when(F.size(parts) > n, F.try_element_at(table, F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), "."))) for n in (3, 2, 1)])


def label_key(label: Column) -> Column:
    """Lower case; runs of spaces, hyphens, underscores and slashes are one space."""
    return F.trim(F.regexp_replace(F.lower(F.trim(label)), r"[\s\-_/]+", " "))


def canonical_label(label: Column, aliases: dict[str, str]) -> Column:
    """The canonical form of a label's key, else the trimmed label; null for blank. ``aliases`` maps keys to forms."""
    return F.coalesce(F.try_element_at(_map(aliases), label_key(label)), F.nullif(F.trim(label), F.lit("")))


def canonical_tags(tags: Column, aliases: dict[str, str]) -> Column:
    """Each tag's canonical form, else lower case with hyphens; blanks go, the first of equal ones stays."""
    table = _map(aliases)
    some = F.filter(tags, lambda x: F.trim(x) != "")
    return F.array_distinct(F.transform(some, lambda x: F.coalesce(F.try_element_at(table, label_key(x)), F.regexp_replace(F.lower(F.trim(x)), r"\s+", "-"))))


def earlier_employers(text: Column) -> Column:
    """Employers that follow a cue of career history, the first spelling of each."""
    found = F.transform(F.regexp_extract_all(text, F.lit(EMPLOYER), F.lit(1)), F.trim)
    return F.aggregate(found, F.array().cast("array<string>"), lambda kept, x: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(x)), kept).otherwise(F.array_append(kept, x)))


def telling(path: Column, label: Column) -> Column:
    """How many words of ``TELLING`` a link's path or label has; 0 for paths that never tell."""
    hits = F.size(F.filter(F.array(*map(F.lit, TELLING)), lambda w: F.lower(path).contains(w) | F.lower(label).contains(w)))
    return F.when(path.rlike(UNTELLING), 0).otherwise(hits)
