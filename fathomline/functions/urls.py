"""URL scalars as Columns; malformed URLs give null or the empty string, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: query parameters that only track
TRACKING = ["gclid", "fbclid", "mc_cid", "mc_eid", "_hsenc", "_hsmi", "ref", "ref_src"]
# fixed values: hosts that many companies share
SHARED_HOSTS = [
    "github.io", "gitlab.io", "myshopify.com", "squarespace.com", "wixsite.com", "wix.com", "webflow.io", "weebly.com", "carrd.co", "godaddysites.com",
    "framer.website", "framer.app", "bubbleapps.io", "wordpress.com", "blogspot.com", "notion.site", "substack.com", "medium.com", "netlify.app",
    "vercel.app", "herokuapp.com", "pages.dev", "web.app", "firebaseapp.com", "glitch.me", "replit.app", "repl.co", "onrender.com", "fly.dev",
    "ondigitalocean.app", "azurewebsites.net", "appspot.com", "surge.sh", "render.com",
]
# fixed values: hosts of news, directories, social media and images, which are no company's own and no source of a round
AGGREGATORS = [
    "startupintros.com", "f6s.com", "getlatka.com", "growjo.com", "machinebrief.com", "marketspy.com", "failory.com", "crunchbase.com",
    "pitchbook.com", "tracxn.com", "cbinsights.com", "theorg.com", "wellfound.com", "glassdoor.com", "similarweb.com", "ycombinator.com",
    "linkedin.com", "techcrunch.com", "bloomberg.com", "forbes.com", "businessinsider.com", "reuters.com", "axios.com", "fortune.com", "wired.com",
    "theinformation.com", "nypost.com", "wsj.com", "nytimes.com", "cnbc.com", "cnn.com", "ft.com", "marketwatch.com", "barrons.com", "fool.com",
    "msn.com", "aol.com", "yahoo.com", "news.google.com", "theverge.com", "venturebeat.com", "geekwire.com", "theglobeandmail.com",
    "washingtonpost.com", "latimes.com", "theguardian.com", "apnews.com", "sec.gov", "owler.com", "zoominfo.com", "facebook.com", "twitter.com",
    "x.com", "instagram.com", "youtube.com", "wikipedia.org", "reddit.com", "medium.com", "substack.com", "duckduckgo.com", "imgur.com", "redd.it",
    "twimg.com", "discordapp.com", "giphy.com", "cloudflareaccess.com",
]
AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), AUTHORITY + r"([^/:?#]*)", 1))


def hostname(url: Column) -> Column:
    """Host without ``www.``."""
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, tracking parameters, fragment or closing slash."""
    s, h = scheme(url), host(url)
    port = F.regexp_extract(F.trim(url), AUTHORITY + r"[^/:?#]*:(\d+)", 1)
    kept_port = F.when((port == "") | ((s == "http") & (port == "80")) | ((s == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    p = path(url)
    p = F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", ""))
    query = F.regexp_extract(F.trim(url), r"\?([^#]*)", 1)
    keep = F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.substring_index(x, "=", 1).isin(TRACKING) & ~x.startswith("utm_"))
    kept = F.array_join(keep, "&")
    return F.concat(s, F.lit("://"), h, kept_port, p, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def on_host(h: Column, hosts: list[str]) -> Column:
    """The host, or a parent of it, is in ``hosts``."""
    return h.rlike(rf"(?:^|\.)(?:{'|'.join(x.replace('.', chr(92) + '.') for x in hosts)})$")


def canonical_domain(url: Column) -> Column:
    h = hostname(url)
    return F.when((h != "") & ~on_host(h, SHARED_HOSTS), h)


def storable(url: Column) -> Column:
    return scheme(url).isin("http", "https") & (host(url) != "")


def dated_article(url: Column) -> Column:
    return path(url).rlike(r"^/20\d{2}/(0?[1-9]|1[0-2])(/|$)")


def display_name(url: Column) -> Column:
    """The first label of a domain, in words."""
    return F.initcap(F.replace(F.substring_index(hostname(url), ".", 1), F.lit("-"), F.lit(" ")))
