"""Addresses as Column expressions: canonical form, domain, key, classes and display forms.

Addresses are taken apart by regular expressions: Java's parser knows neither international hosts nor the repairs that
browsers make."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedgewren.functions.text import collapse_ws, truncate

#: Hosts that only redirect, the origin network's own hosts, and tracking parameters.
SHORTENERS = ("t.co", "bit.ly", "buff.ly", "lnkd.in", "ow.ly", "tinyurl.com", "dlvr.it", "trib.al", "goo.gl", "ift.tt", "j.mp", "rebrand.ly", "shorturl.at")
ORIGIN_HOSTS = ("x.com", "twitter.com", "mobile.twitter.com", "pbs.twimg.com", "t.co")
TRACKING = r"(?i)^(utm_|ref_).*$|^(ref|fbclid|gclid|mc_cid|mc_eid|igshid|si)$"

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*):/{1,}(?:[^/?#@]*@)?([^/?#:\s]+)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _PARTS, k)


def canonical_url(raw: Column) -> Column:
    """The address without fragment, tracking parameters, www., default port and closing slashes; null if it isn't http(s)."""
    t = F.btrim(collapse_ws(raw))
    full = F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), t).otherwise(F.concat(F.lit("https://"), t))
    scheme = F.lower(_part(full, 1))
    host = F.regexp_replace(F.lower(_part(full, 2)), r"^www\.", "")
    port = _part(full, 3)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    path = _part(full, 4)
    path = F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
    path = F.when(path == "", F.lit("/")).otherwise(path)
    query = F.substring(_part(full, 5), 2, 1 << 20)
    kept = F.filter(F.split(query, "&"), lambda kv: (kv != "") & ~F.element_at(F.split(kv, "="), 1).rlike(TRACKING))
    query = F.array_join(kept, "&")
    made = F.concat(scheme, F.lit("://"), host, F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)), path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when((t != "") & scheme.isin("http", "https") & (host != ""), made)


def domain(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(_part(url, 2)), r"^www\.", ""), F.lit(""))


def url_key(canonical: Column) -> Column:
    return F.substring(F.sha1(canonical), 1, 16)


def is_shortener(url: Column) -> Column:
    return domain(url).isin(*SHORTENERS)


def is_origin(url: Column) -> Column:
    host = domain(url)
    return host.isin(*ORIGIN_HOSTS) | host.endswith(".twimg.com")


def is_external(url: Column) -> Column:
    return F.lower(_part(url, 1)).isin("http", "https") & ~is_shortener(url) & ~is_origin(url)


def pretty_url(url: Column, most: int = 72) -> Column:
    return truncate(F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "/$", ""), most)


def title_from_url(url: Column) -> Column:
    """The last path segment as words, capitalised; the domain where there is none or only digits."""
    segments = F.filter(F.split(_part(url, 4), "/"), lambda s: s != "")
    last = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit(""))
    decoded = F.try_url_decode(last)
    name = F.regexp_replace(decoded, r"(?i)\.(html?|php|aspx?|pdf|md)$", "")
    name = F.btrim(F.regexp_replace(name, "[-_+]+", " "))
    words = F.transform(F.split(name, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20)))
    title = F.when((name == "") | name.rlike("^[0-9]+$"), domain(url)).otherwise(F.array_join(words, " "))
    return F.when(domain(url) == "", url).otherwise(F.coalesce(title, url))


def extract_urls(text: Column) -> Column:
    """Distinct external addresses of a text, canonical, in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(r"(https?://\S+)"), F.lit(1))
    made = F.filter(F.transform(found, canonical_url), lambda u: u.isNotNull())
    return F.array_distinct(F.filter(made, is_external))
