"""URL, path, version and language-prefix expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Primary language codes that count as a locale prefix of a path.
LANGUAGE_CODES = [
    "ar", "bg", "ca", "cs", "da", "de", "el", "en", "es", "et", "fi", "fr", "he", "hi", "hr", "hu", "id", "it", "ja", "ko", "lt", "lv", "nl", "no", "pl", "pt", "ro", "ru", "sk", "sl", "sv", "th", "tr", "uk", "vi", "zh",
]


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def normal_path(x: Column, strip_slash: bool = True) -> Column:
    """A leading slash, and no trailing one except for the root."""
    x = F.when(F.startswith(x, F.lit("/")), x).otherwise(F.concat(F.lit("/"), x))
    return F.when(F.length(x) > 1, F.regexp_replace(x, "/+$", "")).otherwise(x) if strip_slash else x


def canonical(url: Column, strip_slash: bool = True) -> Column:
    """Normal path, no fragment, query kept; scheme and authority as they are."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.concat(scheme, normal_path(path(url), strip_slash), query)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def language_prefix(url: Column) -> Column:
    """The locale that the first path segment names, lower-cased with '-', or null."""
    first = F.lower(F.replace(F.coalesce(F.try_element_at(segments(url), F.lit(1)), F.lit("")), F.lit("_"), F.lit("-")))
    shaped = first.rlike(r"^[a-z]{2}(-[a-z]{2}|-[a-z]{4}|-[0-9]{3})?$")
    return F.when(shaped & F.substring(first, 1, 2).isin(LANGUAGE_CODES), first)


def tail_path(url: Column) -> Column:
    """The path after its language prefix."""
    parts = segments(url)
    rest = F.when(language_prefix(url).isNotNull(), F.slice(parts, 2, 10_000)).otherwise(parts)
    return F.concat(F.lit("/"), F.array_join(rest, "/"))


def version_key(segment: Column) -> Column:
    """[major, minor, ...] of v?N.N[.N[.N]] with any -/+ suffix, or null."""
    digits = F.regexp_extract(segment, r"^v?([0-9]+(?:\.[0-9]+){1,3})(?:[-+].*)?$", 1)
    return F.when(digits != "", F.transform(F.split(digits, r"\."), lambda d: d.cast("int")))


def suffixes(x: Column) -> Column:
    """Every path suffix, longest first."""
    parts = F.filter(F.split(x, "/"), lambda s: s != "")
    n = F.size(parts)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "/"))).otherwise(F.array().cast("array<string>"))


def matches(x: Column, pattern: str) -> Column:
    """A pattern ending in /** is a prefix of whole segments; otherwise * ? [] as in a case-sensitive glob over the whole path."""
    pattern = "/" + pattern.strip("/") if pattern.strip("/") else "/"
    if pattern.endswith("/**"):
        root = pattern[:-3]
        return F.startswith(x, F.lit(root + "/")) | (x == (root or "/"))
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out += f"[{'^' + body[1:] if body[0] == '!' else body}]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return x.rlike(f"(?s)^{out}$")


def allowed(x: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Any include pattern matches (or there is none) and no exclude pattern does."""
    ok = F.lit(True)
    if include:
        any_of = F.lit(False)
        for p in include:
            any_of = any_of | matches(x, p)
        ok = ok & any_of
    for p in exclude or []:
        ok = ok & ~matches(x, p)
    return ok


def unquoted(x: Column) -> Column:
    """Percent escapes decoded, + as it is; x itself where an escape is malformed."""
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def plain_path(x: Column) -> Column:
    """Escapes decoded, backslashes turned, no slash at either end."""
    return F.regexp_replace(F.replace(unquoted(F.trim(x)), F.lit("\\"), F.lit("/")), "^/+|/+$", "")


def eval_url(x: Column) -> Column:
    """Host and path of a judged URL, host lower-cased, // collapsed, no slash at the end; something without a host lower-cased."""
    x = unquoted(F.trim(x))
    named = F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    joined = F.regexp_replace(F.concat(F.lower(named), F.lit("/"), F.regexp_replace(path(x), "^/+|/+$", "")), "/{2,}", "/")
    return F.regexp_replace(F.when(named != "", joined).otherwise(F.lower(x)), "/+$", "")


def page_key(x: Column) -> Column:
    """A page's URL without fragment and slashes at the end, lower-cased."""
    return F.lower(F.regexp_replace(F.regexp_replace(x, "#.*$", ""), "/+$", ""))


def same_host(x: Column, allowed_host: str) -> Column:
    return F.lower(x).rlike("^https?://") & (host(x) == allowed_host.lower())


def source_id(x: Column) -> Column:
    """The slug of a site's host, without www."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host(x), r"^www\.", ""), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def namespace_name(x: Column) -> Column:
    return F.concat(F.lit("site-"), source_id(x), F.lit("-v1"))


def with_scheme_and_host(x: Column) -> Column:
    """Whether a base URL is http(s) with a host, without credentials, query or fragment."""
    return F.coalesce(x.rlike(r"^(?i:https?)://[^/?#@\s]+(/[^?#\s]*)?$"), F.lit(False))


def sitemap_seeds(base: Column) -> Column:
    """Where a site's sitemaps are looked for: robots.txt and two usual names."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.array(*[F.concat(root, F.lit(p)) for p in ("/robots.txt", "/sitemap.xml", "/sitemap_index.xml")])


def hosted_repository(x: Column) -> Column:
    """(owner, name) of a repository's https or ssh address on the usual host, a .git ending aside; null for others."""
    pattern = r"^(?:https?://(?:www\.)?github\.com/|git@github\.com:)([A-Za-z0-9][A-Za-z0-9-]{0,38})/([A-Za-z0-9._-]+?)(?:\.git)?/?$"
    owner, name = (F.regexp_extract(F.trim(x), pattern, i) for i in (1, 2))
    return F.when((owner != "") & ~name.isin("", ".", ".."), F.struct(owner.alias("owner"), name.alias("name")))
