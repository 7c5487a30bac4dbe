"""Crawled pages: title and text, unique merge, locale and version analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.functions import urls
from sparkquarry.functions.text import collapse_spaces

# When a locale family or a version family counts as detected.
MIN_FOREIGN_URLS, MIN_UNPREFIXED_URLS, MIN_FOREIGN_LOCALES, MIN_OVERLAP = 20, 10, 2, 5
MIN_VERSIONS, MIN_VERSION_URLS = 3, 30
CURRENT_VERSIONS, PREVIEW_VERSIONS = ["latest", "current", "stable"], ["nightly", "main", "master", "dev", "snapshot"]


def unescape(x: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def html_title(html: Column, url: Column) -> Column:
    """<title>, else the first <h1>, else the URL."""
    inside = lambda tag: F.nullif(collapse_spaces(unescape(F.regexp_replace(F.regexp_extract(html, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", ""))), F.lit(""))
    return F.coalesce(inside("title"), inside("h1"), url)


def html_text(html: Column) -> Column:
    """Main text: scripts, styles, comments and navigation dropped, block tags as newlines, other tags gone."""
    x = F.regexp_replace(html, r"(?is)<(script|style|nav|noscript|head)\b.*?</\1>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?i)</?(p|div|h[1-6]|li|ul|ol|tr|table|section|article|br|pre|blockquote)\b[^>]*>", "\n")
    x = unescape(F.regexp_replace(x, r"<[^>]*>", ""))
    x = F.regexp_replace(F.regexp_replace(x, r"[ \t\r]+", " "), r"\s*\n\s*", "\n")
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def merge_unique(pages: DataFrame, order: list[str]) -> DataFrame:
    """pages with canonical_url, the first by ``order`` of each canonical URL."""
    pages = pages.withColumn("canonical_url", urls.canonical(F.col("url")))
    return pages.withColumn("_n", F.row_number().over(Window.partitionBy("canonical_url").orderBy(*order))).where("_n = 1").drop("_n")


def locales(pages: DataFrame) -> DataFrame:
    """(prefix, urls, tail_overlap) of each locale prefix; prefix '' is unprefixed; overlap counts distinct tails that English or unprefixed URLs have too."""
    url = F.col("url")
    rows = pages.select(F.coalesce(urls.language_prefix(url), F.lit("")).alias("prefix"), urls.tail_path(url).alias("tail"))
    english = (F.col("prefix") == "") | (F.substring("prefix", 1, 2) == "en")
    base = rows.where(english).select("tail").distinct().withColumn("shared", F.lit(1))
    tails = rows.groupBy("prefix", "tail").agg(F.count("*").alias("n")).join(base, "tail", "left")
    return tails.groupBy("prefix").agg(F.sum("n").alias("urls"), F.coalesce(F.sum("shared"), F.lit(0)).alias("tail_overlap"))


def locale_report(pages: DataFrame) -> DataFrame:
    """One row: foreign_locales, foreign_urls, unprefixed_urls, english_locales, detected."""
    per = locales(pages)
    english = (F.col("prefix") != "") & (F.substring("prefix", 1, 2) == "en")
    foreign = (F.col("prefix") != "") & ~english
    count = lambda x, what: F.coalesce(F.sum(F.when(x, what).otherwise(0)), F.lit(0)).cast("long")
    out = per.agg(
        count(foreign, F.lit(1)).alias("foreign_locales"), count(foreign, F.col("urls")).alias("foreign_urls"), count(F.col("prefix") == "", F.col("urls")).alias("unprefixed_urls"),
        count(english, F.lit(1)).alias("english_locales"), F.coalesce(F.max(F.when(foreign, F.col("tail_overlap"))), F.lit(0)).alias("_overlap"),
    )
    family = (F.col("foreign_locales") >= MIN_FOREIGN_LOCALES) | (F.col("_overlap") >= MIN_OVERLAP)
    has_english = (F.col("english_locales") > 0) | (F.col("unprefixed_urls") >= MIN_UNPREFIXED_URLS)
    detected = (F.col("foreign_locales") > 0) & has_english & (F.col("foreign_urls") >= MIN_FOREIGN_URLS) & family
    return out.withColumn("detected", detected).drop("_overlap")


def versions(pages: DataFrame) -> DataFrame:
    """(root_path, version, kind, urls) of the first segment of each path, after a first one, that names a version.

    kind: current or preview (by name) or semver.
    """
    kind = lambda s: F.when(F.lower(s).isin(CURRENT_VERSIONS), "current").when(F.lower(s).isin(PREVIEW_VERSIONS), "preview").when(urls.version_key(F.lower(s)).isNotNull(), "semver")
    parts = urls.segments(F.col("url"))
    at = F.array_position(F.transform(parts, lambda s, i: (i > 0) & kind(s).isNotNull()), F.lit(True)).cast("int")
    rows = pages.select("url", parts.alias("parts"), at.alias("at")).where("at > 1").distinct()
    root = F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), F.greatest(F.col("at") - 1, F.lit(0))), "/"))
    named = rows.select(root.alias("root_path"), F.element_at("parts", F.col("at")).alias("version"))
    return named.groupBy("root_path", "version", kind(F.col("version")).alias("kind")).agg(F.count("*").alias("urls"))


def version_family(pages: DataFrame) -> DataFrame:
    """The versioned root with most URLs among those with MIN_VERSIONS versions and MIN_VERSION_URLS URLs: (root_path, versions, urls, latest)."""
    per = versions(pages).withColumn("key", urls.version_key(F.lower("version")))
    roots = per.groupBy("root_path").agg(F.count("*").alias("versions"), F.sum("urls").alias("urls"), F.max_by("version", F.col("key")).alias("latest"))
    return roots.where((F.col("versions") >= MIN_VERSIONS) & (F.col("urls") >= MIN_VERSION_URLS)).orderBy(F.desc("urls"), F.desc("versions"), "root_path").limit(1)


def selected_versions(per: DataFrame, policy: str) -> DataFrame:
    """(root_path, version) to keep of versions(): stable-latest, latest or latest-nightly; a name stands in where there is no number, and the other way round."""
    key = urls.version_key(F.lower("version"))
    stable = F.struct(key.alias("key"), "version")
    one = per.groupBy("root_path").agg(
        F.max(F.when(F.col("kind") == "semver", stable))["version"].alias("stable"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "current", F.col("version")))).alias("current"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "preview", F.col("version")))).alias("preview"),
    )  # at most a few names a root
    first = lambda c: F.slice(c, 1, 1)
    numbered = F.array_compact(F.array("stable"))
    some = lambda *options: F.coalesce(*[F.when(F.size(o) > 0, o) for o in options])
    chosen = {
        "stable-latest": some(numbered, first(F.col("current")), first(F.col("preview"))),
        "latest": some(F.col("current"), numbered, first(F.col("preview"))),
        "latest-nightly": some(F.concat("current", "preview"), numbered),
    }[policy]
    return one.select("root_path", F.explode(chosen).alias("version"))


def apply_version_policy(pages: DataFrame, policy: str) -> DataFrame:
    """pages without those below another version of a root than the policy selects; roots with one version stay as they are."""
    if policy == "all":
        return pages
    per = versions(pages)
    several = per.groupBy("root_path").agg(F.count("*").alias("n")).where("n > 1").select("root_path")
    gone = per.join(several, "root_path", "left_semi").join(selected_versions(per, policy), ["root_path", "version"], "left_anti")
    under = F.concat("root_path", F.lit("/"), "version")
    parts = urls.segments(F.col("url"))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    met = pages.select("url", F.explode(prefixes).alias("prefix")).join(gone.select(under.alias("prefix")), "prefix", "left_semi").select("url").distinct()
    return pages.join(met, "url", "left_anti")


def apply_language_policy(pages: DataFrame, policy: str) -> DataFrame:
    """pages without foreign locales (policy ``english``), where locale_report detects a family of them."""
    if policy == "all":
        return pages
    report = locale_report(pages).select("detected")
    prefix = urls.language_prefix(F.col("url"))
    foreign = prefix.isNotNull() & (F.substring(prefix, 1, 2) != "en")
    return pages.crossJoin(F.broadcast(report)).where(~(F.col("detected") & foreign)).drop("detected")  # one row
