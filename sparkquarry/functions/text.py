"""Text expressions: every function takes and returns Columns, so they stay inside generated code."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the data model.
TOKEN = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*|[^\s]"
IDENTIFIER = r"[A-Z]+(?=[A-Z][a-z]|\d|$)|[A-Z]?[a-z]+|\d+"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9\[])"
KNOWN_DOC_KINDS = [
    "blog", "library", "integrations", "integration", "platform", "solutions", "solution", "resources", "events-and-webinars", "newsroom", "customers", "customer", "thank-you",
]
DOC_KIND_ALIASES = {"integration": "integrations", "solution": "solutions", "customer": "customers"}


def text_or_empty(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def is_blank(x: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit("")) == ""


def collapse_spaces(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def token_count(x: Column) -> Column:
    """Words (with inner - and ') and single other characters."""
    return F.regexp_count(x, F.lit(TOKEN))


def identifier_tokens(x: Column) -> Column:
    """Distinct camel-case and number parts in order, lower-cased."""
    parts = F.flatten(F.transform(F.split(x, "[^A-Za-z0-9]+"), lambda t: F.regexp_extract_all(t, F.lit(IDENTIFIER), F.lit(0))))
    return F.array_distinct(F.transform(parts, F.lower))


def lexical_tokens(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda t: t != ""))


def sentences(x: Column) -> Column:
    return F.filter(F.split(collapse_spaces(x), SENTENCE_END), lambda s: s != "")


def comparable(x: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as single spaces."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def slug(x: Column) -> Column:
    x = F.regexp_replace(F.lower(F.trim(x)), r"\.md$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[^a-z0-9-]+", "-"), "-+", "-"), "^-|-$", "")


def safe_slug(x: Column, fallback: str = "page", limit: int = 80) -> Column:
    made = F.substring(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, limit)
    return F.when(F.coalesce(made, F.lit("")) == "", fallback).otherwise(made)


def plain_inline(x: Column) -> Column:
    """Markdown images and links as their text, emphasis marks gone, single spaces."""
    x = F.regexp_replace(x, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    x = F.regexp_replace(x, r"\[([^\]]+)\]\([^)]*\)", "$1")
    return collapse_spaces(F.regexp_replace(x, "[*_`~]", ""))


def without_controls(x: Column) -> Column:
    return F.regexp_replace(x, r"[\p{Cc}&&[^\n\r\t]]", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1))


def title_from_path(path: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(file_stem(path), "[_-]+", " ")))


def doc_kind(segments: Column) -> Column:
    """The first known kind among slugged URL segments, aliases folded; page otherwise."""
    alias = F.create_map(*[F.lit(x) for pair in DOC_KIND_ALIASES.items() for x in pair])
    known = F.filter(segments, lambda s: s.isin(KNOWN_DOC_KINDS))
    first = F.try_element_at(known, F.lit(1))
    return F.coalesce(F.try_element_at(alias, first), first, F.lit("page"))


def sha256(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def embedding_text(title: Column, section: Column, content: Column) -> Column:
    """Title, section and content as blocks; blank parts are left out."""
    return F.concat_ws(
        "\n\n",
        F.when(~is_blank(title), F.concat(F.lit("Title: "), title)),
        F.when(~is_blank(section), F.concat(F.lit("Section: "), section)),
        content,
    )


def excerpt(x: Column, limit: int = 320) -> Column:
    """Single-spaced text cut at a word boundary with '...' if it is longer than limit."""
    flat = collapse_spaces(x)
    head = F.substring(flat, 1, limit - 3)
    cut = F.when(F.substring(flat, limit - 2, 1) == " ", head).otherwise(F.regexp_replace(head, r"\s+\S*$", ""))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(cut), F.lit("...")))


@F.pandas_udf(T.StringType())
def compatible_fold(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC form, case-folded, runs of anything but letters and digits as single spaces (Spark has no NFKC of its own)."""
    mark = re.compile(r"[\W_]+")
    for series in texts:
        yield series.map(lambda t: None if t is None else mark.sub(" ", unicodedata.normalize("NFKC", t).casefold()).strip())
