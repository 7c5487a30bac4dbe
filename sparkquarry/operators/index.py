"""Index rows of chunks, offline embedding and scoring, judgment matching, and slots for every namespace."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkquarry.functions.text import collapse_spaces, lexical_tokens, sha256

# Fixed values.
DIMENSIONS, PREVIEW = 384, 240
CAPS = {"title": 512, "section": 1024, "location": 2048, "content": 8192}


def chunk_record(chunks: DataFrame) -> DataFrame:
    """chunks(content, tags, ...) with chunk_hash, a preview of PREVIEW characters and sorted distinct tags."""
    return chunks.withColumn("chunk_hash", sha256(F.col("content"))).withColumn("preview", F.substring("content", 1, PREVIEW)).withColumn("tags", F.array_sort(F.array_distinct("tags")))


def chunk_id(path: Column, index: Column, source_hash: Column, content: Column) -> Column:
    return F.concat(F.lit("jf_"), F.substring(sha256(F.concat_ws("\n", path, index.cast("string"), source_hash, sha256(content))), 1, 32))


def document_url(backend: str, source: str, doc_id: Column) -> Column:
    """backend://source/ and the percent-encoded id, with only letters, digits and _ . - ~ left as they are."""
    encoded = F.replace(F.replace(F.replace(F.url_encode(doc_id), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit(f"{backend}://{source}/"), encoded)


def row_key(row: Column) -> Column:
    """The first identity that a hit has: id, else url, section and content, else path and chunk, else title and content."""
    some = lambda *names: F.when(F.coalesce(row[names[0]], F.lit("")) != "", F.concat_ws("|", *[F.coalesce(row[n].cast("string"), F.lit("")) for n in names]))
    return F.coalesce(some("id"), some("url", "section_path", "content"), some("path", "chunk_index"), some("title", "content"))


def rerank_passage(title: Column, section: Column, location: Column, content: Column) -> Column:
    """Title, section and location lines and the content, each capped; blank parts are left out."""
    part = lambda label, x, cap: F.when(F.trim(x) != "", F.concat(F.lit(f"{label}: "), F.substring(x, 1, CAPS[cap])))
    return F.concat_ws("\n", part("Title", title, "title"), part("Section", section, "section"), part("Location", location, "location"), F.substring(content, 1, CAPS["content"]))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A deterministic stand-in for a text encoder: hashed words, signed, as a unit vector."""
    import zlib

    for series in texts:
        out = []
        for text in series:
            v = np.zeros(DIMENSIONS)
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                v[h % DIMENSIONS] += 1 if h >> 31 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32))
        yield pd.Series(out)


def overlap_score(query: Column, passage: Column) -> Column:
    """A stand-in for a cross-encoder: the share of the query's words that the passage has."""
    wanted = lexical_tokens(query)
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, lexical_tokens(passage))) / F.size(wanted)).otherwise(0.0)


def normal_section(x: Column) -> Column:
    return F.lower(collapse_spaces(F.coalesce(x, F.lit(""))))


def match_judgments(hits: DataFrame, judgments: DataFrame) -> DataFrame:
    """hits(query_id, rank, url, path, section) that meet judgments(query_id, judgment_id, url, path, section, grade) of their query.

    A judgment's url must contain the hit's or be contained, or its path be a suffix of the hit's path; a section
    that it names must contain the hit's or be contained.  Pairs form within a query only, between its few judgments and its ranked hits.
    """
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    theirs = judgments.select("query_id", "judgment_id", "grade", *[F.col(c).alias(f"_{c}") for c in ("url", "path", "section")])
    both = hits.join(theirs, "query_id")
    either = lambda a, b: F.contains(a, b) | F.contains(b, a)
    by_url = given("_url") & given("url") & either(F.lower("url"), F.lower("_url"))
    by_path = given("_path") & given("path") & ((F.col("path") == F.col("_path")) | F.endswith("path", F.concat(F.lit("/"), F.col("_path"))))
    by_section = ~given("_section") | either(normal_section(F.col("section")), normal_section(F.col("_section")))
    return both.where((by_url | by_path) & by_section).select("query_id", "rank", "judgment_id", "grade")


def credited(matches: DataFrame) -> DataFrame:
    """(query_id, judgment_id, grade, rank): every judgment at its best rank."""
    return matches.groupBy("query_id", "judgment_id").agg(F.max("grade").alias("grade"), F.min("rank").alias("rank"))


def cover_namespaces(hits: DataFrame, top: int) -> DataFrame:
    """The top hits of hits(query_id, namespace, key, rank) with one slot for each namespace that has any.

    The best hit of each of the first ``top`` namespaces is in; the other slots go by rank; ranks are dealt anew.
    """
    best = F.row_number().over(Window.partitionBy("query_id", "namespace").orderBy("rank", "key"))
    marked = hits.withColumn("_first", (best == 1).cast("int"))
    order = Window.partitionBy("query_id").orderBy(F.desc("_first"), "rank", "key")
    kept = marked.withColumn("_slot", F.row_number().over(order)).where(F.col("_slot") <= top)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "key"))).drop("_first", "_slot")


def ineligible(cards: DataFrame, region: str, model: str, precision: str, dims: int) -> DataFrame:
    """(namespace, reason): the first thing that rules a card out, null for eligible ones."""
    reason = (
        F.when(~F.col("enabled"), "disabled").when(F.col("region") != region, "region").when(F.col("model") != model, "model").when(F.col("precision") != precision, "precision").when(F.col("dims") != dims, "dimensions")
    )
    return cards.select("namespace", reason.alias("reason"))


def invalid_rows(rows: DataFrame) -> DataFrame:
    """(rule, rows) of rows(document_id, content) that a scan must not hand on: null, blank or repeated ids, blank content."""
    blank = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("")) == ""
    rules = {"id missing": F.col("document_id").isNull(), "id blank": F.col("document_id").isNotNull() & blank("document_id"), "content blank": blank("content")}
    broken = rows.select(F.explode(F.array_compact(F.array(*[F.when(x, F.lit(name)) for name, x in rules.items()]))).alias("rule"))
    repeated = rows.where("document_id IS NOT NULL").groupBy("document_id").count().where("count > 1").select(F.lit("id repeated").alias("rule"))
    return broken.unionByName(repeated).groupBy("rule").agg(F.count("*").alias("rows"))


def same_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys, with their number, that only one side has."""
    a, b = (x.groupBy(key).count() for x in (left, right))
    return a.exceptAll(b).select(key, F.lit("left").alias("side")).unionByName(b.exceptAll(a).select(key, F.lit("right").alias("side")))


def combined_counters(*parts: DataFrame) -> DataFrame:
    """(key, value): the sum of counters(key, value) by key."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("key").agg(F.sum("value").alias("value"))
