"""A small diverse bank of passages for every namespace, and cards merged with what operators wrote by hand."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.functions.text import collapse_spaces, comparable, lexical_tokens

# Fixed values.
MOST, PASSAGE, HEADER = 8, 512, 120


def passage(title: Column, section: Column, content: Column) -> Column:
    """A routing passage of at most PASSAGE characters, or null without title or content."""
    title, section, body = F.substring(collapse_spaces(title), 1, HEADER), F.substring(collapse_spaces(section), 1, HEADER), collapse_spaces(content)
    head = F.concat(F.lit("Title: "), title, F.when(section != "", F.concat(F.lit("\nSection: "), section)).otherwise(""), F.lit("\n\nSource excerpt:\n"))
    return F.when((title != "") & (body != ""), F.rtrim(F.substring(F.concat(head, body), 1, PASSAGE)))


def _table(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read again, so that rounds don't pile up lineage."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token sets."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def select_prototypes(chunks: DataFrame, order: str, most: int = MOST) -> DataFrame:
    """(namespace, ordinal, url, order, passage): up to ``most`` passages of chunks(namespace, url, order, passage).

    Greedy: a document not used yet comes first, then the least overlap with what is selected, then source
    order.  Every round reduces each namespace to one row with min(), so its passages are never gathered; only
    keys, token hashes and the overlap so far go from round to round, passages are fetched for the winners.
    Passages equal in normal form count once, at their first place.
    """
    named = chunks.where("passage IS NOT NULL").withColumn("_key", comparable(F.col("passage"))).where("_key <> ''")
    first = _table(named.groupBy("namespace", "_key").agg(F.min(F.struct(order, "url", "passage")).alias("r")).select("namespace", "r.*"))
    hashes = F.transform(lexical_tokens(F.col("passage")), lambda t: F.xxhash64(t))
    left = first.select("namespace", order, "url", hashes.alias("_tokens"), F.lit(0.0).alias("_overlap"), F.lit(0).alias("_used"))
    out = None
    for ordinal in range(most):
        best = _table(left.groupBy("namespace").agg(F.min(F.struct("_used", "_overlap", order, "url", "_tokens")).alias("r")).select("namespace", "r.*"))
        if best.isEmpty():
            break
        taken = best.select("namespace", F.lit(ordinal).alias("ordinal"), "url", order)
        out = taken if out is None else out.unionByName(taken)
        if ordinal + 1 < most:
            last = best.select("namespace", F.col(order).alias("_o"), F.col("url").alias("_u"), F.col("_tokens").alias("_t"))
            left = left.join(last, "namespace").where((F.col(order) != F.col("_o")) | (F.col("url") != F.col("_u")))
            left = left.withColumn("_overlap", F.greatest("_overlap", overlap(F.col("_tokens"), F.col("_t")))).withColumn("_used", F.greatest("_used", (F.col("url") == F.col("_u")).cast("int")))
            left = _table(left.drop("_o", "_u", "_t"))
    if out is None:
        return first.limit(0).select("namespace", F.lit(0).alias("ordinal"), "url", order, "passage")
    return out.join(first, ["namespace", "url", order]).select("namespace", "ordinal", "url", order, "passage")


def merge_cards(existing: DataFrame, incoming: DataFrame, semantic: list[str], kept: list[str]) -> DataFrame:
    """incoming cards by namespace, with what must outlive an apply.

    ``kept`` columns (enabled, created_at) always stay as they were; the ``semantic`` ones stay where the
    existing card's semantic_origin is manual, which then stays too.  Cards that nothing comes in for are kept.
    """
    columns = [c for c in incoming.columns if c != "namespace"]
    old = existing.select("namespace", F.lit(True).alias("_had"), *[F.col(c).alias(f"_{c}") for c in columns])
    both = incoming.withColumn("_in", F.lit(True)).join(old, "namespace", "full_outer")
    manual = F.col("_semantic_origin") == "manual"

    def merged(c: str) -> Column:
        stays = F.col("_in").isNull()
        if c in kept:
            stays = stays | F.col("_had").isNotNull()
        if c in semantic or c == "semantic_origin":
            stays = stays | F.coalesce(manual, F.lit(False))
        return F.when(stays, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)

    return both.select("namespace", *map(merged, columns))


def cap_passages(passages: DataFrame, order: str, examples: int, most: int = MOST) -> DataFrame:
    """The first most - examples passages of each namespace."""
    nth = F.row_number().over(Window.partitionBy("namespace").orderBy(order))
    return passages.withColumn("_n", nth).where(F.col("_n") <= most - examples).drop("_n")
