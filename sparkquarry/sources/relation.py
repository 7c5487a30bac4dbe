"""A table or view as a source of documents: id, content and title as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.functions.text import is_blank


def resolve(df: DataFrame, name: str) -> Column:
    """A column by name, regardless of case; an exact match wins, and two inexact ones are an error."""
    exact = [c for c in df.columns if c == name]
    found = exact or [c for c in df.columns if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"column {name!r} is {'missing' if not found else 'ambiguous'}; there are {df.columns}")
    return df[f"`{found[0]}`"]


def converted(df: DataFrame, id_column: str, content_column: str, title_column: str | None = None) -> DataFrame:
    """document_id, content, title as text; the title falls back to the id where it is blank."""
    doc_id = resolve(df, id_column).cast("string")
    title = resolve(df, title_column).cast("string") if title_column else F.lit(None).cast("string")
    return df.select(doc_id.alias("document_id"), resolve(df, content_column).cast("string").alias("content"), F.when(is_blank(title), doc_id).otherwise(title).alias("title"))


def scan(df: DataFrame, id_column: str, content_column: str, title_column: str | None = None, max_documents: int | None = None) -> DataFrame:
    """Documents with content, in order of id as text where a cap is given."""
    docs = converted(df, id_column, content_column, title_column).where(~is_blank(F.col("content")))
    return docs if max_documents is None else docs.orderBy("document_id").limit(max_documents)


def scan_summary(df: DataFrame, id_column: str, content_column: str, max_documents: int | None = None) -> DataFrame:
    """One row: rows_discovered, null_ids, blank_ids, skipped_empty, skipped_limit."""
    docs = converted(df, id_column, content_column)
    count = lambda x: F.coalesce(F.sum(F.when(x, 1).otherwise(0)), F.lit(0)).cast("long")
    out = docs.agg(
        F.count("*").alias("rows_discovered"),
        count(F.col("document_id").isNull()).alias("null_ids"),
        count(F.col("document_id").isNotNull() & is_blank(F.col("document_id"))).alias("blank_ids"),
        count(is_blank(F.col("content"))).alias("skipped_empty"),
    )
    kept = F.col("rows_discovered") - F.col("skipped_empty")
    return out.withColumn("skipped_limit", (F.greatest(kept - max_documents, F.lit(0)) if max_documents is not None else F.lit(0)).cast("long"))


def duplicate_ids(df: DataFrame, id_column: str) -> DataFrame:
    """(document_id, copies) of ids that occur more than once."""
    return df.groupBy(resolve(df, id_column).cast("string").alias("document_id")).agg(F.count("*").alias("copies")).where("copies > 1")


def dealt(df: DataFrame) -> DataFrame:
    """df, over as many parts as there are cores where it comes in fewer (a small file of one row group)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative_path, raw) of every *.md below root."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    full = F.col("_metadata.file_path")
    return files.select(full.alias("path"), F.regexp_replace(full, r"^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "").alias("relative_path"), F.col("value").alias("raw"))


def read_repository(spark: SparkSession, root: str, max_bytes: int = 50 * 1024, glob: str = "*") -> DataFrame:
    """(path, size, text) of text files of at most max_bytes: no NUL byte in the first 8,192 bytes and valid UTF-8 all through, so that text is exact."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).where(F.col("length") <= max_bytes)
    head = F.substring("content", 1, 8192)
    text = F.regexp_replace(F.try_validate_utf8(F.decode("content", "UTF-8")), "\r\n?", "\n")
    return files.where((F.locate("00", F.regexp_replace(F.hex(head), "(..)", "$1 ")) == 0) & F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.col("length").alias("size"), text.alias("text"))


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Graded cases from a JSON list or {"cases": [...]}, one row a case."""
    schema = "id string, question string, expected_urls array<string>, expected_topics array<string>, judgments array<struct<grade:int,repo_path:string,url:string,section_path:string,reason:string>>"
    raw = spark.read.text(path, wholetext=True).select("value")
    listed = F.from_json("value", f"array<struct<{schema.replace(' string', ':string').replace(' array', ':array')}>>")
    nested = F.from_json("value", f"struct<cases:array<struct<{schema.replace(' string', ':string').replace(' array', ':array')}>>>")["cases"]
    return raw.select(F.explode(F.when(F.startswith(F.trim("value"), F.lit("[")), listed).otherwise(nested)).alias("c")).select("c.*")


def tree_entries(df: DataFrame, column: str) -> DataFrame:
    """(mode, kind, object_id, size, path) of NUL-framed ``ls-tree -lz`` output; malformed entries have a null path."""
    entry = r"^(\d{6}) (blob|tree|commit) ([0-9a-f]{40,64}) +(\d+|-)\t(.+)$"
    rows = df.select(F.explode(F.split(column, "\\x00")).alias("entry")).where("entry <> ''")
    part = lambda i: F.regexp_extract("entry", entry, i)
    return rows.select(part(1).alias("mode"), part(2).alias("kind"), part(3).alias("object_id"), part(4).try_cast("long").alias("size"), F.nullif(part(5), F.lit("")).alias("path"))


def robots_sitemaps(df: DataFrame, column: str) -> DataFrame:
    """(sitemap) named in robots.txt bodies, distinct."""
    found = F.regexp_extract_all(F.col(column), F.lit(r"(?mi)^\s*sitemap\s*:\s*(\S+)"), F.lit(1))
    return df.select(F.explode(found).alias("sitemap")).distinct()


def sitemap_locations(df: DataFrame, column: str) -> DataFrame:
    """(kind, location): page for a urlset's, sitemap for an index's <loc> values."""
    kind = F.when(F.regexp_like(F.col(column), F.lit(r"<(\w+:)?sitemapindex[\s>]")), "sitemap").otherwise("page")
    locations = F.regexp_extract_all(F.col(column), F.lit(r"<(?:\w+:)?loc>\s*([^<]*?)\s*</(?:\w+:)?loc>"), F.lit(1))
    return df.select(kind.alias("kind"), F.explode(locations).alias("location"))
