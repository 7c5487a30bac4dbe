"""Tables that are written whole and switched at once, and an index partitioned by namespace."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df, if its columns have exactly these names, types and order; otherwise a ValueError that names the difference."""
    have, want = ([(f.name, f.dataType.simpleString()) for f in s.fields] for s in (df.schema, schema))
    if have != want:
        raise ValueError(f"columns differ: missing {[w for w in want if w not in have]}, unexpected {[h for h in have if h not in want]}")
    return df


def _folder(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, root: str) -> list[int]:
    pattern, fs = _folder(spark, f"{root}/_versions/*")
    return sorted(int(f.getPath().getName()) for f in fs.globStatus(pattern) or [])


def publish(df: DataFrame, root: str, expected: int | None = None) -> int:
    """Write df into a folder of its own, then claim the next version for it; readers see whole versions only.

    expected: the version that df was derived from.  Another current version, or another writer that claims
    the number first (the marker is created exclusively), is a conflict (ValueError).
    """
    spark = df.sparkSession
    done = _versions(spark, root)
    current = done[-1] if done else 0
    if expected is not None and expected != current:
        raise ValueError(f"version {current} is current, not {expected}")
    name = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    marker, fs = _folder(spark, f"{root}/_versions/{current + 1:08d}")
    try:
        out = fs.create(marker, False)
    except Py4JJavaError as e:
        raise ValueError(f"version {current + 1} was published by another writer") from e
    out.writeUTF(name)
    out.close()
    return current + 1


def current_version(spark: SparkSession, root: str) -> int:
    """The number of the newest version, 0 where there is none."""
    done = _versions(spark, root)
    return done[-1] if done else 0


def read_current(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """The newest version, with the exact schema if one is given."""
    done = _versions(spark, root)
    if not done:
        raise FileNotFoundError(f"no complete version under {root}")
    marker, fs = _folder(spark, f"{root}/_versions/{done[-1]:08d}")
    stream = fs.open(marker)
    name = stream.readUTF()
    stream.close()
    df = spark.read.parquet(f"{root}/{name}")
    return require_schema(df, schema) if schema else df


def write_index(rows: DataFrame, root: str) -> None:
    """rows(namespace, id, ...) into an index partitioned by namespace; namespaces that rows don't have stay as they are."""
    spark = rows.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.repartition("namespace", F.pmod(F.xxhash64("id"), F.lit(64))).write.mode("overwrite").partitionBy("namespace").parquet(root)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def upsert(stored: DataFrame, rows: DataFrame, deleted: DataFrame, key: str = "id") -> DataFrame:
    """stored with rows put in by key and the deleted keys gone."""
    gone = rows.select(key).unionByName(deleted.select(key)).distinct()
    return stored.join(gone, key, "left_anti").unionByName(rows)


def json_string(x: Column) -> Column:
    """x as a JSON string, null as an empty one."""
    whole = F.to_json(F.struct(F.coalesce(x, F.lit("")).alias("v")))
    return F.substring(whole, 6, F.length(whole) - 6)


def as_markdown(pages: DataFrame) -> DataFrame:
    """(file, raw) of pages(url, title, content): front matter of JSON strings, as chunking.front_matter reads it, and a name derived from the URL."""
    name = F.concat(F.lit("document-"), F.substring(F.sha2("url", 256), 1, 24), F.lit(".md"))
    raw = F.concat(F.lit("---\ntitle: "), json_string(F.col("title")), F.lit("\nurl: "), json_string(F.col("url")), F.lit("\n---\n\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
    return pages.select(name.alias("file"), raw.alias("raw"))
