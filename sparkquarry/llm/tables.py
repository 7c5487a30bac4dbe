"""Where the operators of this subpackage read their input and keep intermediate tables."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.llm import textkit


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one in fewer parts than there are cores (a small file of one row group) is dealt over all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df if name != "documents" or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that driver and executors share; one of our own only where it is unset and the master is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_runs = threading.local()  # each thread's open scratch blocks


def cut(df: DataFrame, keep: bool = False, outer: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: short lineage that outlives lost executors.

    Inside ``scratch`` the table lasts as long as the block, or the one around it (outer), unless it is to be kept.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    blocks = getattr(_runs, "open", [])
    if len(blocks) > outer and not keep:
        blocks[-1 - outer].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gather(spark: SparkSession, frames: Iterable[DataFrame], schema: str) -> DataFrame:
    """One table of all frames, each written as it comes; it lasts as long as one of ``cut``."""
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    if getattr(_runs, "open", None):
        _runs.open[-1].append(path)
    spark.createDataFrame([], schema).write.parquet(path)
    for df in frames:
        df.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables cut inside the block are deleted after it; write what should last with ``cut(df, keep=True)``."""
    mine: list[str] = []
    _runs.open = [*getattr(_runs, "open", []), mine]
    try:
        yield
    finally:
        _runs.open.pop()
        for name in mine:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it is written, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was) if was is not None else spark.conf.unset(name)


def by_slice(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | list[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over slices of bounded text size; df needs a column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textkit.slices(batch):
                yield from work(part)

    return df.mapInArrow(run, schema)


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds
