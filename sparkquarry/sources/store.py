"""Several tables under one root that change together: a version lists the files of all of them, and one rename makes it current.

A table is cut into parts (a bucket, a namespace).  A writer stages the parts that it changes into folders of their own and commits
a version that names them; parts that it doesn't change keep the folders they have.  A reader opens the newest
version and sees all tables as that version has them.  Until the rename nothing is visible, and the rename fails
if another writer has taken the number: a crash or a conflict at any point leaves every table as it was.

The rename must be atomic and must not overwrite (HDFS and local folders; an object store needs a committer of its own).
Folders that no version names are left to ``unreferenced``.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(ValueError):
    """Another version is current than the one that a commit was made from."""


class Version:
    """One version of a store: its number, the folders of each part of each table, and a few notes (numbers, names) of its own."""

    def __init__(self, number: int = 0, tables: dict[str, dict[str, list[str]]] | None = None, notes: dict | None = None) -> None:
        self.number, self.tables, self.notes = number, tables or {}, notes or {}

    def folders(self, table: str, parts: list | None = None) -> list[str]:
        own = self.tables.get(table, {})
        return [f for part in sorted(own if parts is None else {str(p) for p in parts} & set(own)) for f in own[part]]

    def changed(self, table: str, parts: dict[str, list[str]], add: bool = False) -> Version:
        """The version with these parts in place of (or added to) those of the same name; a part without folders is gone."""
        own = dict(self.tables.get(table, {}))
        for part, folders in parts.items():
            own[part] = [*(own.get(part, []) if add else []), *folders]
        return Version(self.number, self.tables | {table: {p: f for p, f in own.items() if f}}, self.notes)

    def noted(self, **notes) -> Version:
        return Version(self.number, self.tables, self.notes | notes)


def _at(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _name(root: str, number: int) -> str:
    return f"{root}/_commits/{number:08d}.json"


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The versions that there are, in order."""
    pattern, fs = _at(spark, f"{root}/_commits/*.json")
    return sorted(int(f.getPath().getName()[:-5]) for f in fs.globStatus(pattern) or [])


def version(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """The newest version (number 0 and no tables where there is none), or the one of that number."""
    known = numbers(spark, root)
    if number is not None and number not in known:
        raise FileNotFoundError(f"{root} has no version {number}")
    if not known:
        return Version()
    number = known[-1] if number is None else number
    made = json.loads("\n".join(r[0] for r in spark.read.text(_name(root, number), wholetext=True).collect()))
    return Version(number, made["tables"], made["notes"])


def read(spark: SparkSession, root: str, at: Version, table: str, schema: T.StructType | str, parts: list | None = None) -> DataFrame:
    """A table as version ``at`` has it; of the parts only, if some are given.  No part, no rows."""
    folders = [f"{root}/{f}" for f in at.folders(table, parts)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def stage(df: DataFrame, root: str, part: Column, order: list[str] | None = None, spread: int = 1) -> dict[str, list[str]]:
    """Write df, cut by ``part`` (text or number), into a new folder: the folders of each part that has rows.

    A part is written by up to ``spread`` tasks; order: its rows' order in the files.
    """
    spark, name = df.sparkSession, f"data-{uuid.uuid4().hex}"
    dealt = df.withColumn("_part", part.cast("string"))
    dealt = dealt.repartition("_part", F.floor(F.rand(7) * spread)) if spread > 1 else dealt.repartition("_part")
    dealt.sortWithinPartitions("_part", *(order or [])).write.partitionBy("_part").parquet(f"{root}/{name}")
    pattern, fs = _at(spark, f"{root}/{name}/_part=*")
    found = [f.getPath().getName() for f in fs.globStatus(pattern) or []]
    return {f.removeprefix("_part="): [f"{name}/{f}"] for f in found}


def commit(spark: SparkSession, root: str, made: Version) -> Version:
    """Make ``made`` the next version after ``made.number``, the one that it was derived from; a Conflict if that isn't the newest any more."""
    known = numbers(spark, root)
    if (known[-1] if known else 0) != made.number:
        raise Conflict(f"version {known[-1] if known else 0} of {root} is current, not {made.number}")
    text = json.dumps({"tables": made.tables, "notes": made.notes}, sort_keys=True)
    waiting, fs = _at(spark, f"{root}/_commits/.{uuid.uuid4().hex}")
    out = fs.create(waiting, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(_name(root, made.number + 1))
    never = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    never[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(waiting.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(waiting), fs.makeQualified(target), never)
    except Py4JJavaError as e:
        fs.delete(waiting, False)
        raise Conflict(f"version {made.number + 1} of {root} was taken by another writer") from e
    return Version(made.number + 1, made.tables, made.notes)


def unreferenced(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Data folders that none of the newest ``keep`` versions names: what crashed or lost writers and older versions left."""
    used = {f.split("/")[0] for n in numbers(spark, root)[-keep:] for table in version(spark, root, n).tables.values() for folders in table.values() for f in folders}
    pattern, fs = _at(spark, f"{root}/data-*")
    return sorted(n for n in (f.getPath().getName() for f in fs.globStatus(pattern) or []) if n not in used)
