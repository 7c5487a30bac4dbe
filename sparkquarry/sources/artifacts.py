"""Strict reading of JSON artifacts: cases, canary packs, labels, calibrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What graded cases, routing cases, evidence labels and calibrations hold.
EVAL_CASE = "id string, question string, judgments array<struct<grade:int,namespace:string,url:string,group:string>>"
ROUTING_CASE = "id string, question string, split string, role string, expected array<string>"
EVIDENCE_LABEL = "case_id string, answerable boolean, reviewer string, reviewed_at string"
CALIBRATION = "mode string, score_floor double, margin_floor double, catalog_sha256 string, namespaces array<string>"


def elements(raw: DataFrame, column: str = "value", under: str = "cases") -> DataFrame:
    """(element): the JSON texts of a list, of the list under a name of an object, or of an object itself."""
    text = F.trim(F.col(column))
    listed = F.from_json(text, "array<string>")
    nested = F.from_json(F.get_json_object(text, f"$.{under}"), "array<string>")
    return raw.select(F.explode(F.when(F.startswith(text, F.lit("[")), listed).otherwise(F.coalesce(nested, F.array(text)))).alias("element"))


def checked(rows: DataFrame, schema: str, required: list[str], element: str = "element") -> DataFrame:
    """The fields of each JSON text, with ``problems``: no object, names unknown, repeated or missing, values that don't fit their type."""
    fields = T.StructType.fromDDL(schema)
    names = F.array(*[F.lit(f.name) for f in fields])
    keys = F.coalesce(F.json_object_keys(element), F.array().cast("array<string>"))
    whole = F.json_object_keys(element).isNotNull()
    value = F.from_json(element, fields)
    listed = lambda label, x: F.when(F.size(x) > 0, F.concat(F.lit(f"{label}: "), F.array_join(x, ", ")))
    absent = F.filter(F.array(*map(F.lit, required)), lambda n: ~F.array_contains(keys, n))
    misfit = F.array_compact(F.array(*[F.when(F.get_json_object(element, f"$.{f.name}").isNotNull() & value[f.name].isNull(), f.name) for f in fields]))
    repeated = F.filter(F.array_distinct(keys), lambda k: F.size(F.filter(keys, lambda x: x == k)) > 1)
    problems = F.when(~whole, F.array(F.lit("no object"))).otherwise(F.array_compact(F.array(listed("unknown", F.array_except(keys, names)), listed("repeated", repeated), listed("missing", absent), listed("misfit", misfit))))
    return rows.select("*", value.alias("_v"), problems.alias("problems")).select(*rows.columns, "_v.*", "problems")


def unique(rows: DataFrame, key: str) -> DataFrame:
    """rows with a problem more where their key is repeated."""
    several = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1")
    both = rows.join(several, F.col(key) == F.col("_key"), "left")
    return both.withColumn("problems", F.when(F.col("_n").isNotNull(), F.array_append("problems", F.concat(F.lit(f"repeated {key}: "), F.col(key)))).otherwise(F.col("problems"))).drop("_key", "_n")


def read_strict(spark: SparkSession, path: str, schema: str, required: list[str], key: str | None = None, shown: int = 20) -> DataFrame:
    """The rows of an artifact; a ValueError that names the first problems if there is any."""
    rows = checked(elements(spark.read.text(path, wholetext=True)), schema, required)
    rows = unique(rows, key) if key else rows
    bad = rows.where(F.size("problems") > 0).select(F.explode("problems").alias("p")).limit(shown).collect()
    if bad:
        raise ValueError("; ".join(r["p"] for r in bad))
    return rows.drop("element", "problems")


def gate_cases(cases: DataFrame) -> DataFrame:
    """The cases that certify; the others calibrate."""
    return cases.where(F.col("split") == "gate")


def routes_of_categories(cases: DataFrame, roles: dict[str, str], prefix: str) -> DataFrame:
    """cases(id, category, ...) with the role of their category and prefixed ids; other categories go."""
    role: Column = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])
    return cases.select(F.concat(F.lit(prefix), "id").alias("id"), F.try_element_at(role, F.col("category")).alias("role"), *[c for c in cases.columns if c not in ("id", "category")]).where("role IS NOT NULL")
