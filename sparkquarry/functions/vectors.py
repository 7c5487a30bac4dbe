"""Vector expressions over array columns; sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a over its norm, null for none; the norm is an element of its own, since a lambda computes all it names for every element."""
    return F.get(F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))), 0)


def is_unit(a: Column, size: int, tolerance: float = 1e-4) -> Column:
    """size finite numbers with norm one."""
    finite = F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(a) == size) & finite & (F.abs(norm(a) - 1) <= tolerance), F.lit(False))


def mean_by(df, key: str, vector: str):
    """(key, vector): the normalised component mean of each group."""
    parts = df.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("xs"))
    return whole.select(key, unit(F.transform("xs", lambda s: s["x"])).alias(vector))
