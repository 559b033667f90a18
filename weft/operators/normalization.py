"""Row scalings of networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.missing import as_nan, col, finite


def norm(v: Column) -> Column:
    """Euclidean norm of an array column; missing cells make it NaN."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + as_nan(x) * as_nan(x)))


def normalize_networks(v: Column | str) -> Column:
    """Each row at norm 1; rows of norm 0 or not finite become zeros."""
    v = col(v)
    n = norm(v)
    return F.when((n > 0) & finite(n), F.transform(v, lambda x: as_nan(x) / n)).otherwise(F.transform(v, lambda x: F.lit(0.0)))


def scale_networks(df: DataFrame, name: str = "v") -> DataFrame:
    """All rows over the largest finite norm, found by one partial aggregate and
    brought in as a scalar subquery.  Without a positive norm nothing changes."""
    n = norm(F.col(name))
    top = df.agg(F.max(F.when(finite(n), n)).alias("top")).scalar()
    scaled = F.transform(F.col(name), lambda x: as_nan(x) / F.col("__top"))
    out = df.withColumn("__top", top).withColumn(name, F.when(F.col("__top") > 0, scaled).otherwise(F.col(name)))
    return out.drop("__top")
