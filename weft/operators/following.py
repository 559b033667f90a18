"""Who follows whom: as-of matching of two point streams at shifted times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.missing import as_nan


def _matched(a: DataFrame, b: DataFrame, key: Sequence[str], lags: Sequence[float], t: str, order: str, x: str, y: str) -> DataFrame:
    """(key, lag, distance) for every row of a and lag with a match: the last row
    of b, in b's order, before the first one later than t - lag.

    Both streams are merged and sorted once by key; b's rows carry the largest
    time so far, which makes the search of an unsorted b a plain as-of match, and
    lags multiply only the rows of a."""
    seen = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.struct(as_nan(x).alias("x"), as_nan(y).alias("y"))
    right = b.select(*key, F.max(F.col(t).cast("double")).over(seen).alias("__t"), F.lit(0).alias("__side"), F.col(order).cast("double").alias("__ord"), mark.alias("__b"), F.lit(None).cast("double").alias("lag"), mark.alias("__p"))
    shifted = a.withColumn("lag", F.explode(F.array(*[F.lit(float(v)) for v in lags])))
    when = F.col(t).cast("double") - F.col("lag")
    left = shifted.select(*key, when.alias("__t"), F.lit(1).alias("__side"), F.col(order).cast("double").alias("__ord"), F.lit(None).cast(right.schema["__b"].dataType).alias("__b"), "lag", mark.alias("__p")).where(~F.isnan("__t") & F.col("__t").isNotNull())
    back = Window.partitionBy(*key).orderBy("__t", "__side", "__ord").rowsBetween(Window.unboundedPreceding, 0)
    both = right.union(left).withColumn("__m", F.last("__b", ignorenulls=True).over(back)).where("__side = 1 and __m is not null")
    gap = lambda c: F.col(f"__p.{c}") - F.col(f"__m.{c}")
    return both.select(*key, "lag", F.sqrt(gap("x") * gap("x") + gap("y") * gap("y")).alias("distance"))


def turn_lag(a: DataFrame, b: DataFrame, key: Sequence[str], lags: Sequence[float], t: str = "t", order: str = "ord", x: str = "x", y: str = "y") -> DataFrame:
    """(key, lag, mean_distance, valid_count) for every key of a and lag; lag > 0
    means that a follows b.  Without a match: 0.0 and 0."""
    sums = _matched(a, b, key, lags, t, order, x, y).groupBy(*key, "lag").agg(F.avg("distance").alias("m"), F.count("*").alias("n"))
    every = a.select(*key).distinct().withColumn("lag", F.explode(F.array(*[F.lit(float(v)) for v in lags])))
    return every.join(sums, [*key, "lag"], "left").select(*key, "lag", F.coalesce("m", F.lit(0.0)).alias("mean_distance"), F.coalesce("n", F.lit(0)).alias("valid_count"))


def best_turn_lag(a: DataFrame, b: DataFrame, key: Sequence[str], max_lag: int = 15, t: str = "t", order: str = "ord", x: str = "x", y: str = "y") -> DataFrame:
    """(key, best_lag, min_mean_distance): the lag of least mean distance, the
    smallest on ties; lags without matches or with NaN never win; 0 and 0.0 if
    none does."""
    k = max(1, int(max_lag))
    profile = turn_lag(a, b, key, range(-k, k + 1), t, order, x, y)
    fit = F.when((F.col("valid_count") > 0) & ~F.isnan("mean_distance"), F.struct("mean_distance", "lag"))
    best = profile.groupBy(*key).agg(F.min(fit).alias("w"))
    return best.select(*key, F.coalesce(F.col("w.lag"), F.lit(0.0)).cast("int").alias("best_lag"), F.coalesce(F.col("w.mean_distance"), F.lit(0.0)).alias("min_mean_distance"))
