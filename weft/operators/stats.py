"""Group statistics over points in long form (keys, dim, value).

Moments are one partial aggregate.  Order statistics and ranks work on counts of
distinct values (pre-aggregated before the shuffle) with running sums, which
spill, instead of holding a group's values in memory.  Special functions run on
one row for each group and dimension.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import special
from weft.functions.missing import INF, NAN, as_nan, as_null, finite


def center_points(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Columns minus their means, over all rows or by group."""
    means = [F.avg(as_nan(c)).alias(f"__m_{c}") for c in cols]
    if by:
        out = df.join(df.groupBy(*by).agg(*means), list(by))
    else:
        mean = df.agg(F.struct(*means).alias("m")).scalar()
        out = df.withColumn("__m", mean).select("*", *[F.col(f"__m.__m_{c}") for c in cols]).drop("__m")
    return out.withColumns({c: as_nan(c) - F.col(f"__m_{c}") for c in cols}).drop(*[f"__m_{c}" for c in cols])


def center_long(df: DataFrame, dim: str = "dim", value: str = "value") -> DataFrame:
    """Long form: each value minus its dimension's mean."""
    means = df.groupBy(dim).agg(F.avg(as_nan(value)).alias("__m"))
    return df.join(means, dim).withColumn(value, as_nan(value) - F.col("__m")).drop("__m")


def quantiles(df: DataFrame, keys: Sequence[str], probs: dict[str, float], value: str = "value") -> DataFrame:
    """(keys, a column for each name in probs): type-7 quantiles; missing values
    are left out."""
    counts = df.where(as_null(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    order = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    ranked = counts.withColumns({"__to": F.sum("__n").over(order), "__all": F.sum("__n").over(whole)})

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("__to") - F.col("__n")) & (rank < F.col("__to")), F.col("__v")))

    out = []
    for name, p in probs.items():
        h = (F.col("__all") - 1) * F.lit(float(p))
        out += [at(F.floor(h)).alias(f"__lo_{name}"), at(F.ceil(h)).alias(f"__hi_{name}"), F.max(h - F.floor(h)).alias(f"__f_{name}")]
    got = ranked.groupBy(*keys).agg(*out)
    return got.select(*keys, *[(F.col(f"__lo_{n}") + F.col(f"__f_{n}") * (F.col(f"__hi_{n}") - F.col(f"__lo_{n}"))).alias(n) for n in probs])


def iqr(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return quantiles(df, keys, {"q1": 0.25, "q3": 0.75}, value).withColumn("iqr", F.col("q3") - F.col("q1"))


def mean_ci(df: DataFrame, keys: Sequence[str], value: str = "value", conf_level: float = 0.95) -> DataFrame:
    """(keys, n, mean, lo, hi) with the t interval; one value gives infinite
    ends, no value (only without keys) NaN."""
    v = as_nan(value)
    sums = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    point = special.t_quantile(F.lit(1 - (1 - conf_level) / 2), F.greatest(F.col("n") - 1, F.lit(1)).cast("double"))
    half = F.when(F.col("n") == 1, INF).otherwise(F.col("point") * F.col("sd") / F.sqrt(F.col("n").cast("double")))
    out = sums.withColumn("point", point).withColumn("half", half)
    nan = lambda c: F.when(F.col("n") == 0, NAN).otherwise(c)
    return out.select(*keys, "n", nan(F.col("mean")).alias("mean"), nan(F.when(F.col("n") == 1, -INF).otherwise(F.col("mean") - F.col("half"))).alias("lo"), nan(F.when(F.col("n") == 1, INF).otherwise(F.col("mean") + F.col("half"))).alias("hi"))


def outlier_ci(df: DataFrame, keys: Sequence[str], value: str = "value", iqr_factor: float = 1.5) -> DataFrame:
    """(keys, lo, hi): minus and plus iqr_factor interquartile ranges around 0,
    not around the median."""
    spread = F.col("iqr") * F.lit(float(iqr_factor))
    return iqr(df, keys, value).select(*keys, (-spread).alias("lo"), spread.alias("hi"))


def rank_sums(df: DataFrame, dim: str, value: str, first: Column) -> DataFrame:
    """(dim, n1, n2, U, z, tied): the rank-sum test of rows where first is true
    against the others, average ranks, z with continuity correction."""
    counts = df.where(as_null(value).isNotNull()).groupBy(dim, F.col(value).cast("double").alias("v")).agg(F.sum(F.when(first, 1).otherwise(0)).alias("a"), F.count("*").alias("n"))
    before = Window.partitionBy(dim).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("rank", F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2)
    n = F.col("n").cast("double")
    sums = ranked.groupBy(dim).agg(F.sum("a").cast("double").alias("n1"), F.sum(F.col("n") - F.col("a")).cast("double").alias("n2"), F.sum(F.col("a") * F.col("rank")).alias("w"), F.sum(n * n * n - n).alias("tied"))
    both = F.col("n1") + F.col("n2")
    mid = F.col("n1") * F.col("n2") / 2
    out = sums.withColumn("U", F.col("w") - F.col("n1") * (F.col("n1") + 1) / 2)
    spread = F.when(both > 1, F.col("n1") * F.col("n2") / 12 * ((both + 1) - F.col("tied") / F.greatest(both * (both - 1), F.lit(1.0)))).otherwise(0.0)
    gap = F.greatest(F.abs(F.col("U") - mid) - 0.5, F.lit(0.0))
    return out.withColumn("spread", spread).select(dim, "n1", "n2", "U", F.when(F.col("spread") > 0, gap / F.sqrt(F.greatest(F.col("spread"), F.lit(1e-300)))).alias("z"), "tied", (F.col("U") == mid).alias("level"))


def wilcox_ranksum(df: DataFrame, dim: str, value: str, first: Column) -> DataFrame:
    """(dim, U, pvalue_u): p by the normal approximation; NaN if a group is
    empty, and 1 or 0 if all values are equal."""
    r = rank_sums(df, dim, value, first)
    p = F.when(F.col("z").isNull(), F.when(F.col("level"), 1.0).otherwise(0.0)).otherwise(F.least(F.col("tail"), F.lit(1.0)))
    empty = (F.col("n1") == 0) | (F.col("n2") == 0)
    nan = lambda c: F.when(empty, NAN).otherwise(c)
    return r.withColumn("tail", special.erfc(F.coalesce("z", F.lit(0.0)) / 2**0.5)).select(dim, nan(F.col("U")).alias("U"), nan(p).alias("pvalue_u"))


def group_moments(df: DataFrame, group: str, first, second, dim: str = "dim", value: str = "value") -> DataFrame:
    """(dim, n1, n2, mean1, mean2, sd1, sd2, t, df, cohens_d) without p-values;
    dimensions are those of the first group."""
    v = as_nan(value)
    a, b = F.col(group) == F.lit(first), F.col(group) == F.lit(second)
    sums = df.where(a | b).groupBy(dim).agg(
        F.count(F.when(a, 1)).alias("n1"), F.count(F.when(b, 1)).alias("n2"),
        F.avg(F.when(a, v)).alias("mean1"), F.avg(F.when(b, v)).alias("mean2"),
        F.coalesce(F.stddev_samp(F.when(a, v)), F.lit(NAN)).alias("sd1"), F.coalesce(F.stddev_samp(F.when(b, v)), F.lit(NAN)).alias("sd2"),
    ).where("n1 > 0")
    e1, e2 = F.col("sd1") * F.col("sd1") / F.col("n1"), F.col("sd2") * F.col("sd2") / F.greatest(F.col("n2"), F.lit(1))
    both = (F.col("n1") > 1) & (F.col("n2") > 1) & finite(F.col("sd1")) & finite(F.col("sd2"))
    se, gap = F.sqrt(e1 + e2), F.col("mean1") - F.col("mean2")
    welch = both & (se > 0)
    freedom = (e1 + e2) * (e1 + e2) / (e1 * e1 / F.greatest(F.col("n1") - 1, F.lit(1)) + e2 * e2 / F.greatest(F.col("n2") - 1, F.lit(1)))
    rest = F.col("n1") + F.col("n2") - 2
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("sd1") * F.col("sd1") + (F.col("n2") - 1) * F.col("sd2") * F.col("sd2")) / F.greatest(rest, F.lit(1)))
    d = F.when((rest > 0) & finite(F.col("sd1")) & finite(F.col("sd2")), F.when(pooled > 0, gap / pooled).otherwise(0.0)).otherwise(NAN)
    out = sums.withColumns({"t": F.when(welch, gap / se).otherwise(NAN), "df": F.when(welch, freedom).otherwise(NAN), "cohens_d": d})
    empty = F.col("n2") == 0
    return out.select(dim, "n1", "n2", *[F.when(empty, NAN).otherwise(F.coalesce(F.col(c), F.lit(NAN))).alias(c) for c in ("mean1", "mean2", "sd1", "sd2", "t", "df", "cohens_d")])


def group_stats(df: DataFrame, group: str, first, second, dim: str = "dim", value: str = "value") -> DataFrame:
    """One row for each dimension: sizes, means, deviations and medians, Welch's
    t, df and p, Cohen's d, U with its p and effect_r = 1 - 2U / (n1 n2)."""
    rows = df.where(F.col(group).isin(first, second))
    moments = group_moments(rows, group, first, second, dim, value)
    ranks = wilcox_ranksum(rows, dim, value, F.col(group) == F.lit(first))
    medians = quantiles(rows, [dim, group], {"median": 0.5}, value).groupBy(dim).agg(F.max(F.when(F.col(group) == F.lit(first), F.col("median"))).alias("median1"), F.max(F.when(F.col(group) == F.lit(second), F.col("median"))).alias("median2"))
    out = moments.join(ranks, dim, "left").join(medians, dim, "left").withColumn("pvalue_t", special.t_pvalue("t", "df"))
    empty = (F.col("n1") == 0) | (F.col("n2") == 0)
    effect = 1 - 2 * F.col("U") / F.greatest(F.col("n1") * F.col("n2"), F.lit(1))
    nan = lambda c: F.when(empty, NAN).otherwise(F.coalesce(c, F.lit(NAN)))
    return out.select(dim, "n1", "n2", "t", "df", "pvalue_t", "cohens_d", "mean1", "mean2", "sd1", "sd2", nan(F.col("U")).alias("U"), nan(F.col("pvalue_u")).alias("pvalue_u"), nan(effect).alias("effect_r"), nan(F.col("median1")).alias("median1"), nan(F.col("median2")).alias("median2"))
