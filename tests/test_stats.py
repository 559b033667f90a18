import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import special
from weft.operators import stats


def long(spark, values, dim="d"):
    return spark.createDataFrame([(dim, float(v)) for v in values], "dim string, value double")


def groups(spark, a, b):
    return spark.createDataFrame([("a", "d", float(v)) for v in a] + [("b", "d", float(v)) for v in b], "g string, dim string, value double")


def test_special():
    assert special.t_point(0.975, 10) == pytest.approx(2.228138851986, rel=1e-9)
    assert special.t_point(0.025, 3) == pytest.approx(-3.182446305284, rel=1e-9)
    assert special.t_tail(2.228138851986, 10) == pytest.approx(0.05, rel=1e-9)
    assert (special.t_point(0, 5), special.t_point(1, 5), special.t_point(0.5, 5)) == (-math.inf, math.inf, 0)
    assert special.t_point(0.9, 0) == math.inf
    assert math.isnan(special.t_tail(math.inf, 5)) and math.isnan(special.t_tail(1, 0))
    assert special.beta_inc(2, 3, 0.4) == pytest.approx(0.5248, rel=1e-10)
    assert (special.beta_inc(2, 3, -1), special.beta_inc(2, 3, 2)) == (0, 1)


def test_normal_quantile(spark):
    ps = [0.0001, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.99, 0.99999]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(special.normal_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([statistics.NormalDist().inv_cdf(p) for p in ps], abs=2e-8)
    assert math.isnan(spark.range(1).select(special.normal_quantile(F.lit(1.0))).first()[0])


def test_center(spark):
    points = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)], "x double, y double")
    assert sorted(r["x"] for r in stats.center_points(points, ["x", "y"]).collect()) == [-2, 0, 2]


def test_mean_ci(spark):
    r = stats.mean_ci(long(spark, [1, 2, 3, 4]), ["dim"]).first()
    half = special.t_point(0.975, 3) * statistics.stdev([1, 2, 3, 4]) / 2
    assert (r["mean"], r["lo"], r["hi"]) == pytest.approx((2.5, 2.5 - half, 2.5 + half))
    r = stats.mean_ci(long(spark, [1.5]), ["dim"]).first()
    assert (r["mean"], r["lo"], r["hi"]) == (1.5, -math.inf, math.inf)
    r = stats.mean_ci(long(spark, []), []).first()
    assert all(math.isnan(r[c]) for c in ("mean", "lo", "hi"))


def test_quantiles_and_outliers(spark):
    r = stats.iqr(long(spark, [1, 2, 3, 10, float("nan")]), ["dim"]).first()
    assert (r["q1"], r["q3"]) == (1.75, 4.75)
    r = stats.outlier_ci(long(spark, [1, 2, 3, 10]), ["dim"]).first()
    assert (r["lo"], r["hi"]) == (-4.5, 4.5)
    assert stats.outlier_ci(long(spark, [7]), ["dim"]).first()["hi"] == 0
    values = np.random.default_rng(1).normal(size=101).round(1)
    got = stats.quantiles(long(spark, values), ["dim"], {"a": 0.1, "b": 0.5, "c": 0.99}).first()
    assert [got["a"], got["b"], got["c"]] == pytest.approx(np.quantile(values, [0.1, 0.5, 0.99]))


def test_group_stats(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=30).round(1), (rng.normal(size=25) + 0.5).round(1)
    r = stats.group_stats(groups(spark, a, b), "g", "a", "b").first()
    v1, v2 = a.var(ddof=1) / 30, b.var(ddof=1) / 25
    assert r["t"] == pytest.approx((a.mean() - b.mean()) / math.sqrt(v1 + v2))
    assert r["df"] == pytest.approx((v1 + v2) ** 2 / (v1**2 / 29 + v2**2 / 24))
    assert r["pvalue_t"] == pytest.approx(special.t_tail(r["t"], r["df"]))
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert r["U"] == u and r["effect_r"] == pytest.approx(1 - 2 * u / 750)
    ties = sum(n**3 - n for n in np.unique(np.concatenate((a, b)), return_counts=True)[1])
    sd = math.sqrt(750 / 12 * (56 - ties / (55 * 54)))
    assert r["pvalue_u"] == pytest.approx(math.erfc(max(0, abs(u - 375) - 0.5) / sd / math.sqrt(2)))
    assert (r["median1"], r["median2"]) == pytest.approx((np.median(a), np.median(b)))


def test_group_stats_edges(spark):
    r = stats.group_stats(groups(spark, [1], [2, 3]), "g", "a", "b").first()
    assert all(math.isnan(r[c]) for c in ("t", "df", "pvalue_t", "cohens_d", "sd1"))
    assert (r["mean1"], r["median2"], r["U"]) == (1, 2.5, 0)
    r = stats.group_stats(groups(spark, [2, 2], [2, 2]), "g", "a", "b").first()
    assert math.isnan(r["t"]) and r["cohens_d"] == 0 and r["pvalue_u"] == 1
    r = stats.group_stats(groups(spark, [1, 2], []), "g", "a", "b").first()
    assert all(math.isnan(r[c]) for c in ("mean1", "U", "effect_r", "median1"))
