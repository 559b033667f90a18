import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import following, lasso, linalg, ranks, validate


def stream(spark, times, points):
    return spark.createDataFrame([("k", i, float(t), float(x), float(y)) for i, (t, (x, y)) in enumerate(zip(times, points, strict=True))], "k string, ord long, t double, x double, y double")


def test_turn_lag(spark):
    a = stream(spark, [1, 3, 5, 8], [(0, 0), (1, 0.2), (1.5, 0.7), (2, 1)])
    b = stream(spark, [1, 2, 4, 7], [(0.1, 0), (0.7, 0.1), (1.2, 0.4), (1.8, 0.9)])
    r = following.turn_lag(a, b, ["k"], [1]).first()
    assert (r["mean_distance"], r["valid_count"]) == (pytest.approx(0.3213662108262485), 3)


def test_sweep(spark):
    points = [(i, i) for i in range(1, 6)]
    r = following.best_turn_lag(stream(spark, range(3, 8), points), stream(spark, range(1, 6), points), ["k"], 4).first()
    assert (r["best_lag"], r["min_mean_distance"]) == (2, 0)


def test_turn_lag_edges(spark):
    b = stream(spark, [1, 5, 2], [(0, 0), (9, 9), (5, 5)])
    a = stream(spark, [3], [(0, 0)])
    r = following.turn_lag(a, b, ["k"], [0]).first()
    assert (r["mean_distance"], r["valid_count"]) == (0, 1)
    late = stream(spark, [100], [(0, 0)])
    assert tuple(following.turn_lag(a, late, ["k"], [0]).first())[2:] == (0, 0)
    r = following.best_turn_lag(a, late, ["k"], 2).first()
    assert (r["best_lag"], r["min_mean_distance"]) == (0, 0)
    ties = stream(spark, [1, 1], [(7, 7), (0, 0)])
    assert following.turn_lag(a, ties, ["k"], [0]).first()["mean_distance"] == 0


def test_soft_threshold(spark):
    rows = spark.createDataFrame([(-3.0,), (0.5,), (2.0,)], "z double").select(lasso.soft_threshold("z", 1.0)).collect()
    assert [r[0] for r in rows] == [-2, 0, 1]


def naive(x, y, lam, pf):
    n, b = len(x), np.zeros(x.shape[1])
    for _ in range(5000):
        old = b.copy()
        for j in range(len(b)):
            z = x[:, j] @ (y - x @ b + x[:, j] * b[j]) / n
            b[j] = np.sign(z) * max(abs(z) - lam * pf[j], 0) / (x[:, j] @ x[:, j] / n)
        if abs(b - old).max() < 1e-12:
            break
    return b


def test_descend():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 4))
    y = x @ [1, 0, -2, 0.1] + rng.normal(size=60)
    pf = np.array([0, 1, 1, 1.0])
    for lam in (0.01, 0.3, 2.0):
        got = lasso.descend(x.T @ x / 60, x.T @ y / 60, lam, pf, tol=1e-13)
        assert got == pytest.approx(naive(x, y, lam, pf), abs=1e-9)
    assert lasso.lambda_max(np.array([[1.0], [-3.0]]), np.array([0, 1])) == 3


def test_x1_contribution(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 3))
    y = 2 * x[:, 0] + 0.5 * x[:, 1] + 0.1 * rng.normal(size=80)
    rows = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(80)], "i long, a double, b double, c double, y double")
    out = lasso.x1_contribution(rows, ["i"], ["a", "b", "c"], ["y"], ["a"]).orderBy("i").toPandas()
    part = out["fit_y"].to_numpy()
    assert np.corrcoef(part, x[:, 0])[0, 1] == pytest.approx(1) and part.std() / x[:, 0].std() == pytest.approx(2, abs=0.1)
    free = lasso.x1_contribution(rows, ["i"], ["a", "b"], ["y"], ["a"], factors=[0, 0]).toPandas()
    assert (free["fit_y"] == 0).all()
    none = lasso.x1_contribution(rows.where("i < 0"), ["i"], ["a"], ["y"], ["a"])
    assert none.count() == 0


def test_linalg(spark):
    rng = np.random.default_rng(10)
    a = rng.normal(size=(30, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in a], "a double, b double, c double, d double")
    assert np.allclose(linalg.gram(df, df.columns), a.T @ a)
    s, v = linalg.svd_right(df, df.columns)
    assert np.allclose(s, np.linalg.svd(a)[1]) and np.allclose(v @ np.diag(s**2) @ v.T, a.T @ a)
    q = linalg.mgs(a)
    assert np.allclose(q.T @ q, np.eye(4))
    ok, q, r = linalg.modified_qr(a)
    assert ok and np.allclose(q @ r, a)
    assert not linalg.modified_qr(np.column_stack((a[:, 0], a[:, 0])))[0]
    full = linalg.qr_full(a)
    assert full.shape == (30, 30) and np.allclose(full @ full.T, np.eye(30))
    u, s, v = linalg.svd(a)
    assert np.allclose(u[:, :4] * s @ v.T, a)
    g = a.T @ a
    assert np.allclose(linalg.inv_sym(g) @ g, np.eye(4)) and np.allclose(g @ linalg.solve_spd(g, np.ones(4)), 1)
    flat = np.diag([2.0, 0.0])
    assert np.allclose(linalg.inv_sym(flat), np.diag([0.5, 0]))


def test_validate(spark):
    rows = spark.createDataFrame([(1.0, [1.0, 2.0])], "x double, v array<double>")
    assert validate.require_dims(validate.require_finite(rows, ["x"]), "v", 2).count() == 1
    with pytest.raises(Exception, match="points must be finite"):
        validate.require_finite(rows.withColumn("x", F.lit(float("nan"))), ["x"], "points").collect()
    with pytest.raises(Exception, match="row must have 3"):
        validate.require_dims(rows, "v", 3).collect()


def test_tall_factors(spark):
    rng = np.random.default_rng(18)
    a = rng.normal(size=(200, 3)) * [1, 50, 0.01] + [0, 7, 1]
    df = spark.createDataFrame([tuple(map(float, r)) for r in a], "a double, b double, c double").repartition(5)
    frame, r = linalg.qr_tall(df, ["a", "b", "c"])
    rows = frame.toPandas().to_numpy()
    assert np.allclose(np.tril(r, -1), 0) and (np.diag(r) >= 0).all()
    assert np.allclose(rows[:, 3:] @ r, rows[:, :3]) and np.allclose(rows[:, 3:].T @ rows[:, 3:], np.eye(3))
    frame, s, v = linalg.svd_tall(df, ["a", "b", "c"])
    rows = frame.toPandas().to_numpy()
    assert np.allclose(s, np.linalg.svd(a, compute_uv=False)) and np.allclose(rows[:, 3:] * s @ v.T, rows[:, :3])
    again, r = linalg.qr_tall(df.withColumn("d", F.col("a") * 2), ["a", "d"])
    assert again.agg(F.max(F.abs("q1"))).first()[0] == 0 and abs(r[1, 1]) < 1e-9
    _, r = linalg.qr_tall(df.where("false"), ["a", "b"])
    assert (r == 0).all()
    want = np.linalg.lstsq(a[:, :2], a[:, 2], rcond=None)[0]
    assert linalg.least_squares(df, ["a", "b"], "c") == pytest.approx(want)


def test_numbered(spark):
    rng = np.random.default_rng(19)
    rows = [(int(k), str(v)) for k, v in zip(rng.integers(0, 9, 500), rng.integers(0, 99, 500), strict=True)] + [(None, "x"), (None, "a"), (3, None)]
    df = spark.createDataFrame(rows, "k int, s string").repartition(4)
    order = lambda r: ((r[0] is not None, r[0] or 0), (r[1] is not None, r[1] or ""))
    for n in (None, 1, 7, 300):
        got = sorted(ranks.numbered(df, ["k", "s"], ranges=n).collect(), key=lambda r: r["place"])
        assert [r["place"] for r in got] == list(range(len(rows)))
        assert [(r["k"], r["s"]) for r in got] == sorted(rows, key=order)
    assert ranks.numbered(df.where("false"), ["k"]).count() == 0
