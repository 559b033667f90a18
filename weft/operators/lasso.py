"""Cross-validated lasso of several responses on sufficient statistics.

One aggregate by fold gives all sums of products; coordinate descent then runs on
p * p matrices on the driver, and the result is a projection of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.missing import as_nan
from weft.functions.missing import col as _col
from weft.operators.ranks import numbered


def soft_threshold(z: Column | str, gamma: Column | float) -> Column:
    z = _col(z)
    g = gamma if isinstance(gamma, Column) else F.lit(float(gamma))
    return F.signum(z) * F.greatest(F.abs(z) - g, F.lit(0.0))


def descend(g: np.ndarray, c: np.ndarray, penalty: float, factors: np.ndarray, start: np.ndarray | None = None, max_iter: int = 1000, tol: float = 1e-7) -> np.ndarray:
    """Coefficients that minimise b'gb / 2 - c'b + penalty * sum factors * |b|,
    for g = X'X / n and c = X'y / n; predictors that don't vary stay as they are."""
    b = np.zeros(len(c)) if start is None else np.array(start, float)
    for _ in range(max_iter):
        most = 0.0
        for j in range(len(c)):
            if g[j, j] < 1e-14:
                continue
            z = c[j] - g[j] @ b + g[j, j] * b[j]
            lam = penalty * factors[j] if factors[j] >= 1e-12 else 0.0
            new = np.sign(z) * max(abs(z) - lam, 0.0) / g[j, j]
            most, b[j] = max(most, abs(new - b[j])), new
        if most < tol:
            break
    return b


def lambda_max(c: np.ndarray, factors: np.ndarray) -> float:
    """The least penalty that leaves all penalised predictors out; c = X'Y / n."""
    held = np.asarray(factors) >= 1e-12
    return float(np.abs(c[held]).max()) if held.any() else 0.0


def x1_contribution(
    df: DataFrame, order_by: Sequence[str], xs: Sequence[str], ys: Sequence[str], x1: Sequence[str], factors: Sequence[float] | None = None,
    n_lambda: int = 50, k_folds: int = 5, eps: float = 0.01, fold: str | None = None,
) -> DataFrame:
    """df with a column "fit_" + y for each response: the x1 predictors' part of
    the lasso fit whose penalty has the least cross-validated error.

    Rows are dealt to folds by their place in order_by modulo the number of
    folds (2 at least, n / 2 at most; see ranks.numbered), or by an integer column
    `fold`, which spares the total order.  Predictors have no penalty where factors is 0; by
    default those in x1.  Responses are centred, predictors standardised."""
    pf = np.array([0.0 if x in x1 else 1.0 for x in xs] if factors is None else factors, float)
    n = df.count()
    k = max(2, min(k_folds, n // 2))
    names = [*xs, *ys]
    dealt, place = (numbered(df, order_by, "__place"), "__place") if fold is None else (df, fold)
    rows = dealt.select(F.pmod(F.col(place), F.lit(k)).alias("f"), *[as_nan(c).alias(f"c{i}") for i, c in enumerate(names)])
    cells = [F.count("*").cast("double"), *[F.sum(f"c{i}") for i in range(len(names))], *[F.sum(F.col(f"c{i}") * F.col(f"c{j}")) for i in range(len(names)) for j in range(i, len(names))]]
    got = {r["f"]: np.array(r["s"]) for r in rows.groupBy("f").agg(F.array(*cells).alias("s")).collect()}
    p, m = len(xs), len(names)

    def unpack(s: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        square = np.zeros((m, m))
        square[np.triu_indices(m)] = s[1 + m :]
        return s[0], s[1 : 1 + m], square + np.triu(square, 1).T

    total = sum(got.values()) if got else np.zeros(1 + m + m * (m + 1) // 2)
    count, sums, products = unpack(total)
    zero = df.withColumns({f"fit_{y}": F.lit(0.0) for y in ys})
    if count < 2:
        return zero
    mean = sums / count
    var = np.maximum(np.diag(products) - count * mean**2, 0) / (count - 1)
    scale = np.ones(m)
    scale[:p] = np.where(np.sqrt(var[:p]) < 1e-12, 1.0, np.sqrt(var[:p]))

    def standard(s: np.ndarray) -> tuple[float, np.ndarray]:
        c, s1, s2 = unpack(s)
        moved = s2 - np.outer(mean, s1) - np.outer(s1, mean) + c * np.outer(mean, mean)
        return c, moved / np.outer(scale, scale)

    c, whole = standard(total)
    top = lambda_max(whole[:p, p:] / c, pf)
    if top < 1e-12:
        return zero
    path = np.exp(np.linspace(np.log(top), np.log(eps * top), n_lambda)) if n_lambda > 1 else np.array([top])
    errors = np.zeros(len(path))
    for part in got.values():
        cf, held = standard(part)
        ct, train = c - cf, whole - held
        if ct < 1:
            continue
        beta = np.zeros((p, len(ys)))
        for i, lam in enumerate(path):
            for y in range(len(ys)):
                beta[:, y] = descend(train[:p, :p] / ct, train[:p, p + y] / ct, lam, pf, beta[:, y])
            errors[i] += (np.trace(held[p:, p:]) - 2 * np.trace(beta.T @ held[:p, p:]) + np.trace(beta.T @ held[:p, :p] @ beta)) / max(cf, 1) / len(ys)
    best = int(np.argmin(errors))
    beta = np.zeros((p, len(ys)))
    for lam in path[: best + 1]:
        for y in range(len(ys)):
            beta[:, y] = descend(whole[:p, :p] / c, whole[:p, p + y] / c, lam, pf, beta[:, y])
    raw = beta / scale[:p, None]

    def part_of(y: int) -> Column:
        out = F.lit(0.0)
        for i, x in enumerate(xs):
            if x in x1:
                out = out + as_nan(x) * F.lit(float(raw[i, y]))
        return out

    return df.withColumns({f"fit_{name}": part_of(y) for y, name in enumerate(ys)})
