"""The query catalogue over the given tables, and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import special
from weft.functions.missing import as_nan
from weft.operators import adjacency, distance, door, following, lasso, linalg, normalization, ranks, stability, stats, trajectory, validate
from weft.sources.tables import array_to_long, read, to_array

CODES = ["click", "error", "purchase", "signup", "view"]
STEPS = [0.0, 0.25, 0.5, 0.75, 1.0]


def _round(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def code_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, day, one 0/1 column a code)."""
    events = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), "event_type")
    return events.groupBy("user_id", "day").agg(*[F.max(F.when(F.col("event_type") == c, 1.0).otherwise(0.0)).alias(c) for c in CODES])


def networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, day, v) with v the products of all pairs of codes."""
    return code_days(spark, sf_dir).select("user_id", "day", adjacency.code_connections(F.array(*CODES)).alias("v"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, i, j, w): how often event j came next after i."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("i"), F.lead("event_type").over(w).alias("j"))
    return steps.where("j is not null").groupBy("user_id", "i", "j").agg(F.count("*").cast("double").alias("w"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.to_date("ts").alias("day"), "value")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, t, x, y): one point a day."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    days = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("x"), F.count("*").cast("double").alias("y"))
    span = F.datediff(F.max("day").over(w), F.min("day").over(w))
    t = F.datediff("day", F.min("day").over(w)) / F.greatest(span, F.lit(1))
    return days.select("user_id", "day", t.alias("t"), "x", "y")


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.fit(daily(spark, sf_dir), ["user_id"], ["day"], "x", "y", "t", fixed_degree=3)


def turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "role", F.col("turn").cast("double").alias("t"), F.col("turn").alias("ord"), F.length("text").cast("double").alias("x"), F.col("turn").cast("double").alias("y"))
    return rows.where("role = 'user'").drop("role"), rows.where("role = 'assistant'").drop("role")


# --- adjacency, normalization -------------------------------------------------


def connection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = adjacency.connect(code_days(spark, sf_dir), CODES, ["user_id", "day"])
    return wide.toDF("user_id", "day", *[n.replace(adjacency.SEPARATOR, "_") for n in adjacency.connection_names(CODES)])


def n_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", "n", adjacency.choose_two(F.col("n")).alias("choose_two"), adjacency.n_connections(F.col("n"), True).alias("with_diagonal"))


def connection_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjacency.connection_indices(spark, 60).select("k", "row", "col")


def connection_indices_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjacency.connection_indices(spark, 60, diagonal=True).select("k", "row", "col")


def connection_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "events").agg(F.array_sort(F.collect_set("event_type")).alias("names"))
    return names.select(F.posexplode(adjacency.connection_names_of("names", diagonal=True)).alias("k", "name"))


def fold_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjacency.fold_edges(transitions(spark, sf_dir), ["user_id"], diagonal=True)


def fold_directed_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = _square(spark, sf_dir).select("user_id", adjacency.fold_directed_network("v").alias("v"))
    return folded.select("user_id", F.posexplode("v").alias("k", "w"))


def network_to_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjacency.upper_edges(transitions(spark, sf_dir))


def _square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, v): transitions as a column-major array of 25."""
    codes = F.array(*map(F.lit, CODES))
    at = F.array_position(codes, F.col("j")) * 5 + F.array_position(codes, F.col("i")) - 6
    return transitions(spark, sf_dir).groupBy("user_id").agg(F.array(*[F.coalesce(F.sum(F.when(at == k, F.col("w"))), F.lit(0.0)) for k in range(25)]).alias("v"))


def network_to_vector_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole array, its upper triangle, and that with the diagonal."""
    forms = {"full": {}, "upper": {"full": False}, "diagonal": {"full": False, "diagonal": True}}
    each = [_square(spark, sf_dir).select("user_id", F.lit(n).alias("form"), F.posexplode(adjacency.network_to_vector("v", **o)).alias("k", "w")) for n, o in forms.items()]
    return each[0].union(each[1]).union(each[2])


def normalize_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = networks(spark, sf_dir).withColumn("v", normalization.normalize_networks("v"))
    return _round(rows.select("user_id", "day", F.posexplode("v").alias("k", "value")), "value")


def scale_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalization.scale_networks(networks(spark, sf_dir))
    return _round(rows.select("user_id", "day", F.posexplode("v").alias("k", "value")), "value")


# --- stats ----------------------------------------------------------------------


def center_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return _round(stats.center_points(points, ["c_acctbal"]), "c_acctbal", digits=4)


def center_points_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return _round(stats.center_points(points, ["c_acctbal"], ["c_nationkey"]).select(*points.columns), "c_acctbal", digits=4)


def center_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = array_to_long(read(spark, sf_dir, "embeddings"), ["vec_id"], "embedding")
    return _round(stats.center_long(points).select("vec_id", "dim", "value"), "value")


def _balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("dim"), F.col("c_acctbal").alias("value"))


def mean_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.mean_ci(_balances(spark, sf_dir), ["dim"]), "mean", "lo", "hi", digits=3)


def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.quantiles(_balances(spark, sf_dir), ["dim"], {"p05": 0.05, "median": 0.5, "p95": 0.95})
    return _round(out, "p05", "median", "p95", digits=4)


def outlier_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.outlier_ci(_balances(spark, sf_dir), ["dim"]), "lo", "hi", digits=4)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("grp"), F.col("o_orderpriority").alias("dim"), F.col("o_totalprice").alias("value"))


def group_stats_welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.group_moments(_orders(spark, sf_dir), "grp", "F", "O")
    return _round(out, "mean1", "mean2", "sd1", "sd2", "t", "df", "cohens_d", digits=3)


def group_stats_wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).where("grp in ('F', 'O')")
    return _round(stats.rank_sums(rows, "dim", "value", F.col("grp") == "F").drop("level"), "z", digits=5)


def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.group_stats(_orders(spark, sf_dir), "grp", "F", "O")
    out = _round(out, "mean1", "mean2", "sd1", "sd2", "t", "df", "cohens_d", "median1", "median2", digits=3)
    return _round(out, "pvalue_t", "pvalue_u", "effect_r", digits=6)


def normal_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_discount") * 9 + 0.05
    return read(spark, sf_dir, "lineitem").groupBy(F.round(p, 4).alias("p")).agg(F.count("*").alias("n")).withColumn("z", F.round(special.normal_quantile(F.col("p")), 6))


# --- door -----------------------------------------------------------------------


def _door(df: DataFrame) -> DataFrame:
    return _round(df.select("event_id", "value"), "value")


def lookback_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _door(door.lookback(lines(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["value"]))


def lookback_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _door(door.lookback(lines(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["value"], mean=True))


def lookback_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _door(door.lookback(lines(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["value"], size=5, mean=True, linear=True))


def lookback_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _door(door.lookback(lines(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["value"], size=3, segment="day"))


def lookback_returning_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that come back: a run of one kind of event ends at another kind."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", "event_type")
    return _door(door.lookback(rows, ["user_id"], ["ts", "event_id"], ["value"], size=4, segment="event_type"))


def lookback_per_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    sizes = rows.select("user_id").distinct().withColumn("size", (F.col("user_id") % 25 + 1).cast("int"))
    return _door(door.lookback_by_unit(rows, sizes, ["user_id"], ["ts", "event_id"], ["value"]))


def _ema(df: DataFrame) -> DataFrame:
    # Averages of two-decimal values end in exact fives; a shift keeps rounding stable.
    return _round(df.select("event_id", (F.col("value") + 3.7123e-8).alias("value")), "value")


def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ema(door.ema(lines(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["value"]))


def ema_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ema(door.ema(lines(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["value"], alpha=0.3, segment="day"))


# --- trajectories ---------------------------------------------------------------


def trajectory_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trajectory.fit(daily(spark, sf_dir), ["user_id"], ["day"], "x", "y", "t", fixed_degree=1)
    out = out.select("user_id", "n", *[F.element_at(c, k + 1).alias(f"{c[-1]}{k}") for c in ("coef_x", "coef_y") for k in (0, 1)])
    return _round(out, "x0", "x1", "y0", "y1")


def trajectory_fit_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = trajectory.fit(daily(spark, sf_dir), ["user_id"], ["day"], "x", "y", "t", fixed_degree=2)
    out = fits.select("user_id", *[F.element_at("coef_x", k + 1).alias(f"x{k}") for k in (0, 1, 2)])
    return _round(out, "x0", "x1", "x2", digits=4)


def trajectory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = trajectory.fit(daily(spark, sf_dir), ["user_id"], ["day"], "x", "y", "t")
    coefficients = [F.get(c, F.lit(k)).alias(f"{c[-1]}{k}") for c in ("coef_x", "coef_y") for k in range(4)]
    out = fits.select("user_id", "n", "degree", "cv_error", "aic", *coefficients, "basis", "error")
    return _round(out, "cv_error", "aic", *[f"{c}{k}" for c in "xy" for k in range(4)], digits=4)


def trajectory_search_aic(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = trajectory.fit(daily(spark, sf_dir), ["user_id"], ["day"], "x", "y", "t", criterion="aic")
    return _round(fits.select("user_id", "degree", "aic"), "aic", digits=4)


def orthogonal_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trajectory.orthogonal_basis(daily(spark, sf_dir), ["user_id"], "t", 3)
    out = rows.select("user_id", F.col("day").cast("string").alias("day"), *[F.element_at("design", k).alias(f"p{k}") for k in (1, 2, 3)], *[F.element_at("alpha", k).alias(f"a{k}") for k in (1, 2, 3)], F.element_at("norm2", 5).alias("n3"))
    return _round(out, "p1", "p2", "p3", "a1", "a2", "a3", "n3", digits=6)


def trajectory_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(trajectory.evaluate_on(curves(spark, sf_dir), ["user_id"], STEPS), "x", "y")


def trajectory_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trajectory.evaluate_derivatives(curves(spark, sf_dir), ["user_id"], STEPS)
    return _round(out, "vx", "vy", "speed", "ax", "ay", "heading_rate", "curvature", digits=4)


def polynomial_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select("p_partkey", trajectory.design(F.col("p_size") / 50, 3, "raw").alias("v"))
    return _round(parts.select("p_partkey", F.posexplode("v").alias("k", "value")), "value")


def trajectory_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = curves(spark, sf_dir).select("user_id", "coef_x", "coef_y")
    b = a.select((F.col("user_id") - 1).alias("user_id"), F.col("coef_x").alias("bx"), F.col("coef_y").alias("by"))
    out = a.join(b, "user_id").select("user_id", distance.integrated("coef_x", "coef_y", "bx", "by").alias("distance"))
    return _round(out, "distance")


def trajectory_lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = curves(spark, sf_dir).select("user_id", "coef_x", "coef_y")
    b = a.select((F.col("user_id") - 1).alias("user_id"), F.col("coef_x").alias("bx"), F.col("coef_y").alias("by"))
    out = a.join(b, "user_id").select("user_id", distance.lagged("coef_x", "coef_y", "bx", "by", 0.2).alias("distance"))
    return _round(out, "distance")


def trajectory_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(distance.pairwise(curves(spark, sf_dir), "user_id"), "distance")


# --- following, stability, lasso, linear algebra, checks --------------------------


def turn_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = turns(spark, sf_dir)
    return _round(following.turn_lag(a, b, ["conv_id"], [1.0, 2.0]), "mean_distance")


def turn_lag_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = turns(spark, sf_dir)
    return _round(following.best_turn_lag(a, b, ["conv_id"], 5), "min_mean_distance")


def dist_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("u"), F.slice("embedding", 33, 32).alias("v"))
    return _round(stability.dist_dist_correlation(vectors, "vec_id", "u", "v"), "correlation")


def soft_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(read(spark, sf_dir, "customer").select("c_custkey", lasso.soft_threshold("c_acctbal", 1000.0).alias("value")), "value", digits=4)


def lasso_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", (F.col("p_partkey") % 11).cast("double").alias("lot"))
    out = lasso.x1_contribution(parts, ["p_partkey"], ["p_size", "lot"], ["p_retailprice"], ["p_size"])
    return _round(out.select("p_partkey", "fit_p_retailprice"), "fit_p_retailprice", digits=3)


def total_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return ranks.numbered(rows, ["event_type", "ts", "event_id"]).select("event_id", "place")


def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["l_quantity", "l_discount", "l_tax"]
    g = linalg.gram(read(spark, sf_dir, "lineitem"), cols)
    rows = [(cols[i], cols[j], float(g[i, j])) for i in range(3) for j in range(3)]
    return _round(spark.createDataFrame(rows, "a string, b string, s double"), "s", digits=2)


def svd_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The singular values of the embeddings, as the power sums that their Gram
    matrix has as traces: log10 of the sum of s^2, s^4 and s^6."""
    wide = read(spark, sf_dir, "embeddings").select(*[F.element_at("embedding", k + 1).cast("double").alias(f"e{k}") for k in range(64)])
    s, _ = linalg.svd_right(wide, wide.columns)
    return spark.createDataFrame([(k, round(float(np.log10((s ** (2 * k)).sum())), 8)) for k in (1, 2, 3)], "k int, log_sum double")


QR_COLUMNS = ["one", "l_quantity", "l_discount"]


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(1.0).alias("one"), "l_quantity", "l_discount", "l_tax")


def tall_qr(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, _ = linalg.qr_tall(_items(spark, sf_dir), QR_COLUMNS)
    return _round(q.select("l_orderkey", "l_linenumber", "q0", "q1", "q2"), "q0", "q1", "q2", digits=8)


def tall_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U, s and V of two columns, put together again, and U's lengths."""
    u, s, v = linalg.svd_tall(_items(spark, sf_dir), ["l_quantity", "l_discount"])
    back = [sum((F.col(f"u{k}") * F.lit(float(s[k] * v[j, k])) for k in (0, 1)), F.lit(0.0)).alias(n) for j, n in enumerate(("quantity", "discount"))]
    lengths = u.agg(*[F.round(F.sum(F.col(f"u{a}") * F.col(f"u{b}")), 6).alias(f"u{a}{b}") for a, b in ((0, 0), (0, 1), (1, 1))]).withColumns({f"s{k}": F.round(F.lit(float(s[k])), 4) for k in (0, 1)})
    rows = u.groupBy("l_linenumber").agg(F.round(F.sum(back[0]), 4).alias("quantity"), F.round(F.sum(back[1]), 4).alias("discount"))
    return rows.join(F.broadcast(lengths))


def least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_tax on the others: a symmetric positive definite system."""
    b = linalg.least_squares(_items(spark, sf_dir), QR_COLUMNS, "l_tax")
    return spark.createDataFrame([(c, round(float(x), 8)) for c, x in zip(QR_COLUMNS, b, strict=True)], "name string, b double")


def inverse_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverse of a symmetric matrix, scaled to rows."""
    g = linalg.gram(_items(spark, sf_dir), ["one", "l_discount"])
    inv = linalg.inv_sym(g / g[0, 0])
    return spark.createDataFrame([(i, j, round(float(inv[i, j]), 6)) for i in (0, 1) for j in (0, 1)], "i int, j int, v double")


def checked_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", as_nan(F.element_at("embedding", 1)).alias("first"))
    checked = validate.require_finite(validate.require_dims(points, "embedding", 64), ["first"])
    return checked.groupBy("label").agg(F.count("*").alias("n"))


def rejected_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checks say of inputs that they must not pass."""
    points = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    broken = points.withColumn("first", F.when(F.col("vec_id") == 3, F.lit(float("nan"))).otherwise(F.element_at("embedding", 1)))
    cases = {
        "finite": validate.require_finite(broken, ["first"]),
        "dims": validate.require_dims(points, "embedding", 63),
        "fold": points.select(adjacency.fold_directed_network(F.slice("embedding", 1, 7)).alias("v")),
        "indices": None,
    }
    said = []
    for name, df in cases.items():
        try:
            adjacency.connection_indices(spark, 3, row=2) if df is None else df.agg(F.count("*"), F.max(F.xxhash64(*df.columns))).collect()
            said.append((name, "accepted"))
        except Exception as e:
            known = ("matrix must be finite", "row must have 63 elements", "a directed network needs n * n elements", "row must be -1, 0 or 1")
            said.append((name, next((k for k in known if k in str(e)), str(e)[:80])))
    return spark.createDataFrame(said, "name string, said string")


def matrix_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide to array, array to long."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return array_to_long(to_array(parts, ["p_partkey"], ["p_size", "p_retailprice"]), ["p_partkey"], "v").select("p_partkey", "dim", "value")


NAMES = """
connection_counts n_connections connection_indices connection_indices_diagonal connection_names fold_directed fold_directed_array
network_to_vector normalize_networks scale_networks center_points center_points_by_group center_embeddings mean_ci quantiles outlier_ci
group_stats_welch group_stats_wilcoxon group_stats normal_quantile lookback_sum lookback_mean lookback_linear lookback_segments
lookback_returning_runs lookback_per_unit ema ema_segments trajectory_fit trajectory_fit_quadratic trajectory_search
trajectory_search_aic trajectory_eval trajectory_derivatives polynomial_design orthogonal_design trajectory_distance trajectory_lagged trajectory_pairwise turn_lag turn_lag_sweep dist_dist soft_threshold
lasso_contribution total_order gram_matrix svd_spectrum tall_qr tall_svd least_squares inverse_gram checked_points rejected_inputs
matrix_forms network_to_vector_array
""".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in NAMES}
