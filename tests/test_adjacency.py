import math

import pytest
from pyspark.sql import functions as F

from weft.operators import adjacency, normalization
from weft.sources.tables import from_rows


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v array<double>").select(expr.alias("r")).first()["r"]


def test_counts(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 2, 3, 4, 100_000)], "n long").select(adjacency.choose_two(F.col("n")), adjacency.n_connections(F.col("n"), True)).collect()
    assert [r[0] for r in rows] == [0, 1, 3, 6, 4999950000]
    assert [r[1] for r in rows] == [0, 3, 6, 10, 5000050000]


def test_indices(spark):
    both = adjacency.connection_indices(spark, 3, diagonal=True).orderBy("k").collect()
    assert [r["row"] for r in both] == [0, 0, 1, 0, 1, 2]
    assert [r["col"] for r in both] == [0, 1, 1, 2, 2, 2]
    assert adjacency.connection_indices(spark, 4, row=0).columns == ["k", "row"]
    with pytest.raises(ValueError):
        adjacency.connection_indices(spark, 3, row=2)


@pytest.mark.parametrize(("v", "want"), [([1, 2, 3], [2, 3, 6]), ([2, 3, 5], [6, 10, 15]), ([4], []), ([], [])])
def test_code_connections(spark, v, want):
    assert one(spark, [float(x) for x in v], adjacency.code_connections("v")) == want


def test_names(spark):
    assert adjacency.connection_names(["A", "B", "C"]) == ["A & B", "A & C", "B & C"]
    assert adjacency.connection_names(["A", "B", "C"], True) == ["A & A", "A & B", "B & B", "A & C", "B & C", "C & C"]
    got = spark.createDataFrame([(["A", "B", "C"],)], "v array<string>").select(adjacency.connection_names_of("v", True).alias("r")).first()["r"]
    assert got == adjacency.connection_names(["A", "B", "C"], True)


def test_fold_and_vector(spark):
    nine = [float(x) for x in range(1, 10)]
    assert one(spark, nine, adjacency.fold_directed_network("v")) == [6, 10, 14]
    assert one(spark, nine, adjacency.fold_directed_network("v", True)) == [1, 6, 5, 10, 14, 9]
    assert one(spark, [0.0, 2.0, 3.0, 0.0], adjacency.fold_directed_network("v")) == [5]
    assert one(spark, nine, adjacency.network_to_vector("v")) == nine
    assert one(spark, nine, adjacency.network_to_vector("v", False, True)) == [1, 4, 5, 7, 8, 9]
    with pytest.raises(Exception, match="n \\* n"):
        one(spark, [1.0, 2.0], adjacency.fold_directed_network("v"))


def test_normalize(spark):
    nan = float("nan")
    assert one(spark, [3.0, 4.0], normalization.normalize_networks("v")) == [0.6, 0.8]
    assert one(spark, [nan, nan], normalization.normalize_networks("v")) == [0, 0]
    assert one(spark, [0.0, 0.0], normalization.normalize_networks("v")) == [0, 0]
    assert one(spark, [math.inf, 1.0], normalization.normalize_networks("v")) == [0, 0]


def test_scale(spark):
    rows = {r["row"]: r["v"] for r in normalization.scale_networks(from_rows(spark, [[float("nan")] * 2, [3, 4], [6, 8]])).collect()}
    assert all(math.isnan(x) for x in rows[0])
    assert rows[1] == pytest.approx([0.3, 0.4])
    assert rows[2] == pytest.approx([0.6, 0.8])
    zeros = normalization.scale_networks(from_rows(spark, [[0, 0]])).first()["v"]
    assert zeros == [0, 0]
