"""Pairs of codes and networks as vectors.

Pairs (j, i) with j < i come column by column: (0,1), (0,2), (1,2), (0,3), ...,
with (i, i) after its column's pairs where the diagonal counts.  All of it is
narrow: expressions on array columns or on named columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.missing import col

SEPARATOR = " & "


def choose_two(n: Column) -> Column:
    n = n.cast("bigint")
    return F.floor(n * (n - 1) / 2).cast("bigint")


def n_connections(n: Column, diagonal: bool = False) -> Column:
    return choose_two(n + 1) if diagonal else choose_two(n)


def pairs(n: Column, diagonal: bool = False) -> Column:
    """array<struct<j, i>> of all pairs of 0 .. n - 1."""
    below = lambda i: F.filter(F.sequence(F.lit(0), i), lambda j: j <= i if diagonal else j < i)
    made = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(below(i), lambda j: F.struct(j.alias("j"), i.alias("i")))))
    return F.when(n > 0, made).otherwise(F.array().cast("array<struct<j: int, i: int>>"))


def connection_indices(spark: SparkSession, n: int, row: int = -1, diagonal: bool = False) -> DataFrame:
    """(k, row, col), or only one of them for row 0 or 1."""
    if row not in (-1, 0, 1):
        raise ValueError("row must be -1, 0 or 1")
    keep = {-1: ["row", "col"], 0: ["row"], 1: ["col"]}[row]
    grid = spark.range(n).select(F.col("id").cast("int").alias("col"), F.explode(F.sequence(F.lit(0), F.col("id").cast("int"))).alias("row"))
    grid = grid if diagonal else grid.where("row < col")
    place = n_connections(F.col("col"), diagonal) + F.col("row")
    return grid.select(place.alias("k"), *keep)


def code_connections(v: Column | str) -> Column:
    """Products of all pairs of an array column's elements."""
    v = col(v)
    columns = F.transform(F.sequence(F.lit(1), F.size(v) - 1), lambda i: F.transform(F.slice(v, F.lit(1), i), lambda x: x * F.element_at(v, i + 1)))
    return F.when(F.size(v) > 1, F.flatten(columns)).otherwise(F.array().cast("array<double>"))


def connection_names(names: Sequence[str], diagonal: bool = False) -> list[str]:
    return [f"{names[j]}{SEPARATOR}{names[i]}" for i in range(len(names)) for j in range(i + diagonal)]


def connection_names_of(v: Column | str, diagonal: bool = False) -> Column:
    """connection_names of an array<string> column."""
    v = col(v)
    return F.transform(pairs(F.size(v), diagonal), lambda p: F.concat_ws(SEPARATOR, F.element_at(v, p["j"] + 1), F.element_at(v, p["i"] + 1)))


def connect(df: DataFrame, codes: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Wide products: a column "a & b" for each pair of code columns."""
    products = [(F.col(codes[j]) * F.col(codes[i])).alias(f"{codes[j]}{SEPARATOR}{codes[i]}") for i in range(len(codes)) for j in range(i)]
    return df.select(*keys, *products)


def _square(v: Column) -> Column:
    n = F.round(F.sqrt(F.size(v).cast("double"))).cast("int")
    return F.when(n * n == F.size(v), n).otherwise(F.raise_error(F.lit("a directed network needs n * n elements")).cast("int"))


def fold_directed_network(v: Column | str, diagonal: bool = False) -> Column:
    """A column-major n * n array to its upper triangle, both directions added;
    the diagonal, if it stays, is taken once.  Other lengths raise an error."""
    v = col(v)
    n = _square(v)
    at = lambda r, c: F.element_at(v, c * n + r + 1)
    return F.transform(pairs(n, diagonal), lambda p: F.when(p["j"] == p["i"], at(p["j"], p["i"])).otherwise(at(p["j"], p["i"]) + at(p["i"], p["j"])))


def network_to_vector(v: Column | str, full: bool = True, diagonal: bool = False) -> Column:
    """A column-major n * n array as it is, or its upper triangle; what lies
    below the diagonal is left out, not added."""
    v = col(v)
    n = _square(v)
    if full:
        return F.when(n >= 0, v)
    return F.transform(pairs(n, diagonal), lambda p: F.element_at(v, p["i"] * n + p["j"] + 1))


def fold_edges(df: DataFrame, keys: Sequence[str] = (), i: str = "i", j: str = "j", w: str = "w", diagonal: bool = False) -> DataFrame:
    """Edge table to undirected edges: weights of both directions summed."""
    rows = df if diagonal else df.where(F.col(i) != F.col(j))
    return rows.groupBy(*keys, F.least(i, j).alias(i), F.greatest(i, j).alias(j)).agg(F.sum(w).alias(w))


def upper_edges(df: DataFrame, i: str = "i", j: str = "j", diagonal: bool = False) -> DataFrame:
    """The edges above the diagonal."""
    return df.where(F.col(i) <= F.col(j) if diagonal else F.col(i) < F.col(j))
