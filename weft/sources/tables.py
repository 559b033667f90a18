"""Tables and matrices in and out.

Matrices are DataFrames in one of three forms: wide (a column for each
dimension), array (one array<double> column) or long (id, dim, value).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "csv", "json")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_matrix(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A matrix of a known schema; text formats carry a header."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    reader = spark.read.format(fmt).schema(schema)
    return (reader.option("header", True).option("nanValue", "NaN") if fmt == "csv" else reader).load(path)


def write_matrix(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    writer = df.write.format(fmt).mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def to_long(df: DataFrame, keys: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """Wide to (keys, dim, value)."""
    return df.unpivot(list(keys), [F.col(d).cast("double").alias(d) for d in dims], "dim", "value")


def array_to_long(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Array to (keys, dim from 0, value)."""
    return df.select(*keys, F.posexplode(F.col(col).cast("array<double>")).alias("dim", "value"))


def to_array(df: DataFrame, keys: Sequence[str], dims: Sequence[str], name: str = "v") -> DataFrame:
    """Wide to one array column."""
    return df.select(*keys, F.array(*[F.col(d).cast("double") for d in dims]).alias(name))


def from_rows(spark: SparkSession, rows: Sequence[Sequence[float]], name: str = "v") -> DataFrame:
    """(row long, v array<double>) of an in-memory matrix, numpy's too."""
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], f"row long, {name} array<double>")
