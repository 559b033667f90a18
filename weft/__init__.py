"""Networked-event analytics and training-data operators on PySpark."""

from pathlib import Path

from pyspark.sql import SparkSession


def share(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from the folder it is in, where
    their machines have it; elsewhere it goes with --py-files."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])
    return spark
