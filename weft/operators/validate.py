"""Opt-in checks of inputs; a failing row fails its task with the name given."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.missing import finite


def require_finite(df: DataFrame, cols: Sequence[str], name: str = "matrix") -> DataFrame:
    """df; a cell that is missing or infinite raises an error."""
    bad = F.lit(False)
    for c in cols:
        bad = bad | ~finite(F.col(c).cast("double"))
    return df.where(F.when(bad, F.raise_error(F.lit(f"{name} must be finite")).cast("boolean")).otherwise(True))


def require_dims(df: DataFrame, col: str, size: int, name: str = "row") -> DataFrame:
    """df; an array of another size raises an error."""
    wrong = F.coalesce(F.size(col), F.lit(-1)) != size
    return df.where(F.when(wrong, F.raise_error(F.lit(f"{name} must have {size} elements")).cast("boolean")).otherwise(True))
