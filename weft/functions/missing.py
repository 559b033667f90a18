"""Missing values: null and NaN are the same thing.

Operators that skip missing cells turn them into nulls, which Spark's
aggregates skip; operators that pass them on turn them into NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), math.inf


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_null(c: Column | str) -> Column:
    c = col(c).cast("double")
    return F.when(~F.isnan(c), c)


def as_nan(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("double"), F.lit(NAN))


def finite(c: Column) -> Column:
    """Whether c is a finite number (false for null)."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < INF), F.lit(False))
