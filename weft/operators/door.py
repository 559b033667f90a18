"""Ordered smoothing of event lines: lookback windows and exponential averages.

All operators take unit columns, a total order and, optionally, a segment.  A
segment is a run: rows before a change of segment never count, also if the same
segment comes back.  Rows whose unit is null pass through unchanged.  One
exchange by unit serves every window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.missing import NAN, as_nan, as_null

RUN, PLACE = "__run", "__place"


def _runs(df: DataFrame, unit: Sequence[str], order_by: Sequence[str], segment: str | None) -> DataFrame:
    """df with the number of each row's run."""
    if segment is None:
        return df.withColumn(RUN, F.lit(0))
    w = Window.partitionBy(*unit).orderBy(*order_by)
    changed = (~F.col(segment).eqNullSafe(F.lag(segment).over(w))).cast("int")
    return df.withColumn("__new", changed).withColumn(RUN, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def _listed(unit: Sequence[str]) -> Column:
    out = F.lit(True)
    for u in unit:
        out = out & F.col(u).isNotNull()
    return out


def lookback(df: DataFrame, unit: Sequence[str], order_by: Sequence[str], cols: Sequence[str], size: int = 20, mean: bool = False, linear: bool = False, segment: str | None = None) -> DataFrame:
    """cols pooled over the last `size` rows (1 at least) of the row's run:
    summed, or averaged; linear weights run from 1 at the window's first row.
    Missing cells are skipped: no cell at all sums to 0 and averages to NaN."""
    k = max(1, int(size))
    rows = _runs(df, unit, order_by, segment)
    run = Window.partitionBy(*unit, RUN).orderBy(*order_by)
    frame = run.rowsBetween(-(k - 1), 0)
    rows = rows.withColumn(PLACE, F.row_number().over(run)) if linear else rows
    out = {}
    for c in cols:
        v = as_null(c)
        if linear:
            before = F.greatest(F.lit(0), F.col(PLACE) - k)
            place = F.when(v.isNotNull(), F.col(PLACE))
            top = F.sum(F.col(PLACE) * v).over(frame) - before * F.sum(v).over(frame)
            weight = F.sum(place).over(frame) - before * F.count(v).over(frame)
        else:
            top, weight = F.sum(v).over(frame), F.count(v).over(frame)
        pooled = F.when(weight > 0, top / F.greatest(weight, F.lit(1))).otherwise(NAN) if mean else F.coalesce(top, F.lit(0.0))
        out[c] = F.when(_listed(unit), pooled).otherwise(as_nan(c))
    return rows.withColumns(out).drop(RUN, PLACE)


def lookback_by_unit(df: DataFrame, sizes: DataFrame, unit: Sequence[str], order_by: Sequence[str], cols: Sequence[str], mean: bool = False, linear: bool = False, segment: str | None = None, default: int = 20, size_col: str = "size") -> DataFrame:
    """lookback with each unit's own size (sizes: unit columns and size_col, one
    row a unit; others have the default).  A frame's bounds are literals, so the
    longest window is gathered and each row takes its unit's part of it."""
    most = max(1, default, sizes.agg(F.max(size_col)).first()[0] or 0)
    named = df.join(sizes.select(*unit, F.greatest(F.col(size_col), F.lit(1)).cast("int").alias("__k")), list(unit), "left").withColumn("__k", F.coalesce("__k", F.lit(max(1, default))))
    rows = _runs(named, unit, order_by, segment)
    frame = Window.partitionBy(*unit, RUN).orderBy(*order_by).rowsBetween(-(most - 1), 0)
    rows = rows.withColumn("__all", F.collect_list(F.struct(*[as_null(c).alias(c) for c in cols])).over(frame))
    rows = rows.withColumn("__win", F.slice("__all", F.greatest(F.lit(1), F.size("__all") - F.col("__k") + 1), F.col("__k")))
    out = {}
    for c in cols:
        start = F.struct(F.lit(0.0).alias("top"), F.lit(0).alias("weight"), F.lit(0).alias("i"))

        def add(acc: Column, x: Column) -> Column:
            i = acc["i"] + 1
            w = F.when(x.isNotNull(), i if linear else F.lit(1)).otherwise(0)
            return F.struct((acc["top"] + F.coalesce(x, F.lit(0.0)) * w).alias("top"), (acc["weight"] + w).alias("weight"), i.alias("i"))

        end = (lambda a: F.when(a["weight"] > 0, a["top"] / F.greatest(a["weight"], F.lit(1))).otherwise(NAN)) if mean else (lambda a: a["top"])
        out[c] = F.when(_listed(unit), F.aggregate(F.col("__win").getField(c), start, add, end)).otherwise(as_nan(c))
    return rows.withColumns(out).drop(RUN, "__k", "__all", "__win")


def ema(df: DataFrame, unit: Sequence[str], order_by: Sequence[str], cols: Sequence[str], alpha: float = 0.1, segment: str | None = None) -> DataFrame:
    """Exponential averages: S = alpha * Y + (1 - alpha) * S before, from the
    run's first Y; alpha is held within [1e-6, 1].  A missing Y carries S; a run
    that starts with one is NaN throughout.

    The recursion is a scaled running sum.  Scales stay representable because
    the sum starts anew every CHUNK steps with the value carried over; what
    would come from further back is below 1e-250 of it."""
    a = min(1.0, max(1e-6, float(alpha)))
    rows = _runs(df, unit, order_by, segment)
    run = Window.partitionBy(*unit, RUN).orderBy(*order_by)
    so_far = run.rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for i, c in enumerate(cols):
        v, first = as_null(c), F.first(as_null(c)).over(so_far)
        if a == 1.0:
            smooth = F.last(v, ignorenulls=True).over(so_far)
        else:
            q = -math.log1p(-a)
            chunk = max(1, int(600 / q))
            m, part, local, carry = f"__m{i}", f"__c{i}", f"__l{i}", f"__p{i}"
            rows = rows.withColumn(m, F.greatest(F.count(v).over(so_far) - 1, F.lit(0)))
            rows = rows.withColumn(part, F.floor(F.col(m) / chunk))
            place = (F.col(m) - F.col(part) * chunk).cast("double")
            gain = F.when(v.isNotNull(), F.when(F.col(m) == 0, v).otherwise(a * v) * F.exp(q * place))
            inner = Window.partitionBy(*unit, RUN, part).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
            rows = rows.withColumn(local, F.exp(-q * place) * F.coalesce(F.sum(gain).over(inner), F.lit(0.0)))
            rows = rows.withColumn(carry, F.lag(local).over(run))
            rows = rows.withColumn(carry, F.coalesce(F.first(carry).over(inner), F.lit(0.0)))
            smooth = F.col(local) + F.when(F.col(part) > 0, F.exp(-q * (place + 1)) * F.col(carry)).otherwise(0.0)
        out[c] = F.when(~_listed(unit), as_nan(c)).when(first.isNull(), NAN).otherwise(smooth)
    kept = df.columns
    return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in kept])
