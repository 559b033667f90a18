"""Places in a total order, without a task that holds all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, about, and ranges at most.
ROWS, RANGES = 250_000, 4_096


def numbered(df: DataFrame, order_by: Sequence[str], name: str = "place", ranges: int | None = None) -> DataFrame:
    """df with each row's place in the order, from 0 without gaps; ties in any
    order.  Nulls come first.

    The order is cut at `ranges` rows drawn by hash (any bounds are right, these
    are always the same); rows are numbered within their range, and each range
    starts where the counts of those before it end."""
    ranges = min(RANGES, df.count() // ROWS + 1) if ranges is None else ranges
    keyed = df.withColumn("__key", F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order_by]))
    key, hashed = F.col("__key"), F.xxhash64(*order_by)
    drawn = keyed.groupBy(F.pmod(hashed, F.lit(ranges)).alias("__g")).agg(F.min_by(key, hashed).alias("__k"))
    bounds = drawn.agg(F.array_sort(F.collect_list("__k")).alias("b")).scalar()

    def search(at: Column, step: Column) -> Column:
        """Binary search for the number of bounds up to the key."""
        further = at + step
        return F.when(F.coalesce((further <= F.size("__b")) & (F.get("__b", further - 1) <= key), F.lit(False)), further).otherwise(at)

    steps = F.array(*[F.lit(1 << i) for i in reversed(range(ranges.bit_length()))])
    ranged = keyed.withColumn("__b", bounds).withColumn("__range", F.aggregate(steps, F.lit(0), search)).drop("__b")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__range").count().withColumn("__start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("__range").orderBy(key)
    placed = ranged.withColumn("__n", F.row_number().over(within)).join(F.broadcast(starts), "__range")
    return placed.withColumn(name, (F.col("__start") + F.col("__n") - 1).cast("bigint")).drop("__range", "__n", "__start", "__key")
