"""Where a regular expression matches, by Spark's own functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Running sums go in blocks of so many, so that copying stays near linear.
BLOCK = 256


def running(lengths: Column) -> Column:
    """The sum of each element and all before it, for array<int or bigint>."""

    def sums(values: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("a"))
        return F.aggregate(values, start, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"] + x)).alias("a")), lambda acc: acc["a"])

    last = F.floor((F.size(lengths) - 1) / F.lit(BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: sums(F.slice(lengths, i * BLOCK + 1, F.lit(BLOCK))))
    with_ends = F.transform(blocks, lambda b: F.struct(b.alias("b"), F.element_at(b, -1).alias("e")))
    moved = F.aggregate(
        with_ends,
        F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<array<bigint>>").alias("a")),
        lambda acc, x: F.struct((acc["s"] + x["e"]).alias("s"), F.concat(acc["a"], F.array(F.transform(x["b"], lambda v: v + acc["s"]))).alias("a")),
        lambda acc: F.flatten(acc["a"]),
    )
    return F.when(F.size(lengths) > 0, moved).otherwise(F.array().cast("array<bigint>"))


def spans(text: Column, pattern: Column, hits: Column | None = None) -> Column:
    """array<struct<start, end: bigint, text: string>> of the leftmost matches
    that don't overlap, in code points, end exclusive.  Matches and the pieces
    between them alternate, so their lengths add up to every position.  hits are
    the matches' texts, if they are known."""
    hits = F.regexp_extract_all(text, pattern, F.lit(0)) if hits is None else hits
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("text"), F.char_length(h).cast("bigint").alias("n"), (F.char_length(g) + F.char_length(h)).cast("bigint").alias("step")))
    made = F.zip_with(both, running(F.transform(both, lambda x: x["step"])), lambda x, end: F.struct((end - x["n"]).alias("start"), end.alias("end"), x["text"].alias("text")))
    return F.when(F.size(hits) > 0, made).otherwise(F.array().cast("array<struct<start: bigint, end: bigint, text: string>>"))
