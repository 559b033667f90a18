"""Licence detection by ordered signature rules (operator 8), Spark functions only.

A text passes a cheap gate of words; of the several hundred rules only those
whose own keyword occurs are matched (their patterns are data, compiled where
they are needed: texts past the gate are few, and a plan with a branch a rule
would be far larger than the work).  Both are single words that every match of
a rule contains, so neither loses a match.  Detections are sorted by place: one that
lies inside another is suppressed, and of two that overlap the one of stronger
priority stays.  One narrow pass without shuffle or Python.

Beside the rules, base phrases are counted as consecutive words.  Null texts
count as empty: no words, no labels, score 0.  Every row gets a row; other
columns are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import named
from weft.llm.license_rules import rules
from weft.llm.spans import spans

GATE = tuple(sorted({r.gate for r in rules()}))
SEP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WORD = f"[^{SEP}]+"
BASE = rf"(?i)(?:(?<=[{SEP}])|\A)(?:mit|apache|general[{SEP}]+public)[{SEP}]+license(?=[{SEP}]|\z)"
BASE_LABELS = {"mit": "mit", "apa": "apache", "gen": "gpl"}


def n_words(text: Column) -> Column:
    """How many words text has: the pieces between separators, without the empty ones
    at its ends (a match object for each word would cost far more)."""
    edge = lambda c: c.rlike(f"[{SEP}]").cast("int")
    first = F.when(text == "", 1).otherwise(edge(F.substring(text, 1, 1)))
    return (F.size(F.split(text, f"[{SEP}]+", -1)) - first - edge(F.substring(text, -1, 1))).cast("bigint")


@functools.lru_cache(maxsize=1)
def _rules() -> str:
    """The rules as one literal array, in SQL: those that share gate and keyword
    together, so that each such pair is looked for once."""
    quote = lambda s: "r'" + s.replace("'", "\\x27") + "'"
    array = lambda items: "array(" + ", ".join(items) + ")"
    groups: dict[tuple[str, str], list[str]] = {}
    for r in rules():
        groups.setdefault((r.gate, r.keyword), []).append(f"named_struct('label', '{r.label}', 'pattern', {quote(r.pattern)}, 'priority', {r.priority}, 'confidence', {r.confidence}D)")
    return array(f"named_struct('gate', '{gate}', 'keyword', '{keyword}', 'rules', {array(own)})" for (gate, keyword), own in groups.items())


def detections(low: Column) -> Column:
    """All rule matches in lower-case text, by start, longest first."""
    groups = F.filter(F.expr(_rules()), lambda g: F.contains(low, g["gate"]) & F.contains(low, g["keyword"]))
    active = F.flatten(F.transform(groups, lambda g: g["rules"]))
    found = F.transform(active, lambda r: F.transform(spans(low, r["pattern"]), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), r["priority"].alias("priority"), r["label"].alias("label"), r["confidence"].alias("confidence"))))
    return F.array_sort(F.flatten(found))


def resolved(found: Column) -> Column:
    """struct<labels, score> of sorted detections, in one pass over them: only
    the last detection that stands is held."""
    none = F.struct(F.lit(-1).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("minus_end"), F.lit(99).alias("priority"), F.lit("").alias("label"), F.lit(0.0).alias("confidence"))
    state = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"), none.alias("last"))

    def settle(acc: Column, last: Column) -> Column:
        return F.struct(F.array_union(acc["labels"], F.array(acc["last"]["label"])).alias("labels"), F.greatest(acc["score"], acc["last"]["confidence"]).alias("score"), last.alias("last"))

    def hold(acc: Column, last: Column) -> Column:
        return F.struct(acc["labels"].alias("labels"), acc["score"].alias("score"), last.alias("last"))

    def step(acc: Column, x: Column) -> Column:
        ends = -acc["last"]["minus_end"]
        inside, apart = -x["minus_end"] <= ends, x["start"] >= ends
        stronger = x["priority"] < acc["last"]["priority"]
        return F.when(inside, hold(acc, acc["last"])).when(apart, settle(acc, x)).when(stronger, hold(acc, x)).otherwise(hold(acc, acc["last"]))

    end = lambda acc: F.struct(F.array_remove(F.array_union(acc["labels"], F.array(acc["last"]["label"])), "").alias("labels"), F.greatest(acc["score"], acc["last"]["confidence"]).alias("score"))
    return F.aggregate(found, state, step, end)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: (id_col, n_words, n_base, first_word, last_word,
    base_labels array, labels array, score)."""
    text = F.coalesce(named(text_col), F.lit(""))
    base = df.select(named(id_col).alias("id"), text.alias("text"), F.lower(text).alias("low"))
    gate = functools.reduce(lambda a, b: a | b, [F.contains("low", F.lit(k)) for k in GATE])
    gated = base.select("id", "text", n_words(F.col("text")).alias("n_words"), F.when(gate, F.col("low")).alias("low"))
    has = F.contains("low", F.lit("license"))
    found = gated.select(
        "id",
        "n_words",
        F.when(has, F.regexp_extract_all("text", F.lit(BASE), F.lit(0))).alias("hits"),
        F.when(has, F.split("text", BASE, -1)).alias("gaps"),
        F.when(F.col("low").isNotNull(), resolved(detections(F.col("low")))).alias("found"),
    )
    count = lambda c: F.regexp_count(c, F.lit(WORD)).cast("bigint")
    kinds = F.create_map(*[F.lit(x) for kv in BASE_LABELS.items() for x in kv])
    based = found.select(
        "id",
        "n_words",
        F.coalesce(F.size("hits"), F.lit(0)).cast("bigint").alias("n_base"),
        F.when(F.size("hits") > 0, count(F.element_at("gaps", 1))).alias("first_word"),
        F.when(F.size("hits") > 0, F.col("n_words") - count(F.element_at("gaps", -1)) - count(F.element_at("hits", -1))).alias("last_word"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform("hits", lambda h: kinds[F.lower(F.substring(h, 1, 3))]))), F.array().cast("array<string>")).alias("base_labels"),
        F.coalesce(F.col("found.labels"), F.array().cast("array<string>")).alias("more"),
        F.coalesce(F.col("found.score"), F.lit(0.0)).alias("score"),
    )
    return based.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_sort(F.array_union("base_labels", "more")).alias("labels"),
        F.when(F.col("n_base") > 0, F.greatest("score", F.lit(0.7))).otherwise(F.col("score")).alias("score"),
    )
