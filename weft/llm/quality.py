"""Quality rules and tokeniser fertility (operator 9).

One Arrow pass over the texts.  The rules count at byte level: words, their code
points, symbols, repeated lines, and words in 8-word windows that occur twice.
Fertility comes from two public vocabularies.  A byte-level one for many
languages gives characters per token and the entropy of a text's tokens,
relative to the most that its length allows; a piece vocabulary with byte
fallback gives characters per piece and the share of pieces that are single bytes.

Rejection bands are fitted to the corpus, for each language and each script, from
all texts that pass the rules and have enough tokens (texts of equal figures, as
copies are, count once): the quartiles of each figure, FENCE interquartile ranges
apart.  Junk that fills less than a quarter of a language can't move them.  A text
takes its language's band if LEAST_TEXTS texts fitted it, else that of the script
that most of its letters belong to, else DEFAULT.  Quartiles come from whole
counts of figures rounded to 1 / GRID, so that they are the same for any
partitioning.  Texts of few tokens have no verdict of their own.

Figures are written as a narrow table; bands are a table of one row a language.
Null texts count as empty.  Null languages, and those of few texts, go by script.
Every row gets a row; an empty table none.  Other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import few, map_arrow, named, written
from weft.llm.words import SPACE, Words, cut, mix, pieces

WINDOW = 8
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Band:
    """Texts outside are rejected: least and most characters per token and per
    piece, most byte-fallback share, least relative token entropy."""

    least: float
    most: float
    piece_least: float
    piece_most: float
    fallback: float
    entropy: float


#: For scripts of too few texts.
DEFAULT = {"latin": Band(1.2, 7.0, 1.2, 7.0, 0.25, 0.35), "two-byte": Band(0.6, 6.0, 0.6, 6.0, 0.9, 0.30), "wide": Band(0.3, 4.0, 0.3, 4.0, 0.98, 0.30)}
#: Figures, and whether a band has a lower and an upper end for them.
FIGURES = {"chars_per_token": (True, True), "chars_per_piece": (True, True), "fallback_share": (False, True), "token_entropy": (True, False)}
#: Interquartile ranges from the quartiles to a band's ends.  Shares of single bytes
#: are skewed: codes and names in good texts reach twice as far as the other figures.
FENCE = {"chars_per_token": 3.0, "chars_per_piece": 3.0, "fallback_share": 6.0, "token_entropy": 3.0}
GRID, LEAST_TEXTS = 1000, 100
#: Fewer tokens than this say nothing about fertility.
LEAST_TOKENS = 32


@functools.lru_cache(maxsize=2)
def encoder(data: bytes, pattern: str):
    """A tiktoken encoder of the ranks."""
    import tiktoken

    from weft.llm.bpe import read_ranks

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(data), special_tokens={})


@functools.lru_cache(maxsize=2)
def piecer(data: bytes):
    """(a sentencepiece encoder, by id: whether the piece is a single byte)."""
    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_proto=data)
    return made, np.array([made.is_byte(i) for i in range(made.get_piece_size())])


def by_row(flags: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[rows[1:]] - total[rows[:-1]]


def repeated_words(w: Words, width: int = WINDOW) -> np.ndarray:
    """By row, the words in windows that occur twice or more in the row."""
    wins, bounds = w.windows(w.hashes(), width)
    if not len(wins):
        return np.zeros(len(w.first) - 1, np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    _, inverse, counts = np.unique(mix(wins + mix(row.astype(np.uint64))), return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    at = (np.arange(len(wins)) + np.repeat(w.first[:-1] - bounds[:-1], np.diff(bounds)))[twice]
    n = len(w.starts) + 1
    covered = np.cumsum(np.bincount(at, minlength=n) - np.bincount(at + width, minlength=n))[:-1] > 0
    return by_row(covered, w.first)


def repeated_lines(text: str) -> int:
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[str] = set()
    n = 0
    for line in lines:
        n += line in seen and bool(line.strip(" \t\r\x0b\x0c"))
        seen.add(line)
    return n


def entropy(ids: np.ndarray) -> float:
    """The entropy of ids relative to the most that so many can have."""
    if len(ids) < 2:
        return float(len(ids))
    _, counts = np.unique(ids, return_counts=True)
    p = counts / len(ids)
    return float(-(p * np.log(p)).sum() / np.log(min(len(ids), 4096)))


def figures(df: DataFrame, vocabulary: str, pattern: str, pieces_model: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of df: id, lang, script, the rules' counts (n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words), base_failed, n_tokens and
    fertility's FIGURES.  The vocabularies are files on the driver's machine; their
    bytes go to the executors (some 2 MB, whatever the input)."""
    context = df.sparkSession.sparkContext
    held = context.broadcast((Path(vocabulary).read_bytes(), Path(pieces_model).read_bytes()))
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, lang string, script string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, n_tokens bigint, {', '.join(f'{f} double' for f in FIGURES)}"
    names = [x.split()[0] for x in schema.split(", ")]

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        coder = encoder(held.value[0], pattern)
        cutter, single = piecer(held.value[1])
        for a, b in pieces(batch.column(1)):
            part = batch.slice(a, b - a)
            texts = part.column(1).fill_null("")
            w = cut(texts)
            lead = (w.data & 0xC0) != 0x80
            n_words, chars, wide, two = np.diff(w.first), by_row(lead, w.rows), by_row(w.data >= 0xE0, w.rows), by_row((w.data >= 0xC0) & (w.data < 0xE0), w.rows)
            counts = [by_row(lead & ~SPACE[w.data], w.rows), by_row(SYMBOL[w.data], w.rows)]
            repeats = repeated_words(w)
            strings = texts.to_pylist()
            lines = np.array([repeated_lines(t) for t in strings], np.int64)
            failed = (n_words < 20) | (100 * repeats > 30 * n_words)
            n_tokens, found = [], []
            for t, n in zip(strings, chars.tolist(), strict=True):
                ids = coder.encode_to_numpy(t, disallowed_special=())
                own = np.array(cutter.encode(t), np.int64)
                n_tokens.append(len(ids))
                found.append((n / max(1, len(ids)), n / max(1, len(own)), float(single[own].mean()) if len(own) else 0.0, entropy(ids)))
            scripts = np.where(2 * wide > chars, "wide", np.where(2 * (two + wide) > chars, "two-byte", "latin")).tolist()
            columns = [n_words, *counts, lines, repeats, failed, np.array(n_tokens, np.int64), *np.array(found).T]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2).cast(pa.string()), pa.array(scripts, pa.string()), *map(pa.array, columns)], names)

    return map_arrow(df.select(named(id_col).alias("id"), named(text_col).alias("text"), named(lang_col).cast("string").alias("lang")), each, schema)


def fit_bands(found: DataFrame) -> DataFrame:
    """(by: lang or script, name, n, and low_ and high_ of each figure) from
    figures()' rows."""
    known = found.where(f"not base_failed and n_tokens >= {LEAST_TOKENS}")
    each = known.select(F.inline(F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).alias("name")) for c in ("lang", "script")])), *FIGURES)
    texts = each.where("name is not null").distinct()
    places = F.inline(F.array(*[F.struct(F.lit(f).alias("figure"), F.round(F.col(f) * GRID).cast("bigint").alias("bin")) for f in FIGURES]))
    bins = texts.select("by", "name", places).groupBy("by", "name", "figure", "bin").agg(F.count("*").alias("n"))
    order = Window.partitionBy("by", "name", "figure").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = bins.withColumns({"to": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy("by", "name", "figure"))})
    quartile = lambda q: F.min(F.when(F.col("to") >= F.ceil(F.col("all") * F.lit(q)), F.col("bin")))
    ends = ranked.groupBy("by", "name", "figure").agg(F.first("all").alias("n"), quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    far = F.create_map(*[F.lit(x) for pair in FENCE.items() for x in pair])[F.col("figure")]
    spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(1)) * far
    fenced = ends.withColumns({"low": (F.col("q1") - spread) / GRID, "high": (F.col("q3") + spread) / GRID})
    sides = [F.max(F.when(F.col("figure") == f, F.col(side))).alias(f"{side}_{f}") for f in FIGURES for side in ("low", "high")]
    return fenced.groupBy("by", "name").agg(F.max("n").alias("n"), *sides)


def quality(df: DataFrame, vocabulary: str, pattern: str, pieces_model: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", default: dict[str, Band] = DEFAULT) -> DataFrame:
    """One row per row of df: id_col, figures()' counts and figures, band (the
    language or script whose band held) and kept."""
    found = written(figures(df, vocabulary, pattern, pieces_model, id_col, text_col, lang_col))
    bands = written(fit_bands(found).where(F.col("n") >= LEAST_TEXTS))
    out = found
    for by in ("lang", "script"):
        own = bands.where(F.col("by") == by).drop("by", "n").select(F.col("name").alias(by), F.lit(True).alias(f"has_{by}"), *[F.col(f"{side}_{f}").alias(f"{by}_{side}_{f}") for f in FIGURES for side in ("low", "high")])
        out = out.join(few(written(own)), by, "left")
    plain = {"chars_per_token": ("least", "most"), "chars_per_piece": ("piece_least", "piece_most"), "fallback_share": (None, "fallback"), "token_entropy": ("entropy", None)}
    fits = F.lit(True)
    for f, sides in FIGURES.items():
        for side, wanted, field in zip(("low", "high"), sides, plain[f], strict=True):
            if wanted:
                last = F.create_map(*[F.lit(x) for name, band in default.items() for x in (name, getattr(band, field))])[F.col("script")]
                end = F.when(F.col("has_lang"), F.col(f"lang_{side}_{f}")).when(F.col("has_script"), F.col(f"script_{side}_{f}")).otherwise(last)
                value = F.round(F.col(f) * GRID) / GRID
                fits = fits & (value >= end if side == "low" else value <= end)
    kept = ~F.col("base_failed") & (fits | (F.col("n_tokens") < LEAST_TOKENS))
    band = F.when(F.col("has_lang"), F.col("lang")).otherwise(F.col("script"))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_tokens", *FIGURES, band.alias("band"), kept.alias("kept"))
