"""Substring deduplication by Rabin-Karp window hashes (operator 6).

Every window of `width` consecutive words has a 64-bit rolling hash.  A window
is removed from a document if the same window starts in a document of smaller
id.  So that only windows with a chance of being repeated cross the network,
each window also has a key: the smallest hash of its inner grams.  Equal
windows have equal keys, one key serves about twenty windows in a row, and a
key seen in one document only rules all its windows out.

1. Exact copies of a text are represented by their smallest id.
2. keys per document, written; those of two or more documents are hot.
3. hashes of the windows with a hot key; the smallest document of each hash
   (pre-aggregated in each task).  A document's own first windows are its
   exempt list.
4. A document's windows with a hot key that aren't exempt are removed, merged
   into maximal intervals.

The texts are dealt by id once; steps 3 and 4 share that exchange.  No window
leaves unless its key is hot, no group of equal windows is ever gathered, and
memory follows the longest text.  Two different windows of one corpus of 10**9
hot windows share a hash with probability 0.03.

Null texts count as empty: no words, nothing removed.  A row without id keeps
everything and removes nothing elsewhere.  Rows that repeat an id count as one
document's.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import lists, map_arrow, named, written
from weft.llm.words import Words, cut, pieces

WIDTH, GRAM = 50, 12


def sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """The minimum of each run of span neighbours, in log2(span) passes."""
    have = 1
    while have * 2 <= span:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (span - have)], x[span - have :]) if span > have else x


def window_hashes(texts: pa.Array, width: int, gram: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, key of each window, hash of each window, bounds by row)."""
    w = cut(texts)
    h = w.hashes()
    wins, bounds = w.windows(h, width)
    if not len(wins):
        return w, np.empty(0, np.int64), np.empty(0, np.int64), bounds
    grams, at = w.windows(h, gram)
    least = sliding_min(grams, width - gram + 1)
    n = np.diff(bounds)
    keys = least[np.arange(len(wins)) + np.repeat(at[:-1] - bounds[:-1], n)]
    return w, keys.view(np.int64), wins.view(np.int64), bounds


def parts(col: pa.Array) -> list[np.ndarray | None]:
    """The rows of a list column as arrays; null stays None."""
    values, ends = col.values.to_numpy(), col.offsets.to_numpy()
    return [values[a:b] if ok else None for a, b, ok in zip(ends, ends[1:], col.is_valid().to_pylist(), strict=False)]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per row of df: (id_col, n_words, n_removed, kept, removed):
    kept has the words that stay, joined by a space; removed has the maximal
    intervals [first word, end) taken out."""
    kind = df.schema[id_col].dataType.simpleString()
    whole = df.select(named(id_col).alias("id"), named(text_col).alias("text"))
    base = whole.where("id is not null")

    def key_lists(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b in pieces(batch.column(1)):
            _, keys, _, bounds = window_hashes(batch.column(1).slice(a, b - a), width, gram)
            own = [np.unique(keys[s:e]) for s, e in zip(bounds, bounds[1:], strict=False)]
            flat = np.concatenate(own) if own else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists(pa.array(flat), np.concatenate(([0], np.cumsum([len(x) for x in own]))))], ["id", "keys"])

    firsts = base.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256)).agg(F.min("id").alias("id")).select("id").distinct()
    keys = written(map_arrow(base, key_lists, f"id {kind}, keys array<bigint>"))
    rows = keys.join(firsts, "id", "left_semi").select("id", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("key")
    hot = written(rows.join(shared, "key").groupBy("id").agg(F.collect_set("key").alias("hot")))

    def hot_windows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        has = batch.column(2).is_valid()
        batch = batch.filter(has)
        for a, b in pieces(batch.column(1)):
            _, keys, wins, bounds = window_hashes(batch.column(1).slice(a, b - a), width, gram)
            own = [np.unique(wins[s:e][np.isin(keys[s:e], warm)]) for s, e, warm in zip(bounds, bounds[1:], parts(batch.column(2).slice(a, b - a)), strict=False)]
            flat = np.concatenate(own) if own else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists(pa.array(flat), np.concatenate(([0], np.cumsum([len(x) for x in own]))))], ["id", "wins"])

    dealt = base.join(hot, "id", "left")
    wins = map_arrow(dealt.select("id", "text", "hot"), hot_windows, f"id {kind}, wins array<bigint>").select("id", F.explode("wins").alias("win"))
    exempt = wins.groupBy("win").agg(F.min("id").alias("id")).groupBy("id").agg(F.collect_list("win").alias("exempt"))

    def removed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b in pieces(batch.column(1)):
            some = batch.slice(a, b - a)
            w, keys, wins, bounds = window_hashes(some.column(1), width, gram)
            n_words, n_removed, kept, taken = np.diff(w.first), [], [], []
            for r, (warm, free, first, known) in enumerate(zip(parts(some.column(2)), parts(some.column(3)), some.column(4).to_pylist(), some.column(0).is_valid().to_pylist(), strict=True)):
                n, s, e = int(n_words[r]), bounds[r], bounds[r + 1]
                gone = np.zeros(n, bool)
                if known and not first:
                    gone[:] = n >= width
                elif known and warm is not None and e > s:
                    at = np.isin(keys[s:e], warm)
                    if free is not None:
                        at &= ~np.isin(wins[s:e], free)
                    step = np.zeros(n + 1, np.int64)
                    step[: e - s] += at
                    step[width : width + e - s] -= at
                    gone = np.cumsum(step)[:n] > 0
                own = w.data[w.rows[r] : w.rows[r + 1]].tobytes().split()
                if gone.any():
                    own = [own[i] for i in np.flatnonzero(~gone)]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                taken.append([{"first": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.array(n_words.astype(np.int64)), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(taken, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))],
                [id_col, "n_words", "n_removed", "kept", "removed"],
            )

    judged = dealt.join(exempt, "id", "left").join(firsts.withColumn("is_first", F.lit(True)), "id", "left").select("id", "text", "hot", "exempt", "is_first")
    # Rows without id go round the joins: as a key, null would be a hot one.
    free = whole.where("id is null").select("id", "text", *[F.lit(None).cast(judged.schema[c].dataType).alias(c) for c in ("hot", "exempt", "is_first")])
    schema = f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept string, removed array<struct<first: bigint, end: bigint>>"
    return map_arrow(judged.union(free), removed, schema)
