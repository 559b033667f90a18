"""Benchmark decontamination by q-gram lemma filtering (operator 10).

An item occurs in a text if some part of the text is within `rate` edits a byte
of the whole item (A-Z folded, white space as blanks).  If so, at least
len - q + 1 - edits * q of the item's q-grams occur there, on diagonals that lie
within `edits` of each other.  So q-grams of a text that are in the benchmark
are counted by (item, diagonal band); bands are twice as wide as needed and
overlap by half, so that every such occurrence lies in one.  Bands that meet the
bound are verified by banded alignment.

The benchmark goes to the executors in blocks of at most about BLOCK_BYTES, one
pass over the texts for each; the texts are not shuffled, only found places are.
Texts are handled in slices and so are the places in items that their q-grams
point to (EXPANDED at a time, then summed by band), so memory follows the longest
text, also where texts and items repeat themselves.

Null and empty texts contain nothing; null items and items of fewer than
`least` bytes (a q-gram at least) are not searched, because they say nothing
about their source.  Equal items are found each by their own id, of any type.
Rows that share an id share what is found; null ids are an id of their own.
Columns are taken by place, so that no name can clash.  An empty benchmark finds
nothing.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weft.llm.common import few, map_arrow, named, written
from weft.llm.words import FOLD, SPACE, U, pieces

Q, RATE, LEAST, BLOCK_BYTES = 12, 0.05, 12, 4 << 20
TABLE_BITS = 22
#: Runs of places in items that are held at a time.
EXPANDED = 1 << 17
PLAIN = np.where(SPACE, np.uint8(0x20), FOLD)


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the Q = 12 bytes from each place."""
    if len(data) < Q:
        return np.empty(0, U)
    d = data.astype(np.uint32)
    two = d[:-1] | (d[1:] << np.uint32(8))
    four = two[:-2] | (two[2:] << np.uint32(16))
    eight = four[:-4].astype(U) | (four[4:].astype(U) << U(32))
    return eight[:-4] * U(0x9E3779B97F4A7C15) ^ four[8:].astype(U) * U(0xC2B2AE3D27D4EB4F) << U(13)


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes * U(0xD6E8FEB86659FD93)) >> U(64 - TABLE_BITS)


@dataclass
class Index:
    """The q-grams of a block of items, each with its runs of neighbouring places."""

    items: list[bytes]
    edits: np.ndarray
    bound: np.ndarray  # q-grams that an occurrence shares at least
    table: np.ndarray  # by slot: whether a q-gram may be there
    keys: np.ndarray
    begin: np.ndarray  # of each key's runs, and the end
    item: np.ndarray
    offset: np.ndarray  # of a run's first place
    length: np.ndarray


def index(items: list[bytes], rate: float) -> Index:
    own = [grams(np.frombuffer(x, np.uint8)) for x in items]
    n = np.array([len(g) for g in own])
    flat = np.concatenate(own)
    item = np.repeat(np.arange(len(items)), n)
    offset = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    order = np.argsort(flat, kind="stable")
    flat, item, offset = flat[order], item[order], offset[order]
    fresh = np.concatenate(([True], (flat[1:] != flat[:-1]) | (item[1:] != item[:-1]) | (offset[1:] != offset[:-1] + 1)))
    first = np.flatnonzero(fresh)
    keys, begin = np.unique(flat[first], return_index=True)
    table = np.zeros(1 << TABLE_BITS, bool)
    table[slots(keys)] = True
    edits = np.array([min(int(rate * len(x)), (len(x) - Q) // Q) for x in items])
    return Index(items, edits, n - edits * Q, table, keys, np.append(begin, len(first)), item[first], offset[first], np.diff(np.append(first, len(flat))))


def align(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(edits, start, end) of the best match of the whole item with a part of
    text, over the diagonals low..high (place in text minus place in item)."""
    width = high - low + 1
    padded = np.full(len(item) + width + 1, 256, np.int16)
    a, b = max(0, low), min(len(text), low + len(padded))
    if b > a:
        padded[a - low : b - low] = text[a:b]
    far = len(item) + width
    lane = np.arange(width)
    # Places before the text and after its end cannot be part of a match.
    cost = np.where((lane + low >= 0) & (lane + low <= len(text)), 0, far)
    start = lane + low
    for i, c in enumerate(item):
        ends = (lane + low + i + 1 <= len(text)) & (lane + low + i + 1 >= 0)
        best, origin = cost + (padded[i : i + width] != c), start
        drop = np.append(cost[1:], far) + 1
        take = drop < best
        best, origin = np.where(take, drop, best), np.where(take, np.append(start[1:], 0), origin)
        best = np.where(ends, best, far)
        run = np.minimum.accumulate(best - lane)
        source = np.maximum.accumulate(np.where(best - lane == run, lane, 0))
        cost, start = run + lane, origin[source]
    at = int(np.argmin(cost))
    return int(cost[at]), int(start[at]), int(low + at + len(item))


def occurrences(texts: pa.Array, ix: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, first byte, end, edits), each item once a row and place."""
    texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    rows = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = PLAIN[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[rows[0] : rows[-1]]]
    rows = rows - rows[0]
    g = grams(data)
    at = np.flatnonzero(ix.table[slots(g)])
    place = np.searchsorted(ix.keys, g[at])
    place[place == len(ix.keys)] = 0
    same = ix.keys[place] == g[at]
    at, place = at[same], place[same]
    row = np.searchsorted(rows, at, "right") - 1
    inside = at + Q <= rows[row + 1]
    at, place, row = at[inside], place[inside], row[inside]
    enough = np.bincount(row, minlength=len(rows))[row] >= ix.bound.min()
    at, place, row = at[enough], place[enough], row[enough]
    if not len(at):
        return
    for shift in (0, 1):
        for r, i, band in bands(row, place, at - rows[row], ix, shift):
            k = int(ix.edits[i])
            text, low = data[rows[r] : rows[r + 1]], (2 * band - shift) * (k + 1)
            a, b = max(0, low - k), low + 2 * (k + 1) + len(ix.items[i]) + k
            exact = text[a:b].tobytes().find(ix.items[i])
            if exact >= 0:
                yield r, i, a + exact, a + exact + len(ix.items[i]), 0
                continue
            edits, start, end = align(np.frombuffer(ix.items[i], np.uint8), text, low - k, low + 2 * (k + 1) + k)
            if edits <= k:
                yield r, i, start, end, edits


def bands(row: np.ndarray, place: np.ndarray, offset: np.ndarray, ix: Index, shift: int) -> list[tuple[int, int, int]]:
    """(row, item, band) whose q-grams meet the item's bound, by row, item and
    place; the q-grams stand at offset in their rows and are ix.keys[place].  A
    run of an item's places is counted by the bands that its diagonals cover."""
    ends = np.cumsum(ix.begin[place + 1] - ix.begin[place])
    held: list[np.ndarray] = []  # columns: row, item, band, count
    size = begin = 0
    while begin < len(place):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + EXPANDED, "right")))
        at = place[begin:end]
        m = ix.begin[at + 1] - ix.begin[at]
        run = np.repeat(ix.begin[at] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        wide = 2 * (ix.edits[ix.item[run]] + 1)
        high = np.repeat(offset[begin:end], m) - ix.offset[run] + shift * wide // 2
        low = high - ix.length[run] + 1
        first = low // wide
        k = high // wide - first + 1
        each = np.repeat(np.arange(len(run)), k)
        band = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(k) - k, k)
        count = np.minimum(high[each], (band + 1) * wide[each] - 1) - np.maximum(low[each], band * wide[each]) + 1
        held.append(_summed(np.stack((np.repeat(row[begin:end], m)[each], ix.item[run][each], band, count)), len(ix.items)))
        size += held[-1].shape[1]
        if size > 4 * EXPANDED and len(held) > 1:
            held = [_summed(np.concatenate(held, axis=1), len(ix.items))]
            size = held[0].shape[1]
        begin = end
    found = _summed(np.concatenate(held, axis=1), len(ix.items))
    return [tuple(x) for x in found[:3, found[3] >= ix.bound[found[1]]].T.tolist()]


def _summed(rows: np.ndarray, items: int) -> np.ndarray:
    """Columns (row, item, band, count): counts of equal ones summed, in order."""
    least = rows[2].min()
    code = (rows[0] * items + rows[1]) * (rows[2].max() - least + 1) + rows[2] - least
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    return np.concatenate((rows[:3, first], np.bincount(group, rows[3]).astype(np.int64)[None]))


@functools.lru_cache(maxsize=1)
def _index(items: tuple[bytes, ...], rate: float) -> Index:
    return index(list(items), rate)


def find(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (id_col, item_id, start, end, edits): places in characters, end
    exclusive, of each item's occurrences in each text."""
    spark = df.sparkSession
    items = benchmark.select(named(item_col).alias("item"), named(item_text_col).alias("text")).where(F.octet_length("text") >= max(least, Q)).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    kind, item_kind = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, item_id {item_kind}, start bigint, end bigint, edits bigint"
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    passes = []
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        if not own:
            continue
        held = spark.sparkContext.broadcast(([r["item"] for r in own], tuple(PLAIN[np.frombuffer(r["text"].encode(), np.uint8)].tobytes() for r in own)))

        def each(batch: pa.RecordBatch, held=held) -> Iterator[pa.RecordBatch]:
            names, texts = held.value
            ix = _index(texts, rate)
            for a, b in pieces(batch.column(1)):
                part = batch.column(1).slice(a, b - a)
                seen, out, last = set(), [], -1
                for r, i, start, end, edits in occurrences(part, ix):
                    if r != last:
                        raw = np.frombuffer((part[r].as_py() or "").encode(), np.uint8)
                        lead, last = np.cumsum(np.concatenate(([0], (raw & 0xC0) != 0x80))), r
                    span = (r, i, int(lead[start]), int(lead[end]))
                    if span not in seen:
                        seen.add(span)
                        out.append((*span, edits))
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([a + r for r in columns[0]])), pa.array([names[i] for i in columns[1]], item_type), *[pa.array(c, pa.int64()) for c in columns[2:]]],
                        [id_col, "item_id", "start", "end", "edits"],
                    )

        passes.append(map_arrow(df.select(named(id_col).alias("id"), named(text_col).alias("text")), each, schema))
    if not passes:
        return spark.createDataFrame([], schema)
    return functools.reduce(DataFrame.union, passes)


def by_document(df: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per row of df: (id_col, contaminated, hits array by item and place)."""
    hits = found.groupBy(named(id_col).alias("__id")).agg(F.array_sort(F.collect_set(F.struct("item_id", "start", "end", "edits"))).alias("hits"))
    out = df.select(named(id_col).alias("id")).join(hits, F.col("id").eqNullSafe(F.col("__id")), "left")
    none = F.array().cast(hits.schema["hits"].dataType)
    return out.select(F.col("id").alias(id_col), F.col("hits").isNotNull().alias("contaminated"), F.coalesce("hits", none).alias("hits"))


def keep_clean(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df, all columns, in whose text no item occurs; of rows that
    share an id, all go if one does."""
    gone = written(find(df, benchmark, id_col, text_col, **options).select(named(id_col).alias("gone")).distinct())
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    own = F.col(f"c{df.columns.index(id_col)}")
    return plain.join(few(gone), own.eqNullSafe(F.col("gone")), "left_anti").toDF(*df.columns)
