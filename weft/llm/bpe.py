"""Byte-level BPE encoding and decoding (operator 5).

Ranks are turned into a model of the tokenizers library: bytes become the
printable characters of the usual byte table, and every split of a token into
two tokens becomes a merge of that token's rank.  Pieces of the split pattern
are encoded by the library, once per Python worker, and remembered; its ids and,
where asked for, its offsets are the result.  A merge list cannot order two
merges that make one token; where they overlap (s1 s2 s3 with s1 s2 = s2 s3, in
strings that repeat themselves) the leftmost goes first by the ranks' rule, and
the rare pieces that hold such a string are encoded by tiktoken.  Ids leave as
Arrow lists; decoding gathers token bytes through the reversed table.  No shuffle
takes place.

Null texts encode as empty ones, and empty texts as no ids.  Ids that are not in
the vocabulary raise an error on decoding.  Repeated rows are encoded alike.
Columns are taken by place, whatever their names, and those not named are not read.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import lists, map_arrow, named
from weft.llm.words import pieces as row_ranges

#: Pieces that one Python worker remembers; beyond it, memory starts anew.
REMEMBERED = 250_000


def byte_table() -> list[str]:
    """The character that stands for each byte: itself where printable, else
    the next free one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    table = [""] * 256
    for b in own:
        table[b] = chr(b)
    for i, b in enumerate(rest):
        table[b] = chr(256 + i)
    return table


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def model(ranks: dict[bytes, int]):
    """A Tokenizer whose BPE merges follow the ranks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, models, pre_tokenizers

    table = byte_table()
    shown = {token: "".join(map(table.__getitem__, token)) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        splits = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        merges += [(shown[a], shown[b]) for a, b in sorted(splits, key=lambda s: (ranks[s[0]], ranks[s[1]]))]
    made = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return made


def ties(ranks: dict[bytes, int]) -> list[bytes]:
    """The strings s1 s2 s3 in which two different merges make one token."""
    out = set()
    for token in ranks:
        for n in range(1, len(token)):
            s1, s2, s3 = token[:-n], token[-n:], token[n:]
            if token[:n] == s2 and s1 != s2 and {s1, s2, s3} <= ranks.keys():
                out.add(s1 + s2 + s3)
    return sorted(out)


class Pieces(dict):
    """piece -> its ids as packed int32; places has their first characters and
    ends in the piece, where offsets are asked for."""

    def __init__(self, data: bytes, pattern: str):
        import ahocorasick
        import regex
        import tiktoken

        ranks = read_ranks(data)
        self.split = regex.compile(pattern).findall
        self.tokenizer = model(ranks)
        self.exact = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tied = ahocorasick.Automaton()
        for t in ties(ranks):
            self.tied.add_word(t.decode("latin-1"), True)
        if len(self.tied):
            self.tied.make_automaton()
        self.width = token_bytes(data)[2]
        self.places: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.by_rank = 0

    def has_tie(self, piece: str) -> bool:
        return len(self.tied) > 0 and next(self.tied.iter(piece.encode().decode("latin-1")), None) is not None

    def learn(self, own: set[str], offsets: bool = False) -> None:
        if len(self) + len(own) > REMEMBERED:
            self.clear()
            self.places.clear()
        order = [p for p in own if p not in (self.places if offsets else self)]
        for piece, got in zip(order, self.tokenizer.encode_batch(order, add_special_tokens=False), strict=True):
            ids, tied = got.ids, len(got.ids) > 1 and self.has_tie(piece)
            if tied:
                ids, self.by_rank = self.exact._encode_single_piece(piece), self.by_rank + 1
            packed = np.array(ids, np.int32)
            self[piece] = packed.tobytes()
            if offsets:
                at = np.array(got.offsets, np.int32).reshape(-1, 2)
                self.places[piece] = char_spans(piece, self.width[packed]) if tied else (at[:, 0], at[:, 1])

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            own = self.split(text)
            try:
                out.append(b"".join(map(self.__getitem__, own)))
            except KeyError:
                self.learn(set(own))
                out.append(b"".join(map(self.__getitem__, own)))
        return out

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character and end (exclusive) of a text's tokens; a token of part
        of a character covers that character."""
        own = self.split(text)
        if any(p not in self.places for p in own):
            self.learn(set(own), offsets=True)
        starts, ends, at = [np.empty(0, np.int32)], [np.empty(0, np.int32)], 0
        for p in own:
            a, b = self.places[p]
            starts.append(a + at)
            ends.append(b + at)
            at += len(p)
        return np.concatenate(starts), np.concatenate(ends)


@functools.lru_cache(maxsize=2)
def pieces_of(data: bytes, pattern: str) -> Pieces:
    return Pieces(data, pattern)


@functools.lru_cache(maxsize=2)
def token_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all tokens' bytes, each id's first byte there, its length or -1 for ids
    that the ranks skip)."""
    ranks = read_ranks(data)
    order = sorted(ranks, key=ranks.get)
    first, length = np.zeros(ranks[order[-1]] + 1, np.int64), np.full(ranks[order[-1]] + 1, -1, np.int64)
    at = 0
    for token in order:
        first[ranks[token]], length[ranks[token]] = at, len(token)
        at += len(token)
    return np.frombuffer(b"".join(order), np.uint8), first, length


def gather(ids: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of ids, one after another; where each id's bytes end)."""
    blob, first, length = token_bytes(data)
    if len(ids) and (ids.min() < 0 or ids.max() >= len(length) or length[ids].min() < 0):
        raise ValueError("an id is not in the vocabulary")
    n = length[ids]
    ends = np.cumsum(n)
    return blob[np.repeat(first[ids] - (ends - n), n) + np.arange(n.sum())], ends


def char_spans(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of consecutive tokens of so many
    bytes; a token of part of a character covers that character."""
    raw = np.frombuffer(text.encode(), np.uint8)
    begins = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    ends = np.cumsum(lengths)
    return np.maximum(begins[np.minimum(ends - lengths + 1, len(raw))] - 1, 0), begins[ends]


def _taken(df: DataFrame, *names: str) -> tuple[DataFrame, list[str], str]:
    """The columns of those names as c0, c1, ..., and all but c1 as a schema."""
    plain = df.select(*[named(c).alias(f"c{i}") for i, c in enumerate(names)])
    kept = [f"c{i}" for i in range(len(names)) if i != 1]
    return plain, kept, ", ".join(f"{c} {plain.schema[c].dataType.simpleString()}" for c in kept)


def encode(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, extra columns, ids array<int>), one row per row of df; with
    offsets also starts and ends array<int>, in characters of the text.

    vocabulary is a file of base64 tokens and ranks on the driver's machine; its
    bytes go to the executors (about 1 MB, whatever the input)."""
    data = Path(vocabulary).read_bytes()
    held = df.sparkSession.sparkContext.broadcast(data)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = pieces_of(held.value, pattern)
        for a, b in row_ranges(batch.column(1)):
            texts = ["" if t is None else t for t in batch.column(1).slice(a, b - a).to_pylist()]
            coded = known.encode(texts)
            flat = np.frombuffer(b"".join(coded), np.int32)
            bounds = np.concatenate(([0], np.cumsum([len(c) // 4 for c in coded])))
            columns = [batch.column(0).slice(a, b - a), *[c.slice(a, b - a) for c in batch.columns[2:]], lists(pa.array(flat), bounds)]
            if offsets:
                spans = [known.spans(t) for t in texts]
                columns += [lists(pa.array(np.concatenate([x[k] for x in spans]).astype(np.int32)), bounds) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *made])

    plain, kept, schema = _taken(df, id_col, text_col, *extra)
    made = ["ids", *(["starts", "ends"] if offsets else [])]
    return map_arrow(plain, each, ", ".join([schema, *[f"{m} array<int>" for m in made]])).toDF(id_col, *extra, *made)


def _decoded(ids: np.ndarray, sizes: np.ndarray, data: bytes) -> pa.Array:
    """The bytes of consecutive ids, cut into rows of so many ids."""
    raw, ends = gather(ids, data)
    bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])


def round_trip(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """decode(encode(df)) in one Arrow pass: (id_col, extra columns, ids, decoded
    binary), with one Python worker a task instead of two."""
    held = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = pieces_of(held.value, pattern)
        for a, b in row_ranges(batch.column(1)):
            coded = known.encode(["" if t is None else t for t in batch.column(1).slice(a, b - a).to_pylist()])
            flat = np.frombuffer(b"".join(coded), np.int32)
            sizes = np.array([len(c) // 4 for c in coded])
            columns = [batch.column(0).slice(a, b - a), *[c.slice(a, b - a) for c in batch.columns[2:]]]
            yield pa.RecordBatch.from_arrays([*columns, lists(pa.array(flat), np.concatenate(([0], np.cumsum(sizes)))), _decoded(flat, sizes, held.value)], [*kept, "ids", "decoded"])

    plain, kept, schema = _taken(df, id_col, text_col, *extra)
    return map_arrow(plain, each, schema + ", ids array<int>, decoded binary").toDF(id_col, *extra, "ids", "decoded")


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids", extra: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, extra columns, ids, decoded binary): the bytes of each row's ids.
    Characters that tokens split come together again because bytes are joined
    before anything reads them as text; a null list decodes as empty."""
    held = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        whole = batch.column(1)
        step = max(1, len(whole) * 250_000 // max(1, len(whole.flatten())))
        for a in range(0, len(whole), step):
            part = whole.slice(a, step)
            sizes = np.array([len(x) if x.is_valid else 0 for x in part], np.int64)
            decoded = _decoded(part.flatten().to_numpy(), sizes, held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, step), *[c.slice(a, step) for c in batch.columns[2:]], part, decoded], [*kept, "ids", "decoded"])

    plain, kept, schema = _taken(df, id_col, ids_col, *extra)
    return map_arrow(plain, each, schema + ", ids array<int>, decoded binary").toDF(id_col, *extra, ids_col, "decoded")


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of decode()'s rows."""
    return coded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
