"""Language-model scoring with a probabilistic suffix tree (operator 7).

The tree predicts words, and the end of a text as one more word.  Its root is the
add-one unigram (all unknown words are one symbol); a state is a context of one
or two words before, and a text is scored word by word from the state of the
longest suffix in the tree.  Nothing is kept by its share of the corpus: whatever
follows a context LEAST times is counted, so the tree grows with the corpus.

A context becomes a state if what follows it differs from what follows its own
suffix: the divergence, times the count, must exceed the cost of naming each
follower (the logarithm of the vocabulary, a description-length test).  Suffixes
of states are states.  A state's next-word distribution takes DISCOUNT off each
follower's count and gives what that frees to the suffix's distribution, so that
it sums to 1.

Score and back-off are sums over a text's words, pairs and triples: each known
one has its own term (what it adds to the path through the shorter contexts, and
the back-off weight of the state it becomes).  So scoring is a count of keys by
document and a join with the table of terms:

1. Words and pairs are counted in vectorised form, pre-summed in each task.
2. Triples are counted where both their pairs occur EXTEND times (first by a bit
   table): a longer context grows only out of a shorter one that is not rare.
3. Terms of words, pairs and triples are one table, as large as the tree.  The TOP
   most frequent go to the scoring tasks; the rest are joined by key, after a bit
   table (32 MB at most) has dropped what isn't in the tree.

Words are known by 64-bit hashes in the base score, and by 32 bits of them in the
tree, where two words that share them count as one symbol.

Null and empty texts are the end alone.  Without training texts nothing is known
and the root alone scores.  Every row gets a row; rows that share an id are
documents of their own.  Columns are taken by name, whatever it is; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import few, forget, hot_keys, lists, map_arrow, named, release, salted, settle, written
from weft.llm.words import U, cut, mix, pieces

LEAST, DISCOUNT = 3, 0.75
#: Terms that go to every scoring task at most (some 48 MB): the most frequent.
TOP = 2_000_000
#: Occurrences of both pairs of a triple that is counted.
EXTEND = 4
#: The end of a text, among the hashes of words.
END = U(0x0E0F)
#: What stands for the second word of a key that has one word, or one pair.
WORD, PAIR = -1, -2
#: Distinct keys a task holds before it passes their counts on.
HELD = 1 << 21
#: Bits of the largest bit table, as a power of 2.
MOST_BITS = 28
LOW = 0xFFFFFFFF


class Sums:
    """Counts by 64-bit fingerprint with the columns that it stands for, held up
    to HELD keys."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, prints: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        if len(prints):
            f, at, n = np.unique(prints, return_index=True, return_counts=True)
            self.parts.append((f, n, *(c[at] for c in columns)))
            self.size += len(f)
        if self.size > 2 * HELD:
            self._merge()
            if self.size > HELD:
                yield from self.rest()

    def _merge(self) -> None:
        f, n, *columns = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(f, kind="stable")
        f = f[order]
        first = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
        self.parts = [(f[first], np.add.reduceat(n[order], first), *(c[order][first] for c in columns))]
        self.size = len(first)

    def rest(self) -> Iterator[tuple[np.ndarray, ...]]:
        if self.parts:
            self._merge()
            yield self.parts[0][1:]
            self.parts, self.size = [], 0


def prints(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A fingerprint of keys (a, b)."""
    second = np.asarray(b, np.int64).view(U) if np.ndim(b) else U(int(b) & ((1 << 64) - 1))
    with np.errstate(over="ignore"):
        return mix(a.view(U) + mix(np.atleast_1d(second + U(0x632BE59BD9B4E019))))


def places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word and end, bounds by row, pair key of each place, place
    within its row); the pair of a row's first place means nothing."""
    w = cut(texts, fold=True)
    h = np.insert(w.hashes(), w.first[1:], END)
    bounds = w.first + np.arange(len(w.first))
    code = h >> U(32)
    pair = np.zeros(len(h), U)
    pair[1:] = (code[:-1] << U(32)) | code[1:]
    return h, bounds, pair, np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds))


def _counted(df: DataFrame, each, schema: str) -> DataFrame:
    """each(texts) over the texts of df gives (Sums by kind, fingerprints, columns)."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Sums] = {}

        def out(kind: int, n: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), *(pa.array(c.astype(np.int64, copy=False) if c.dtype != U else c.view(np.int64)) for c in columns), pa.array(n.astype(np.int64))], names)

        for batch in batches:
            for a, b in pieces(batch.column(0)):
                for kind, f, *columns in each(batch.column(0).slice(a, b - a)):
                    for found in held.setdefault(kind, Sums()).add(f, *columns):
                        yield out(kind, *found)
            release()
        for kind, sums in held.items():
            for found in sums.rest():
                yield out(kind, *found)

    rows = df.mapInArrow(run, schema)
    return rows.groupBy(*names[:-1]).agg(F.sum("n").alias("n"))


def count(train: DataFrame) -> DataFrame:
    """(kind, a, n) of the texts of train: kind 0 are words, kind 1 are pairs."""

    def each(texts: pa.Array) -> Iterator[tuple]:
        h, _, pair, place = places(texts)
        own = pair[place > 0]
        yield 0, h, h
        yield 1, own, own

    return _counted(train, each, "kind int, a bigint, n bigint")


def bit_table(keys: DataFrame) -> tuple[int, np.ndarray]:
    """(b, words) for keys (a, b) (written): 2**b bits, set where the fingerprints
    point; eight bits a key, 2**MOST_BITS at most.  The driver receives the words
    that are not 0."""
    bits = max(16, min(MOST_BITS, (8 * keys.count()).bit_length()))

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        slot = prints(batch.column(0).to_numpy(), batch.column(1).to_numpy()) >> U(64 - bits)
        yield pa.RecordBatch.from_arrays([pa.array((slot >> U(6)).astype(np.int64)), pa.array((U(1) << (slot & U(63))).view(np.int64))], ["word", "bit"])

    words = map_arrow(keys.select("a", "b"), each, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(1 << (bits - 6), U)
    table[words["word"].to_numpy()] = words["bit"].to_numpy().view(U)
    return bits, table


def may_have(table: tuple[int, np.ndarray], f: np.ndarray) -> np.ndarray:
    bits, words = table
    slot = f >> U(64 - bits)
    return (words[(slot >> U(6)).astype(np.int64)] >> (slot & U(63))) & U(1) == U(1)


def triples(train: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a: pair, b: the word that follows it, n) where both pairs of a triple may
    be in pairs (a, b)."""
    held = train.sparkSession.sparkContext.broadcast(bit_table(pairs))

    def each(texts: pa.Array) -> Iterator[tuple]:
        _, _, pair, place = places(texts)
        known = may_have(held.value, prints(pair, PAIR)) & (place > 0)
        at = np.flatnonzero(known[1:] & known[:-1] & (place[1:] > 1)) + 1
        before, word = pair[at - 1], pair[at] & U(LOW)
        yield 2, prints(before, word.view(np.int64)), before, word

    return _counted(train, each, "kind int, a bigint, b bigint, n bigint").drop("kind")


def _states(events: DataFrame, keys: list[str], naming: float) -> DataFrame:
    """(keys, freed): contexts whose followers (n, out of `whole`, ln_before by the
    suffix) pass the divergence test, and the share that they leave to the suffix."""
    gain = F.sum(F.col("n") * (F.ln(F.col("n") / F.col("whole")) - F.col("ln_before")))
    taken = F.sum(F.col("n") - F.lit(DISCOUNT)) / F.first("whole")
    each = events.groupBy(*keys).agg(gain.alias("gain"), F.count("*").alias("kinds"), (1 - taken).alias("freed"))
    return each.where(F.col("gain") > F.col("kinds") * F.lit(naming)).select(*keys, "freed")


def _terms(events: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """events of states, with ln_own (their log probability) and term (its
    difference from the path through the suffix, in log10)."""
    inside = salted(events, states, keys, "inner", hot_keys(events, keys))
    own = F.ln((F.col("n") - F.lit(DISCOUNT)) / F.col("whole") + F.col("freed") * F.exp("ln_before"))
    made = inside.withColumn("ln_own", own)
    return made.withColumn("term", (F.col("ln_own") - F.ln("freed") - F.col("ln_before")) / F.lit(math.log(10)))


def grow(train: DataFrame) -> tuple[DataFrame, int, int]:
    """(the tree as terms: a, b, n, base, term; words of the corpus; distinct ones).
    base is log10(n + 1) of a word, null of others."""
    counts = written(count(train).where(f"kind = 0 or n >= {LEAST}"))
    settle(train.sparkSession)
    facts = counts.where("kind = 0").agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = facts["n"] or 0, facts["v"]
    naming, unknown = math.log(distinct + 1), math.log(total + distinct + 1)
    words = counts.where("kind = 0").select("a", "n", F.shiftrightunsigned("a", 32).alias("code"))
    codes = written(words.groupBy("code").agg(F.sum("n").alias("c")))
    # Pairs, with the count of their context and the root's probability of the word.
    pairs = written(counts.where("kind = 1").select("a", F.lit(PAIR).cast("bigint").alias("b"), "n", F.shiftrightunsigned("a", 32).alias("before"), F.col("a").bitwiseAND(LOW).alias("word")))
    root = codes.select(F.col("code").alias("word"), (F.ln(F.col("c") + 1) - F.lit(unknown)).alias("ln_before"))
    whole = codes.select(F.col("code").alias("before"), F.col("c").alias("whole"))
    followed = salted(pairs, root, ["word"], "inner", hot_keys(pairs, ["word"]))
    events = written(salted(followed, whole, ["before"], "inner", hot_keys(pairs, ["before"])).select("a", "before", "n", "whole", "ln_before"))
    states = written(_states(events, ["before"], naming))
    own = written(_terms(events, states, ["before"]).select("a", "n", "ln_own", "term"))
    forget(events)
    # Triples: the pair before is the context, the last pair the suffix's event.
    often = written(pairs.where(F.col("n") >= EXTEND).select("a", "b", "n"))
    counted = written(triples(train, often).where(f"n >= {LEAST}").withColumn("last", F.shiftleft(F.col("a").bitwiseAND(LOW), 32).bitwiseOR(F.col("b"))))
    settle(train.sparkSession)
    suffix = own.where(F.col("n") >= EXTEND).select(F.col("a").alias("last"), F.col("ln_own").alias("ln_before"))
    known = salted(counted, suffix, ["last"], "inner", hot_keys(counted, ["last"]))
    longer = written(salted(known, often.select("a", F.col("n").alias("whole")), ["a"], "inner", hot_keys(counted, ["a"])).select("a", "b", "n", "whole", "ln_before"))
    forget(counted)
    deep = written(_states(longer, ["a"], naming))
    last = _terms(longer, deep, ["a"]).select("a", "b", "n", F.lit(None).cast("double").alias("base"), "term")
    # What a word, or a pair, adds as the context that it becomes.
    log10 = lambda c: F.ln(c) / F.lit(math.log(10))
    back = states.select(F.col("before").alias("code"), log10("freed").alias("back"))
    first = words.join(few(back), "code", "left").select("a", F.lit(WORD).cast("bigint").alias("b"), "n", F.log10(F.col("n") + 1).alias("base"), F.coalesce("back", F.lit(0.0)).alias("term"))
    second = own.select("a", "n", "term").union(deep.join(pairs.select("a", "n"), "a").select("a", "n", log10("freed").alias("term")))
    second = second.groupBy("a").agg(F.max("n").alias("n"), F.sum("term").alias("term")).select("a", F.lit(PAIR).cast("bigint").alias("b"), "n", F.lit(None).cast("double").alias("base"), "term")
    tree = written(first.union(second).union(last))
    forget(counts, codes, pairs, often, states, own, longer, deep)
    return tree, total, distinct


class Known:
    """Terms by fingerprint, in a table of slots; those that share one are apart."""

    def __init__(self, f: np.ndarray, base: np.ndarray, term: np.ndarray):
        order = np.argsort(f)
        self.f, self.base, self.term = f[order], base[order], term[order]
        self.bits = max(10, int(len(f)).bit_length() + 2)
        slot = (self.f >> U(64 - self.bits)).astype(np.int64)
        self.at = np.full(1 << self.bits, -1, np.int32)
        self.at[slot] = np.arange(len(f))
        self.crowded = len(np.unique(slot)) < len(slot)

    def find(self, f: np.ndarray) -> np.ndarray:
        """The place of each fingerprint, or -1."""
        if not len(self.f):
            return np.full(len(f), -1, np.int64)
        at = self.at[(f >> U(64 - self.bits)).astype(np.int64)].astype(np.int64)
        hit = (at >= 0) & (self.f[at] == f)
        out = np.where(hit, at, -1)
        if self.crowded:
            other = np.flatnonzero(~hit & (at >= 0))
            place = np.minimum(np.searchsorted(self.f, f[other]), len(self.f) - 1)
            out[other] = np.where(self.f[place] == f[other], place, -1)
        return out


def score(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """One row per row of df: (id_col, n_tokens, n_known, train_tokens,
    base_score, score); train says which rows may be learnt from."""
    kind = df.schema[id_col].dataType.simpleString()
    tree, total, distinct = grow(df.where(train).select(named(text_col).alias("text")))
    unknown = math.log10(total + distinct + 1)
    ranked = tree.groupBy("n").count().withColumn("up_to", F.sum("count").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)))
    least = ranked.where(F.col("up_to") <= top).agg(F.min("n")).first()[0]
    often = tree.where(F.lit(False) if least is None else F.col("n") >= least).select("a", "b", F.coalesce("base", F.lit(0.0)).alias("base"), "term").toArrow()
    columns = {c: often[c].to_numpy() for c in often.column_names}
    held = df.sparkSession.sparkContext.broadcast((prints(columns["a"], columns["b"]), columns["base"], columns["term"], bit_table(tree)))
    cache: dict[int, Known] = {}

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        *often, table = held.value
        if not cache:  # one table a task: its slots are made once
            cache[0] = Known(*often)
        known = cache[0]
        for a, b in pieces(batch.column(1)):
            h, bounds, pair, place = places(batch.column(1).slice(a, b - a))
            row = np.repeat(np.arange(b - a), np.diff(bounds))
            second, third = np.flatnonzero(place > 0), np.flatnonzero(place > 1)
            word = (pair[third] & U(LOW)).view(np.int64)
            keys = [(row, h, np.full(len(h), WORD)), (row[second], pair[second], np.full(len(second), PAIR)), (row[third], pair[third - 1], word)]
            n, base, term = np.zeros(b - a, np.int64), np.zeros(b - a), np.zeros(b - a)
            rest = []
            for k, (rows, first, last) in enumerate(keys):
                f = prints(first, last)
                at = known.find(f)
                hit = at >= 0
                term += np.bincount(rows[hit], known.term[at[hit]], b - a)
                if k == 0:
                    n += np.bincount(rows[hit], minlength=b - a)
                    base += np.bincount(rows[hit], known.base[at[hit]], b - a)
                more = np.flatnonzero(~hit)
                more = more[may_have(table, f[more])]
                rest.append((rows[more], f[more], first[more], last[more]))
            rows, f, first, last = (np.concatenate(x) for x in zip(*rest, strict=True))
            order = np.lexsort((f, rows))
            rows, f = rows[order], f[order]
            new = np.flatnonzero(np.concatenate(([len(f) > 0], (f[1:] != f[:-1]) | (rows[1:] != rows[:-1]))))
            times = np.diff(np.append(new, len(f)))
            edges = np.searchsorted(rows[new], np.arange(b - a + 1))
            flat = [pa.array(first[order][new].view(np.int64)), pa.array(last[order][new].astype(np.int64)), pa.array(times.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(np.diff(bounds)), pa.array(n), pa.array(base), pa.array(term), *(lists(x, edges) for x in flat)],
                ["id", "row", "n_tokens", "known", "base", "term", "a", "b", "times"],
            )

    source = df.select(named(id_col).alias("id"), named(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    local = written(map_arrow(source, each, f"id {kind}, row bigint, n_tokens bigint, known bigint, base double, term double, a array<bigint>, b array<bigint>, times array<bigint>"))
    rare = local.select("row", F.inline(F.arrays_zip("a", "b", "times")))
    found = rare.join(tree.select("a", "b", "base", "term"), ["a", "b"])
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("base").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.coalesce("base", F.lit(0.0))).alias("more_base"), F.sum(F.col("times") * F.col("term")).alias("more_term")
    )
    out = local.drop("a", "b", "times").join(sums, "row", "left")
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(unknown)
    return out.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        base.alias("base_score"), (base + F.col("term") + F.coalesce("more_term", F.lit(0.0))).alias("score"),
    )
