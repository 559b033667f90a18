"""Toxicity by maximum-scoring segments (operator 2).

Learning (a bounded, documented sample of labelled rows: the `sample` ids of
least hash; half of their texts, by a sketch's hash, for the lexicon, half to
calibrate; texts that agree on the sketch, as copies do, count once, as most of
their labels say): each token's log-odds between toxic and clean texts under a Dirichlet prior
whose pseudo-counts follow the token's share of all texts.  Words count
by themselves and by their first letters, so that rare forms of a stem count
together.  Forms whose log-odds lie `z` standard
errors and a factor of two from 0 are the lexicon; a token scores as the higher of its forms, and
every other token costs `cost`.  Then the expected score of a token of clean text is negative, so
the best segment of clean text follows an extreme-value law, with lambda from
the token scores and K from the segments of clean calibration texts (but for the
TRIM of them that score highest, where labels may be wrong).

Scoring is one narrow pass: the linear-time scan for all maximal segments
(Ruzzo-Tompa) over the tokens in the lexicon, the costs between them summed;
a segment of score s among n tokens is expected exp(-x) times in clean text,
x = lambda * s - ln(K * n).  Positive x are summed over a text, and a logistic
curve in the logarithm of 1 + that sum, fitted on the calibration half, gives the
probability: long texts with many passages don't bend it.

The lexicon and the curve are the only data sent to executors; the lexicon has
at most `sample` * 1000 tokens and in fact those seen in `least` texts.  The
driver receives tokens seen in `least` texts, how often each score was drawn,
and two numbers for each calibration text.  Nothing depends on the order or the
partitioning of rows: counts are whole numbers, and sums of fractions are exact
(fsum).

Null and empty texts score as texts without evidence.  Labels that are null are
left out; of contradicting labels the more frequent counts, toxic on ties.  Without any label of
either kind every text scores 0 and the lexicon is empty.  Rows that repeat an
id are scored one by one, from their text alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import id_crc, map_arrow, named, written
from weft.llm.words import cut, pieces

SAMPLE, LEAST, Z, COST, PRIOR = 20_000, 5, 3.0, 0.1, 200.0
#: Log-odds of a factor of two: what differs by less is no sign of toxicity, however
#: certain, but adds up over long texts.
LEAST_ODDS = math.log(2)
#: Share of the clean calibration texts that are left out of the extreme-value fit:
#: those of most positive score a token, which may be mislabelled.
TRIM = 0.05
#: Letters of a stem.
STEM = 4
TOKEN = re.compile(r"\w+").findall


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    cost: float = COST
    lam: float = 1.0
    k: float = 1.0
    bias: float = -30.0
    slope: float = 0.0


def maximal(at: list[int], scores: list[float], cost: float) -> list[tuple[int, int, float]]:
    """All maximal segments (first token, end, score), Ruzzo and Tompa: scored
    tokens stand at the places `at`; each token between two of them costs cost.
    Every token is pushed and merged once."""
    held: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum through
    total, last = 0.0, -1
    for place, s in zip(at, scores, strict=True):
        total -= cost * (place - last - 1)
        last = place
        if s <= 0:
            total += s
            continue
        first, left, right = place, total, total + s
        total = right
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j -= 1
            if j < 0 or held[j][3] >= right:
                held.append((first, place + 1, left, right))
                break
            first, left = held[j][0], held[j][2]
            del held[j:]
    return [(a, b, right - left) for a, b, left, right in held]


def log_odds(rows: list[tuple[str, int, int]], n1: int, n0: int, z: float, prior: float) -> dict[str, float]:
    """token -> log-odds for tokens of (token, toxic texts, clean texts) that
    differ by z standard errors."""
    out = {}
    for token, y1, y0 in rows:
        a = prior * (y1 + y0) / (n1 + n0)
        one, zero = (y1 + a) / (n1 + prior - y1 - a + 1), (y0 + a) / (n0 + prior - y0 - a + 1)
        d = math.log(one / zero)
        if abs(d) > max(LEAST_ODDS, z * math.sqrt(1 / (y1 + a) + 1 / (y0 + a))):
            out[token] = d
    return out


def karlin(scores: list[tuple[float, float]]) -> float:
    """The positive root of sum p * exp(x * s) = 1 over (p, s)."""
    if not any(s > 0 and p > 0 for p, s in scores):
        return 1.0
    top = max(s for _, s in scores)

    def f(x: float) -> float:
        return math.fsum(p * math.exp(min(x * s, 700)) for p, s in scores) - 1

    low, high = 1e-6, 1e-3
    while f(high) < 0 and high * top < 600:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def evidence(segments: list[tuple[int, int, float]], n: int, m: Model) -> list[float]:
    """Each segment's -ln of its expected number in n tokens of clean text."""
    floor = math.log(max(m.k * max(n, 1), 1e-300))
    return [m.lam * s - floor for _, _, s in segments]


def logistic(rows: list[tuple[float, int]], steps: int = 50) -> tuple[float, float]:
    """(bias, slope >= 0) by Newton's method, with a weak prior."""
    a, b = 0.0, 0.0
    for _ in range(steps):
        ga, gb, haa, hab, hbb = -0.01 * a, -0.01 * b, 0.01, 0.0, 0.01
        for x, y in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
            w = p * (1 - p)
            ga, gb = ga + y - p, gb + (y - p) * x
            haa, hab, hbb = haa + w, hab + w * x, hbb + w * x * x
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        a, b = a + max(-2.0, min(2.0, (hbb * ga - hab * gb) / det)), b + max(-2.0, min(2.0, (haa * gb - hab * ga) / det))
    return a, max(b, 0.0)


def tokens_of(text: str | None) -> list[str]:
    return TOKEN(text.lower()) if text else []


def stem(word: str) -> str:
    return f"{word[:STEM]}*"


def scored(words: list[str], lexicon: dict[str, float]) -> tuple[list[int], list[float]]:
    """Places and scores of the tokens with a form in the lexicon."""
    at, scores = [], []
    for i, word in enumerate(words):
        own = lexicon.get(word)
        shared = lexicon.get(word[:STEM] + "*") if len(word) > STEM else None
        if own is not None or shared is not None:
            at.append(i)
            scores.append(own if shared is None else shared if own is None else max(own, shared))
    return at, scores


def crowd(words: list[str], lexicon: dict[str, float]) -> float:
    """Positive score a token."""
    return math.fsum(s for s in scored(words, lexicon)[1] if s > 0) / max(1, len(words))


def sketch(texts: pa.Array) -> np.ndarray:
    """The least hash of each text's runs of three words (of all its words, if they
    are fewer): near copies mostly agree on it."""
    w = cut(texts, fold=True)
    h = w.hashes()
    wins, bounds = w.windows(h, 3)
    out = np.zeros(len(texts), np.int64)
    for r in range(len(texts)):
        own = wins[bounds[r] : bounds[r + 1]] if bounds[r + 1] > bounds[r] else h[w.first[r] : w.first[r + 1]]
        out[r] = own.min().view(np.int64) if len(own) else 0
    return out


def half_of(key: Column) -> Column:
    """Which half of the sample a text is in: 0 for the lexicon, 1 to calibrate."""
    return F.pmod(F.xxhash64(key, F.lit(7)), F.lit(2)).cast("int")


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, least: int = LEAST, z: float = Z, cost: float = COST, prior: float = PRIOR) -> Model:
    """labels: the rows that may be learnt from (id_col, label_col)."""
    known = labels.where(named(id_col).isNotNull() & named(label_col).isNotNull()).groupBy(named(id_col).alias("__id")).agg((F.avg(named(label_col)) >= 0.5).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = df.select(named(id_col).alias("__id"), named(text_col).alias("text"))
    texts = rows.join(F.broadcast(chosen), "__id").groupBy("text").agg((F.avg("y") >= 0.5).cast("int").alias("y"))

    def keyed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b in pieces(batch.column(0)):
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([pa.array(sketch(part.column(0))), *part.columns], ["key", "text", "y"])

    groups = map_arrow(texts, keyed, "key bigint, text string, y int").groupBy("key").agg(F.min("text").alias("text"), (F.avg("y") >= 0.5).cast("int").alias("y"))
    picked = written(groups.select("text", "y", half_of(F.col("key")).alias("half")))

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b in pieces(batch.column(0)):
            seen: dict[int, Counter] = {}
            for text, y in zip(*(c.slice(a, b - a).to_pylist() for c in batch.columns), strict=True):
                words = set(tokens_of(text))
                own = words | {stem(w) for w in words if len(w) > STEM} | {""}  # "" counts the texts
                seen.setdefault(y, Counter()).update(own)
            for y, c in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([y] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["token", "y", "n"])

    counted = map_arrow(picked.where("half = 0").select("text", "y"), count, "token string, y int, n bigint").groupBy("token").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("y1"), F.sum(F.when(F.col("y") == 1, 0).otherwise(F.col("n"))).alias("y0"))
    got = counted.where(f"y1 + y0 >= {least} or token = ''").collect()
    n1, n0 = next(((r["y1"], r["y0"]) for r in got if r["token"] == ""), (0, 0))
    if not n1 or not n0:
        return Model()
    m = Model(log_odds([(r["token"], r["y1"], r["y0"]) for r in got if r["token"]], n1, n0, z, prior), cost)
    low = min([s for s in m.lexicon.values() if s > 0], default=1.0)
    rest = picked.where("half = 1")
    context = df.sparkSession.sparkContext
    lexicon = context.broadcast(m.lexicon)

    def density(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b in pieces(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array([crowd(tokens_of(t), lexicon.value) for t in batch.column(0).slice(a, b - a).to_pylist()], pa.float64())], ["x"])

    clean = rest.where("y <> 1").select("text")
    crowded = sorted(r["x"] for r in map_arrow(clean, density, "x double").collect())
    most = crowded[math.ceil(len(crowded) * (1 - TRIM)) - 1] if crowded else 0.0

    def draw(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Of clean texts: how often each score occurs; under null, the tokens;
        under infinity, the segments of at least the least positive score."""
        drawn: Counter = Counter()
        for a, b in pieces(batch.column(0)):
            for text in batch.column(0).slice(a, b - a).to_pylist():
                words = tokens_of(text)
                if crowd(words, lexicon.value) > most:
                    continue
                at, scores = scored(words, lexicon.value)
                drawn.update(scores)
                drawn[None] += len(words)
                drawn[math.inf] += sum(s >= low for *_, s in maximal(at, scores, cost))
        if drawn:
            yield pa.RecordBatch.from_arrays([pa.array(list(drawn), pa.float64()), pa.array(list(drawn.values()), pa.int64())], ["score", "n"])

    drawn = {r["score"]: r["n"] for r in map_arrow(clean, draw, "score double, n bigint").groupBy("score").agg(F.sum("n").alias("n")).collect()}
    total, found = drawn.pop(None, 0), drawn.pop(math.inf, 0)
    if total:
        rare = [(0.5 / total, s) for s in sorted({s for s in m.lexicon.values() if s > 0} - set(drawn))]
        probs = [(c / total, s) for s, c in sorted(drawn.items())] + rare
        m.lam = karlin([*probs, (max(0.0, 1 - math.fsum(p for p, _ in probs)), -cost)])
        m.k = (found + 0.5) / (total * math.exp(-m.lam * low))
    held = context.broadcast(m)

    def calibrate(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b in pieces(batch.column(0)):
            sums = [math.log1p(probability(text, held.value)[1]) for text in batch.column(0).slice(a, b - a).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.float64()), batch.column(1).slice(a, b - a)], ["x", "y"])

    points = sorted((r["x"], int(r["y"] == 1)) for r in map_arrow(rest.select("text", "y"), calibrate, "x double, y int").collect())
    m.bias, m.slope = logistic(points) if {y for _, y in points} == {0, 1} else (m.bias, m.slope)
    return m


def probability(text: str | None, m: Model) -> tuple[float, float, list[tuple[tuple[int, int, float], float]]]:
    """(probability, evidence, significant segments with their own evidence)."""
    words = tokens_of(text)
    segments = maximal(*scored(words, m.lexicon), m.cost)
    facts = [(s, x) for s, x in zip(segments, evidence(segments, len(words), m), strict=True) if x > 0]
    total = math.fsum(x for _, x in facts)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, m.bias + m.slope * math.log1p(total))))), total, facts


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: (id_col, score, evidence, passages array<struct<
    first_token, end_token: bigint, expected: double>>): the passages expected
    less than once in clean text of that length."""
    held = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = held.value
        for a, b in pieces(batch.column(1)):
            scores, sums, passages = [], [], []
            for text in batch.column(1).slice(a, b - a).to_pylist():
                p, total, facts = probability(text, m)
                scores.append(p)
                sums.append(total)
                passages.append([{"first_token": s[0], "end_token": s[1], "expected": math.exp(-x)} for s, x in facts])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(scores, pa.float64()), pa.array(sums, pa.float64()), pa.array(passages, pa.list_(pa.struct([("first_token", pa.int64()), ("end_token", pa.int64()), ("expected", pa.float64())])))],
                [id_col, "score", "evidence", "passages"],
            )

    return map_arrow(df.select(named(id_col).alias("id"), named(text_col).alias("text")), each, f"`{id_col}` {kind}, score double, evidence double, passages array<struct<first_token: bigint, end_token: bigint, expected: double>>")


def keep(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of df, all columns, whose text scores below threshold."""
    held = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b in pieces(batch.column(at)):
            part = batch.slice(a, b - a)
            yield part.filter(pa.array([probability(t, held.value)[0] < threshold for t in part.column(at).to_pylist()], pa.bool_()))

    # By place, because Arrow maps look columns up by name, dots included.
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return map_arrow(plain, each, plain.schema).toDF(*df.columns)


def training(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labelled rows that may be learnt from: crc32 of the id mod 5 is not 0."""
    return labels.where(id_crc(named(id_col)) % 5 != 0)
