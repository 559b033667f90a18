import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.llm import words
from weft.llm.spans import running, spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(st.sampled_from("aAbé漢😀 \n\t\x0b."), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words(texts):
    w = words.cut(pa.array(texts, pa.string()))
    assert len(w.first) == len(texts) + 1
    for r, text in enumerate(texts):
        got = [w.data[w.starts[i] : w.ends[i]].tobytes().decode() for i in range(w.first[r], w.first[r + 1])]
        assert got == WORD.findall(text or "")


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6), st.integers(1, 4))
def test_windows(texts, width):
    w = words.cut(pa.array(texts), fold=True)
    hashes, bounds = w.windows(w.hashes(), width)
    seen = {}
    for r, text in enumerate(texts):
        own = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        runs = [tuple(own[i : i + width]) for i in range(len(own) - width + 1)]
        got = hashes[bounds[r] : bounds[r + 1]].tolist()
        assert len(got) == len(runs)
        for run, h in zip(runs, got, strict=True):
            assert seen.setdefault(run, h) == h
    assert len(set(seen.values())) == len(seen)


def test_slices_of_arrays_and_long_words():
    whole = pa.array(["a b", None, "c", "x" * 700_000 + " y", ""])
    assert [len(words.cut(whole.slice(i, 1)).starts) for i in range(5)] == [2, 0, 1, 2, 0]
    assert words.cut(whole.slice(2, 1)).hashes()[0] == words.cut(pa.array(["c"])).hashes()[0]
    long = words.cut(whole.slice(3, 1)).hashes()
    assert long[1] == words.cut(pa.array(["y"])).hashes()[0] and long[0] != long[1]
    assert list(words.pieces(whole, 10)) == [(0, 3), (3, 4), (4, 5)] or sum(b - a for a, b in words.pieces(whole, 10)) == 5


def test_running_sums(spark):
    rng = np.random.default_rng(1)
    rows = [(rng.integers(0, 9, n).tolist(),) for n in (0, 1, 5, 256, 257, 2000)]
    df = spark.createDataFrame(rows, "v array<int>")
    for v, got in df.select("v", running(F.col("v"))).collect():
        assert got == np.cumsum(v).tolist()


def test_spans(spark):
    texts = ["", "none", "12 é😀34", "1", "a1b22c333", " 9" * 700]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, got in df.select("t", spans(F.col("t"), F.lit("[0-9]+"))).collect():
        assert [(s["start"], s["end"], s["text"]) for s in got] == [(*m.span(), m[0]) for m in re.finditer("[0-9]+", t)]
