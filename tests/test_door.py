import math

import numpy as np
import pytest

from weft.operators import door

NAN = float("nan")


def block(spark, rows, segments=None, unit="u"):
    data = [(unit, i, *[float(v) for v in r], (segments or [1] * len(rows))[i]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "unit string, ord long, f1 double, f2 double, seg int")


def values(df):
    return [(r["f1"], r["f2"]) for r in df.orderBy("unit", "ord").collect()]


def same(got, want):
    assert np.allclose(np.array(got, float), np.array(want, float), equal_nan=True)


def smooth(f, df, **kw):
    return f(df, ["unit"], ["ord"], ["f1", "f2"], **kw)


def test_lookback(spark):
    rows = [(1, 0), (2, 1), (3, 0), (4, 2), (5, 1)]
    same(values(smooth(door.lookback, block(spark, rows), size=2)), [(1, 0), (3, 1), (5, 1), (7, 2), (9, 3)])
    same(values(smooth(door.lookback, block(spark, rows[:3]), size=2, mean=True)), [(1, 0), (1.5, 0.5), (2.5, 0.5)])


def test_lookback_missing(spark):
    rows = block(spark, [(1, 1), (NAN, 3), (5, NAN)])
    same(values(smooth(door.lookback, rows, size=3)), [(1, 1), (1, 4), (6, 4)])
    same(values(smooth(door.lookback, rows, size=3, mean=True)), [(1, 1), (1, 2), (3, 2)])
    empty = block(spark, [(NAN, NAN)])
    same(values(smooth(door.lookback, empty)), [(0, 0)])
    assert math.isnan(values(smooth(door.lookback, empty, mean=True))[0][0])


def test_lookback_segments_are_runs(spark):
    rows = block(spark, [(1, 0), (2, 0), (10, 5), (20, 5)], [1, 1, 2, 2])
    same(values(smooth(door.lookback, rows, size=3, segment="seg")), [(1, 0), (3, 0), (10, 5), (30, 10)])
    rows = block(spark, [(1, 0), (2, 0), (4, 0), (8, 0)], [1, 1, 2, 1])
    same(values(smooth(door.lookback, rows, size=4, segment="seg")), [(1, 0), (3, 0), (4, 0), (8, 0)])


def test_lookback_linear(spark):
    rows = block(spark, [(1, 1), (2, 2), (3, 3)])
    same(values(smooth(door.lookback, rows, size=2, linear=True)), [(1, 1), (5, 5), (8, 8)])
    same(values(smooth(door.lookback, rows, size=2, linear=True, mean=True)), [(1, 1), (5 / 3, 5 / 3), (8 / 3, 8 / 3)])


def direct(rows, k, mean, linear):
    out = []
    for i in range(len(rows)):
        first = max(0, i - k + 1)
        line = []
        for c in range(2):
            cells = [(rows[j][c], j - first + 1 if linear else 1) for j in range(first, i + 1) if not math.isnan(rows[j][c])]
            top, weight = sum(v * w for v, w in cells), sum(w for _, w in cells)
            line.append((top / weight if weight else NAN) if mean else top)
        out.append(line)
    return out


@pytest.mark.parametrize("mean", [False, True])
@pytest.mark.parametrize("linear", [False, True])
def test_lookback_by_unit(spark, mean, linear):
    rng = np.random.default_rng(3)
    tables, want = [], []
    for u, k in (("a", 3), ("b", 7), ("c", None)):
        rows = [tuple(NAN if rng.random() < 0.2 else float(v) for v in rng.integers(0, 9, 2)) for _ in range(30)]
        tables.append(block(spark, rows, unit=u))
        want += direct(rows, k or 20, mean, linear)
    sizes = spark.createDataFrame([("a", 3), ("b", 7)], "unit string, size int")
    got = door.lookback_by_unit(tables[0].union(tables[1]).union(tables[2]), sizes, ["unit"], ["ord"], ["f1", "f2"], mean=mean, linear=linear)
    same(values(got), want)


def test_ema(spark):
    same(values(smooth(door.ema, block(spark, [(10, 0), (0, 10), (0, 0)]), alpha=0.5)), [(10, 0), (5, 5), (2.5, 2.5)])
    same(values(smooth(door.ema, block(spark, [(10, 0), (NAN, 10), (0, NAN)]), alpha=0.5)), [(10, 0), (10, 5), (5, 5)])
    same(values(smooth(door.ema, block(spark, [(NAN, 1), (1, 1), (2, 1)]), alpha=0.5)), [(NAN, 1), (NAN, 1), (NAN, 1)])
    same(values(smooth(door.ema, block(spark, [(1, 1), (5, 5)]), alpha=1)), [(1, 1), (5, 5)])
    same(values(smooth(door.ema, block(spark, [(1, 1), (5, 5)]), alpha=0)), [(1, 1), (1.000004, 1.000004)])


@pytest.mark.parametrize("alpha", [0.05, 0.6, 0.95])
def test_ema_long_runs(spark, alpha):
    rng = np.random.default_rng(4)
    rows = [tuple(NAN if i and rng.random() < 0.3 else float(v) for v in rng.normal(size=2)) for i in range(3000)]
    segments = [i // 1400 for i in range(3000)]
    want, last = [], None
    for i, r in enumerate(rows):
        if last is None or segments[i] != segments[i - 1]:
            last = list(r)
        else:
            last = [s if math.isnan(y) else alpha * y + (1 - alpha) * s for y, s in zip(r, last, strict=True)]
        want.append(tuple(last))
    got = values(smooth(door.ema, block(spark, rows, segments), alpha=alpha, segment="seg"))
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12, equal_nan=True)


def test_rows_without_unit_pass(spark):
    rows = block(spark, [(1, 2), (3, 4)], unit=None)
    same(values(smooth(door.lookback, rows, size=2)), [(1, 2), (3, 4)])
    same(values(smooth(door.ema, rows)), [(1, 2), (3, 4)])
    sizes = spark.createDataFrame([("a", 3)], "unit string, size int")
    same(values(door.lookback_by_unit(rows, sizes, ["unit"], ["ord"], ["f1", "f2"])), [(1, 2), (3, 4)])


def test_streams(spark, tmp_path):
    from weft.streaming import door as stream

    rows = block(spark, [(i, i % 3) for i in range(12)], [i // 5 for i in range(12)])
    for part in range(3):
        rows.where(f"ord div 4 = {part}").coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    for name, f, batch, kw in (("e", stream.ema, door.ema, {"alpha": 0.3}), ("l", stream.lookback, door.lookback, {"size": 3}), ("w", stream.lookback, door.lookback, {"size": 4, "mean": True, "linear": True})):
        query = smooth(f, source, segment="seg", **kw).writeStream.format("memory").queryName(f"door_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
        same(values(spark.table(f"door_{name}")), values(smooth(batch, rows, segment="seg", **kw)))
