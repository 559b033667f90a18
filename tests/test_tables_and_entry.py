import __spark_entry__ as entry
import pytest

from weft.sources import tables


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_without_the_training_data_operators(monkeypatch):
    """Also if they are there but cannot be imported."""
    import sys

    for name in [m for m in sys.modules if m.startswith("weft.llm")] + ["weft.llm", "corpus_pipeline"]:
        monkeypatch.setitem(sys.modules, name, None)
    names = set(entry.queries())
    assert len(names) > 40 and set(entry.oracle_sql()) <= names and not any(n.startswith("op") or n == "pipeline" for n in names - {"orthogonal_design"})


@pytest.mark.parametrize("fmt", tables.FORMATS)
def test_formats(spark, tmp_path, fmt):
    rows = spark.createDataFrame([(1, 2.5), (2, float("nan"))], "id long, x double")
    path = str(tmp_path / fmt)
    tables.write_matrix(rows, path, fmt)
    got = tables.read_matrix(spark, path, "id long, x double", fmt).orderBy("id").collect()
    assert got[0]["x"] == 2.5 and (got[1]["x"] is None or got[1]["x"] != got[1]["x"])


def test_forms(spark):
    wide = spark.createDataFrame([(1, 2.0, 3.0)], "id long, a double, b double")
    assert {tuple(r) for r in tables.to_long(wide, ["id"], ["a", "b"]).collect()} == {(1, "a", 2.0), (1, "b", 3.0)}
    arrays = tables.to_array(wide, ["id"], ["a", "b"])
    assert arrays.first()["v"] == [2, 3]
    assert [tuple(r) for r in tables.array_to_long(arrays, ["id"], "v").orderBy("dim").collect()] == [(1, 0, 2.0), (1, 1, 3.0)]
    with pytest.raises(ValueError):
        tables.write_matrix(wide, "/tmp/none", "xml")
