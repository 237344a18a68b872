"""Replacing tables, folders and models in one step."""

import os

import pytest

from perkframe import sources
from perkframe.operators.segments import SegmentModel
from perkframe.sources import versions


def failing(df):
    return df.selectExpr("id", "IF(id >= 0, CAST(raise_error('half-way') AS BIGINT), 0L) AS v")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_folder_is_replaced_in_one_step(spark, tmp_path):
    path = str(tmp_path / "t")
    sources.replace_parquet(spark.range(5).selectExpr("id", "id AS v"), path)
    assert ids(sources.read_current(spark, path)) == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="half-way"):
        sources.replace_parquet(failing(spark.range(3)), path)
    assert ids(sources.read_current(spark, path)) == [0, 1, 2, 3, 4]  # as it was
    # from itself, partitioned
    again = sources.read_current(spark, path).filter("id > 2")
    sources.replace_parquet(again, path, ["v"])
    assert ids(sources.read_current(spark, path)) == [3, 4]
    assert len([x for x in os.listdir(path) if x.startswith("v-")]) == 1  # older versions are gone
    plain = str(tmp_path / "plain")
    spark.range(2).write.parquet(plain)
    assert ids(sources.read_current(spark, plain)) == [0, 1]


def test_of_two_writers_one_is_told(spark, tmp_path):
    path = str(tmp_path / "t")
    sources.replace_parquet(spark.range(1), path)

    def slow(folder):
        spark.range(9).write.parquet(folder)
        sources.replace_parquet(spark.range(2), path)  # another writer commits first

    with pytest.raises(versions.ConcurrentWrite):
        versions.replace(spark, path, slow)
    assert ids(sources.read_current(spark, path)) == [0, 1]


def test_named_table_is_replaced_in_one_step(spark, tmp_path):
    name, path = "replaced_test", str(tmp_path / "named")
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    sources.write_table(spark.range(4), name, path=path)
    with pytest.raises(Exception, match="half-way"):
        sources.write_table(failing(spark.range(4)), name, path=path)
    assert ids(sources.read_table(spark, name)) == [0, 1, 2, 3]
    sources.write_table(sources.read_table(spark, name).filter("id > 1").selectExpr("id", "'x' AS other"), name, path=path)
    assert ids(sources.read_table(spark, name)) == [2, 3]
    assert sources.read_table(spark, name).columns == ["id", "other"]
    assert len(spark.catalog.listTables(pattern=f"{name}__v_*")) == 1 and len(os.listdir(path)) == 1
    spark.sql(f"DROP VIEW {name}")


def test_model_is_replaced_in_one_step(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "model")
    old = SegmentModel([1.0, 2.0, 3.0], [1.0, 1.0, 1.0], [[0.0, 0.0, 0.0], [1.0, 1.0, 1.0]])
    old.save(path)
    new = SegmentModel([9.0, 9.0, 9.0], [1.0, 1.0, 1.0], [[5.0, 5.0, 5.0]])
    real = type(spark).createDataFrame
    calls = []

    def second_fails(self, *args, **kw):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("lost")
        return real(self, *args, **kw)

    monkeypatch.setattr(type(spark), "createDataFrame", second_fails)
    with pytest.raises(OSError):
        new.save(path)
    monkeypatch.undo()
    held = SegmentModel.load(spark, path)
    assert held.means == old.means and held.centers == old.centers
    new.save(path)
    assert SegmentModel.load(spark, path).centers == new.centers
