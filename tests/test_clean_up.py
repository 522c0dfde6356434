"""Q4: clean-up removes what it reports, whatever the identifiers, and reports only what it removed."""
import glob
import os

import pytest

from verdant.operators import retention as RT

NAMES = ["plain", "2024-06-01T10:00", "50%", "a/b", "x=y", "it's [odd] #1?", "back\\slash", "tab\there", "Äß"]


@pytest.fixture
def store(spark, tmp_dir):
    for i, name in enumerate(NAMES):
        RT.store_data(spark.range(i + 1), tmp_dir, "debug_outputs", name, "2024-01-01")
    RT.store_data(spark.range(3), tmp_dir, "debug_outputs", "50%", "2024-03-01")  # not expired yet
    RT.store_data(spark.range(9), tmp_dir, "model_parameters", "a/b", "2020-01-01")  # never expires
    return tmp_dir


def data(spark, store):
    return {(r.identifier, str(r.store_date)) for r in spark.read.schema("id long, storage_class string, data_type string, store_date string, identifier string").parquet(f"{store}/data").select("identifier", "store_date").distinct().collect()}


def test_everything_expired_is_gone(spark, store):
    paths = {r.identifier: r.storage_path for r in RT.read_index(spark, store).collect()}
    assert all(os.path.isdir(os.path.join(store, p)) for p in paths.values())
    gone = RT.clean_up(spark, store, "2024-03-10")
    assert sorted(r.identifier for r in gone.collect()) == sorted(NAMES)
    left = {("50%", "2024-03-01"), ("a/b", "2020-01-01")}
    assert {(r.identifier, r.store_date) for r in RT.read_index(spark, store).collect()} == left and data(spark, store) == left
    assert RT.clean_up(spark, store, "2024-03-10").count() == 0
    assert not glob.glob(f"{store}/data/storage_class=temporary/data_type=debug_outputs/store_date=2024-01-01/*")


def test_what_stays_is_not_reported(spark, store, monkeypatch):
    remove = RT._remove
    monkeypatch.setattr(RT, "_remove", lambda fs, path: False if "x%3Dy" in path.toString() else remove(fs, path))
    told = RT.clean_up(spark, store, "2024-03-10")
    assert sorted(r.identifier for r in told.collect()) == sorted(set(NAMES) - {"x=y"})
    assert ("x=y", "2024-01-01") in data(spark, store) and "x=y" in {r.identifier for r in RT.read_index(spark, store).collect()}
    monkeypatch.setattr(RT, "_remove", remove)
    assert [r.identifier for r in RT.clean_up(spark, store, "2024-03-10").collect()] == ["x=y"]
