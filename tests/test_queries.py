"""Every registered query against its SQL, on the smallest data."""

from __future__ import annotations

import importlib.util
from pathlib import Path

import pytest

from woonvonk.plans import catalog

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"

spec = importlib.util.spec_from_file_location("compare", ROOT / "tools" / "compare.py")
compare = importlib.util.module_from_spec(spec)
spec.loader.exec_module(compare)


@pytest.fixture(scope="module")
def checker():
    return compare.connect(SF)


@pytest.mark.parametrize("name", list(catalog.jobs()))
def test_query(spark, checker, name):
    df = catalog.jobs()[name](spark, SF)
    sql = catalog.sql().get(name)
    if sql is None:
        assert df.count() >= 0
        return
    assert compare.compare(df, checker, sql) == ""


def test_entry(spark):
    entry_spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(entry_spec)
    entry_spec.loader.exec_module(module)
    assert module.entry(spark).count() == 20
    assert set(module.oracle_sql()) <= set(module.queries())
