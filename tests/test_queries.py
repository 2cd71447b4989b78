"""Every query with SQL gives the rows that DuckDB gives; the others give rows of a fixed schema."""

import pytest
from conftest import DATA, same_rows

from genomill import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, duck):
    same_rows(catalogue.queries()[name](spark, DATA), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_rows_without_sql(name, spark):
    df = catalogue.queries()[name](spark, DATA)
    assert df.columns and df.count() > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_llm():
    import pathlib

    root = pathlib.Path(catalogue.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "genomill.llm" in p.read_text()]
