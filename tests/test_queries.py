"""Every core query against its SQL, and the contract of the entry module."""

import os
import re

import pytest

from scholium.plans import registry
from tests.oracle import rows, sql_rows

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    assert rows(registry.queries()[name](spark, data)) == sql_rows(SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    df = registry.queries()[name](spark, data)
    assert df.columns and df.count() >= (name != "ret_embedded")  # the smallest table need not have an id divisible by 50


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_core_does_not_import_llm():
    top = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scholium")
    for folder, _, files in os.walk(top):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"scholium\.llm|from scholium import llm|from \.*llm", open(os.path.join(folder, f)).read()), f
