"""Queries with SQL match DuckDB; the registry has one query for each operator, and the pipeline."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from oracle import compare, duck
from tabsonde.llm.queries import ORACLE

SF = "/root/testdata/sf0.001"


def test_registry():
    numbers = sorted(int(m[1]) for n in entry.queries() if (m := re.match(r"op(\d+)_", n)))
    assert numbers == sorted(set(numbers)) and set(range(1, 11)) <= set(numbers) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    assert compare(spark, duck(SF), entry.queries()[name], entry.oracle_sql()[name], SF).startswith("ok")
