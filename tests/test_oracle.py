"""Every registered query runs at the smallest scale; those with SQL match DuckDB."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
entry._load()
from workload.common import ORACLE, QUERIES  # noqa: E402  queries of tabsonde.llm have their own tests
# Fits of many models take minutes and are run by tests/oracle.py.
SLOW = {"model_evaluate_classification", "model_evaluate_regression"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_oracle_has_no_extra_keys():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, name):
    if name in ORACLE:
        assert compare(spark, con, QUERIES[name], ORACLE[name], SF_DIR).startswith("ok")
    else:
        assert QUERIES[name](spark, SF_DIR).count() > 0


def test_registry():
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 4
