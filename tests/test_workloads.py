"""Every workload gives its SQL's rows at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__
from fernlight.plans.workloads import ORACLE_SQL, QUERIES

from .compare import assert_same, database

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    return database(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, sql, name):
    found = QUERIES[name](spark, SF).toArrow()
    if name in ORACLE_SQL:
        assert_same(found, sql.execute(ORACLE_SQL[name]).to_arrow_table())
    else:
        assert found.num_rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "path", "score"]
