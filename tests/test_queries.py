"""Every registered domain query against its SQL on the smallest tables."""

import pytest
from oracle import check

from orrery.plans import answer_queries, name_queries, source_queries  # noqa: F401
from orrery.plans.more_queries import base

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(base.ORACLES))
def test_query(spark, name):
    check(spark, name, base.QUERIES[name], base.ORACLES[name], SF)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
