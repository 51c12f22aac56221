"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__
from weftline import plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    duck(plans.QUERIES[name](spark, "/root/testdata/sf0.001"), plans.ORACLE[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names_are_registered():
    assert set(plans.ORACLE) <= set(plans.QUERIES) <= set(__spark_entry__.queries())
