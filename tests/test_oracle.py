"""Every query with an SQL twin, on the smallest tables."""

import os

import pytest
from check_oracle import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    text, _, _, good = compare(spark, duck(SF), name, entry.queries()[name], ORACLE[name], SF)
    assert good, text
