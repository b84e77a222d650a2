"""Queries of the operators that SQL can express give the same rows as their SQL."""

import pytest

from check_oracle import compare, database
from runloom.llm.queries import QUERIES
from runloom.llm.sql import ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), database(sf_dir), ORACLE[name]) == ""


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
