"""Every query against its check SQL."""

import pytest

import __spark_entry__ as entry
from suite import operators, rewards
from suite.check import differences, duck

QUERIES = {**operators.QUERIES, **rewards.QUERIES}
ORACLES = {**operators.ORACLES, **rewards.ORACLES}


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, sf_dir, connection, name):
    assert differences(QUERIES[name](spark, sf_dir), connection, ORACLES[name]) == []


def test_every_query_has_check_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("reward_") and n != "reward_report"])
def test_fixture_exercises_reward(spark, sf_dir, name):
    """The fixture reaches several outcomes of every reward."""
    column = name.removeprefix("reward_")
    assert QUERIES[name](spark, sf_dir).select(column).distinct().count() >= 3
