"""Every registered query against its SQL on the smallest tables."""

import compare
import pytest

import __spark_entry__
from convoy.plans.registry import ENTRIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql])
def test_query_equals_sql(spark, con, sf_dir, name):
    rows, problem = compare.compare(spark, con, ENTRIES[name], sf_dir)
    assert problem is None
    assert rows > 0 or name == "tenant_none"


def test_entry_and_keys(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["type_metrics", "train_backtest", "permutation_importance"])
def test_model_queries_run(spark, sf_dir, name):
    assert len(ENTRIES[name].run(spark, sf_dir).collect()) > 0
