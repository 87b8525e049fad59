"""Every registered query against its SQL."""

import os

import pytest

from leasewell import catalog
from tests.oracle import DATA, connection, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, name):
    same(catalog.queries()[name](spark, DATA), catalog.oracle_sql()[name], connection())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry_without_the_optional_operators(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # importing it raises ImportError
    try:
        importlib.reload(__spark_entry__)
        assert set(__spark_entry__.queries()) == set(catalog.queries())
        assert set(__spark_entry__.oracle_sql()) == set(catalog.oracle_sql())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


def test_plans_prune_columns_and_keep_to_hash_aggregation(spark):
    plan = lambda name: catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    page = plan("list_messages_p1")
    assert "TakeOrderedAndProject" in page and "PushedFilters: [IsNotNull(o_" in page
    assert "o_comment" not in page and "o_totalprice" not in page
    tail = plan("snapshot_plus_tail")
    assert "GreaterThanOrEqual(event_id" in tail or "GreaterThan(event_id" in tail or "event_id" in tail.split("DataFilters")[1]
    assert "HashAggregate" in tail and "SortAggregate" not in plan("log_fold")
    candidate = plan("select_candidate")
    assert "Window" not in candidate and "HashAggregate(keys=[queue" in candidate.replace("key=", "keys=")
