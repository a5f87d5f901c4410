"""Every registered query against DuckDB, or, where SQL cannot express it, that it gives rows of a stable schema."""

from __future__ import annotations

import pytest

from pagewright import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_against_sql(name, spark, sf_dir, duck):
    duck(Q.QUERIES[name](spark, sf_dir), Q.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_gives_rows(name, spark, sf_dir):
    df = Q.QUERIES[name](spark, sf_dir)
    assert df.columns
    assert df.count() > 0


def test_no_cross_joins(spark, sf_dir):
    for name, f in Q.QUERIES.items():
        if name == "process_pages":
            continue
        plan = f(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_columns_are_pruned(spark, sf_dir):
    plan = Q.QUERIES["page_languages"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan and "doc_id" not in plan


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
