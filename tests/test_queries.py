"""Every registered query of the library against its SQL."""

from __future__ import annotations

import pytest

from sabaki.plans.oracle import ORACLE_SQL
from sabaki.plans.queries import QUERIES

from .differential import assert_same


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    df = entry.entry(spark)
    assert {"doc_id", "status", "document_status"} <= set(df.columns)
    assert df.count() > 0


def test_extraction_plan_has_no_shuffle_of_its_own(spark):
    from sabaki.plans.extraction import extract

    docs = spark.createDataFrame([(1, "USS")], "doc_id int, text string")
    plan = extract(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Pandas" not in plan
