import pytest
from helpers import SF, oracle_rows, spark_rows

import __spark_entry__ as entry_module
from quillspark.plans import catalog, fixture
from quillspark.plans.export import EXPORT_SQL


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert spark_rows(catalog.queries()[name](spark, SF)) == oracle_rows(catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(n for n, sql in catalog.oracle_sql().items() if EXPORT_SQL in sql))
def test_query_matches_sql_on_worked_records(spark, monkeypatch, name):
    """The queries over the export, on fifteen records written by hand for their edge cases."""
    monkeypatch.setattr(catalog, "records", lambda session, _: fixture.records(session))
    assert spark_rows(catalog.queries()[name](spark, SF)) == oracle_rows(catalog.oracle_sql()[name].replace(EXPORT_SQL, fixture.RECORDS_SQL))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
