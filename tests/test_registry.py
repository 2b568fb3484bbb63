import pytest

from fathomline.plans import registry

BARE = sorted(set(registry.queries()) - set(registry.oracle_sql()))


@pytest.mark.parametrize("name", BARE)
def test_a_query_without_sql_runs(spark, sf_dir, name):
    """Queries that SQL doesn't check are built and run whole here."""
    df = registry.queries()[name](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0
