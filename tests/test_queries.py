import oracle
import pytest

from tessella.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name in registry.ORACLE_SQL:
        oracle.check(got, sf, registry.ORACLE_SQL[name])
    else:
        assert len(got.columns)


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
