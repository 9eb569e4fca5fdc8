"""Every registered query outside the training-data part, against DuckDB where SQL can express it."""

import pytest
from compare import DATA, same

from terraspark import plans


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, f"{DATA}/sf0.001")
    if name in plans.ORACLES:
        same(df, duck.sql(plans.ORACLES[name]))
    else:
        assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
