"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest

from loomwell.plans import catalog
from tests.conftest import SF, same_rows


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, duck, name):
    same_rows(catalog.queries()[name](spark, SF), duck, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
