"""Every registered query with SQL gives the same names, types and values."""

import pytest

from __spark_entry__ import entry, queries
from shelfcast.suite.oracle import ORACLE
from shelfcast.suite.queries import QUERIES as SUITE
from tests.compare import difference

QUERIES = queries()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf_dir, duck, name):
    assert difference(QUERIES[name](spark, sf_dir), duck, ORACLE[name]) is None


def test_every_query_has_sql():
    assert set(SUITE) == set(ORACLE)


def test_entry_ranks_every_stocked_sku(spark, sf_dir):
    rows = entry(spark)
    assert rows.columns == [
        "store_id", "product_id", "current_stock", "lead_time_days", "predicted_daily_demand",
        "actual_sales", "days_of_cover", "risk_level", "recommended_reorder_quantity",
    ]
    assert rows.count() == 256
