"""Sorts, pages, filters, summaries and series on small tables."""

from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from shelfcast.constants import RISK_LEVELS
from shelfcast.functions.text import date_spine, sku_key, version_stamp
from shelfcast.operators import filters, ordering, summary, trends
from shelfcast.config import WindowSpec
from shelfcast.plans.decisions import decision_insights
from shelfcast.plans.health import demand_predictions, home_summary
from shelfcast.schemas import DECISIONS, INVENTORY, WINDOWED
from shelfcast.sources.tables import require_columns, require_rows

HEALTH = (
    "store_id string, product_id string, current_stock int, lead_time_days int, "
    "predicted_daily_demand double, actual_sales double, days_of_cover double, risk_level string, "
    "recommended_reorder_quantity bigint"
)


@pytest.fixture
def health(spark):
    return spark.createDataFrame(
        [
            ("STORE_001", "PROD_001", 5, 3, 10.0, 4.0, 0.5, "CRITICAL", 45),
            ("STORE_001", "PROD_002", 20, 3, 10.0, 3.0, 2.0, "HIGH", 30),
            ("STORE_002", "PROD_001", 5, 3, 10.0, 2.0, 0.5, "CRITICAL", 45),
            ("STORE_002", "PROD_010", 900, 3, 10.0, 1.0, 90.0, "LOW", 0),
        ],
        HEALTH,
    )


@pytest.fixture
def decisions(spark):
    return spark.createDataFrame(
        [
            ("S2", "P1", 1, 2.5, "HIGH", 7.0, "REORDER"), ("S1", "P1", 9, 2.5, "MEDIUM", 3.0, "MONITOR"),
            ("S1", "P2", 99, 0.5, "LOW", 0.0, "NO_ACTION"), ("S1", "P3", 1, 2.5, "HIGH", 7.0, "REORDER"),
        ],
        DECISIONS,
    )


def test_decision_orders(decisions):
    by_text = [(r.action, r.store_id) for r in ordering.sort_decisions(decisions).collect()]
    assert by_text == [("REORDER", "S1"), ("REORDER", "S2"), ("NO_ACTION", "S1"), ("MONITOR", "S1")]
    by_rank = [r.action for r in ordering.sort_decisions(decisions, by_priority=True).collect()]
    assert by_rank == ["REORDER", "REORDER", "MONITOR", "NO_ACTION"]


def test_insights(decisions):
    parts = decision_insights(decisions)
    assert [tuple(r) for r in parts["risk_counts"].collect()] == [("HIGH", 2), ("LOW", 1), ("MEDIUM", 1)]
    assert [tuple(r) for r in parts["store_counts"].collect()] == [("S1", 3), ("S2", 1)]
    assert tuple(parts["totals"].first()) == (17.0, 2.0)
    assert [tuple(r) for r in parts["top_stores"].collect()] == [("S1", 10.0), ("S2", 7.0)]
    assert [tuple(r) for r in parts["top_products"].collect()] == [("P1", 5.0), ("P3", 2.5), ("P2", 0.5)]
    assert tuple(parts["sizes"].first()) == (4, 2, 1, 1)
    assert parts["monitor"].count() == 1
    assert tuple(summary.reorder_totals(decisions.filter("false")).first()) == (None, None)


def test_home_summary(health):
    parts = home_summary(health)
    kpis = parts["kpis"].first()
    assert (kpis.total_inventory_units, kpis.at_risk_products) == (930, 3)
    assert (kpis.today_sales_revenue, kpis.stockout_risk_percent) == (420.0, 75.0)
    assert parts["risk_distribution"].columns == [*RISK_LEVELS]
    assert tuple(parts["risk_distribution"].first()) == (1, 0, 1, 2)
    assert [r.store_id for r in parts["top_at_risk"].collect()] == ["STORE_001", "STORE_002", "STORE_001"]
    empty = summary.home_kpis(health.filter("false")).first()
    assert tuple(empty) == (0, 0, 0.0, 0.0)


def test_limits_and_pages(health):
    assert ordering.first_rows(health, 2).count() == 2
    assert ordering.first_rows(health, 5000).count() == 4
    pages = [[r.product_id for r in ordering.page(health, n, 3).collect()] for n in range(3)]
    assert pages == [["PROD_001", "PROD_002", "PROD_001"], ["PROD_010"], []]
    assert tuple(ordering.page_count(health, 3).first()) == (4, 2)
    after = ordering.page_after(health, ("STORE_001", "PROD_002"), 1).collect()
    assert [(r.store_id, r.product_id) for r in after] == [("STORE_002", "PROD_001")]
    assert ordering.page_after(health, ("STORE_002", "PROD_010")).isEmpty()
    assert tuple(ordering.page_count(health.filter("false"), 3).first()) == (0, 0)


def test_filters(health):
    assert filters.filter_skus(health, "store_002", "", "CRITICAL").count() == 1
    assert filters.filter_skus(health).count() == 4
    assert filters.reorder_queue(health).count() == 3
    assert filters.reorder_queue(health, risk="LOW").count() == 1
    stamped = demand_predictions(health, 4, datetime(2024, 3, 1, tzinfo=timezone.utc))
    rows = summary.prediction_rows(stamped)
    assert filters.search(rows, "PROD_010 2024-03").count() == 1
    assert {r.confidence for r in rows.collect()} == {0.85}
    nulls = health.select(F.lit(None).cast("double").alias("total_units_sold"), F.lit(1.0).alias("total_revenue"),
                          F.lit(1.0).alias("avg_units_per_minute"), F.lit(1).alias("transaction_count"))
    assert filters.drop_null_features(nulls).count() == 0


def test_requirements(health):
    with pytest.raises(ValueError, match="missing columns: nope"):
        require_columns(health, ["store_id", "nope"])
    with pytest.raises(ValueError):
        require_rows(health.filter("false"))


def test_scaffold(health):
    rows = trends.trend_scaffold(health, 3, date(2024, 3, 1)).collect()
    sales = {r.date: r.value for r in rows if r.series == "sales_rate"}
    assert sales == {"2024-02-28": 9.0, "2024-02-29": 9.2, "2024-03-01": 9.4}
    reorders = {r.date: r.value for r in rows if r.series == "reorder_rate"}
    assert reorders["2024-03-01"] == 2.82
    with pytest.raises(ValueError):
        trends.trend_scaffold(health, 0)
    assert trends.trend_scaffold(health, 90, date(2024, 3, 1)).count() == 270
    kpis = trends.trend_kpis(health, 3, date(2024, 3, 1))
    assert tuple(kpis.first()) == pytest.approx((9.2, 36.8, 8.28, 2))
    none = health.filter("false")
    kpis = trends.trend_kpis(none, 3)
    assert tuple(kpis.first()) == (0.0, 0.0, 0.0, 0)


def test_predicted_against_actual_and_movers(spark):
    rows = spark.createDataFrame(
        [
            ("S", "P", "2024-03-02", 1.0, 5.0), ("S", "Q", "2024-03-02", 2.0, None),
            ("S", "P", "2024-03-01", 7.0, None),
        ],
        "store_id string, product_id string, date string, predicted_demand double, actual_demand double",
    )
    daily = [tuple(r) for r in summary.daily_predicted_vs_actual(rows).collect()]
    assert daily == [("2024-03-01", 7, None), ("2024-03-02", 2, 5)]
    movers = [(r.product_id, r.avg_daily_sales) for r in summary.top_movers(rows).collect()]
    assert movers == [("P", 6.0), ("Q", 2.0)]
    assert summary.top_movers(rows, 1).count() == 1


def _windows(spark, rows):
    full = [
        (datetime(2024, 3, d, h, tzinfo=timezone.utc), datetime(2024, 3, d, h + 1, tzinfo=timezone.utc), "S", p, u, u * 2.0,
         u / 60, 1)
        for d, h, p, u in rows
    ]
    return spark.createDataFrame(full, WINDOWED)


def test_daily_series(spark):
    hour = WindowSpec.tumbling("1 hour")
    windows = _windows(spark, [(1, 3, "P", 2), (1, 9, "P", 4), (1, 9, "Q", 1), (3, 0, "P", 5)])
    stock = spark.createDataFrame([("S", "P", 100, 3)], INVENTORY)
    series = trends.daily_trend(windows, stock, hour)
    assert sorted(tuple(r) for r in series.collect()) == [
        ("2024-03-01", 7, 14.0, 120.0, 1), ("2024-03-03", 5, 10.0, 120.0, 1),
    ]
    assert [r.date for r in ordering.last_days(series, 3).orderBy("date").collect()] == ["2024-03-01", "2024-03-03"]
    later = series.withColumn("date", F.when(F.col("units") == 5, "2024-03-09").otherwise(F.col("date")))
    assert ordering.last_days(later, 7).count() == 1
    assert ordering.last_days(series, 90).count() == 2
    with pytest.raises(ValueError):
        trends.daily_skus(windows, WindowSpec())


def test_mover_trend(spark):
    hour = WindowSpec.tumbling("1 hour")
    windows = _windows(
        spark,
        [(1, 0, "UP", 10), (3, 0, "UP", 20), (1, 0, "DOWN", 20), (3, 0, "DOWN", 10),
         (1, 0, "FLAT", 100), (3, 0, "FLAT", 104), (3, 0, "NEW", 1), (9, 0, "LATE", 1)],
    )
    moved = trends.mover_trend(trends.daily_skus(windows, hour), date(2024, 3, 4), 2)
    assert {r.product_id: r.trend for r in moved.collect()} == {
        "UP": "up", "DOWN": "down", "FLAT": "stable", "NEW": "up",
    }


def test_text_helpers(spark):
    row = spark.range(1).select(
        date_spine(date(2024, 3, 1), 3).alias("days"),
        sku_key(F.lit("S"), F.lit("P"), ":").alias("key"),
        version_stamp("m", F.lit(datetime(2024, 3, 1, 2, 3, 4, tzinfo=timezone.utc))).alias("version"),
    ).first()
    assert row.days == [date(2024, 2, 28), date(2024, 2, 29), date(2024, 3, 1)]
    assert (row.key, row.version) == ("S:P", "m_20240301_020304")
