"""The shape of the plans: what must not appear, and what must reach the scan."""

import re

import pytest

from __spark_entry__ import queries
from shelfcast.suite.queries import QUERIES as SUITE
from shelfcast.config import WindowSpec
from shelfcast.operators.demand import sku_features
from shelfcast.operators.windows import latest_window, window_sales
from shelfcast.sources.events import parse_events
from shelfcast.operators.events import valid_sales
from shelfcast.suite import fixtures as fx

WRITING = ("daily_trend_rollup", "stock_change_feed", "reorders_bucketed", "demand_page_stored", "rf_", "stream_", "partitioned_", "windowed_", "csv_", "inventory_version", "reorder_export")
LAZY = sorted(n for n in SUITE if not n.startswith(WRITING))


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    text = plan(queries()[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert bad not in text


@pytest.mark.parametrize("name", LAZY)
def test_scans_read_named_columns_only(spark, sf_dir, name):
    text = plan(queries()[name](spark, sf_dir))
    assert "l_comment" not in text and "l_discount" not in text
    assert re.findall(r"ReadSchema: struct<>", text) == []


def test_demand_without_model_reads_no_price_sum(spark, sf_dir):
    text = plan(queries()["sku_health_li"](spark, sf_dir))
    assert "sum(FLOOR" not in text  # revenue is not asked for, so it is not summed


def test_json_is_parsed_once(spark, sf_dir):
    lines = fx.event_lines(spark, sf_dir)
    text = plan(window_sales(valid_sales(parse_events(lines)), WindowSpec("6 hours", "1 hour")))
    assert text.count("from_json") == 1


def test_windows_and_features_use_hash_aggregates(spark, sf_dir):
    windows = window_sales(fx.sales(spark, sf_dir), WindowSpec("6 hours", "1 hour"))
    for frame in (windows, latest_window(windows), sku_features(windows, "avg")):
        assert "SortAggregate" not in plan(frame)
        assert "partial_" in plan(frame)


def test_joins_are_left_to_the_size_check(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(queries()["reorder_rows"](spark, sf_dir))
        assert "BroadcastHashJoin" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bucketed_tables_join_without_a_shuffle(spark, sf_dir, path):
    from shelfcast.operators.demand import join_demand
    from shelfcast.operators.stock import with_sellers
    from shelfcast.plans.health import health_of
    from shelfcast.operators.model import score
    from shelfcast.sinks.bucketed import write_bucketed

    day = WindowSpec.tumbling("1 day")
    windows = window_sales(valid_sales(fx.sales_li(spark, sf_dir)), day)
    tables = {"windows": windows, "stock": fx.inventory_li(spark, sf_dir), "sellers": fx.sellers_li(spark, sf_dir)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        stored = {n: write_bucketed(t, f"plan_{n}", f"{path}/{n}", 8) for n, t in tables.items()}
        features = sku_features(stored["windows"])
        health = health_of(score(join_demand(stored["stock"], features, "left"), None), day)
        listed = with_sellers(health, stored["sellers"])
        text = plan(listed)
        assert "SortMergeJoin" in text and "Exchange" not in text
        assert "Bucketed: true" in text
        plain = with_sellers(health_of(score(join_demand(tables["stock"], sku_features(windows), "left"), None), day), tables["sellers"])
        assert listed.exceptAll(plain).isEmpty() and listed.count() == plain.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS plan_{name}")


def test_a_filter_on_the_risk_level_holds_no_formula_twice(spark, sf_dir):
    from shelfcast.operators.demand import join_demand
    from shelfcast.operators.filters import at_risk
    from shelfcast.operators.model import score
    from shelfcast.plans.health import health_of

    day = WindowSpec.tumbling("1 day")
    features = sku_features(window_sales(valid_sales(fx.sales_li(spark, sf_dir)), day))
    joined = score(join_demand(fx.inventory_li(spark, sf_dir), features, "left"), None)
    filters = [line for line in plan(at_risk(health_of(joined, day))).splitlines() if "CRITICAL" in line and "Filter" in line]
    assert filters and all("86400" not in line for line in filters)


def test_bucketed_tables_join_in_their_stored_order(spark, sf_dir, path):
    from shelfcast.operators.demand import join_demand
    from shelfcast.sinks.bucketed import write_bucketed

    stock = fx.inventory_li(spark, sf_dir)
    features = sku_features(window_sales(valid_sales(fx.sales_li(spark, sf_dir)), WindowSpec.tumbling("1 day")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        tables = {"order_stock": stock, "order_features": features}
        stored = [write_bucketed(t, n, f"{path}/{n}", 8) for n, t in tables.items()]
        joined = join_demand(*stored, "left")
        assert "SortMergeJoin" in plan(joined) and "Sort [" not in plan(joined)
        plain = join_demand(stock, features, "left")
        assert joined.exceptAll(plain).isEmpty() and joined.count() == plain.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("order_stock", "order_features"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_store_filter_reaches_the_scan(spark, sf_dir, path):
    from shelfcast.sinks.tables import write_windowed
    from shelfcast.sources.tables import query_windowed
    from datetime import datetime, timezone

    hour = WindowSpec.tumbling("1 hour")
    write_windowed(window_sales(fx.sales(spark, sf_dir), hour), path + "/w")
    rows = query_windowed(
        spark, path + "/w", "STORE_002", since=datetime(2024, 1, 10, tzinfo=timezone.utc)
    )
    text = plan(rows)
    assert "EqualTo(store_id,STORE_002)" in text
    assert re.search(r"PartitionFilters: \[[^\]]*window_date[^\]]*2024-01-10", text)
