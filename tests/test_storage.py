"""Layouts of the windowed table, lookups, compaction, scratch folders."""

import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from shelfcast import WindowSpec
from shelfcast.operators.ordering import recent_windows
from shelfcast.operators.trends import daily_skus
from shelfcast.operators.windows import window_sales
from shelfcast.plans.rollup import read_daily, refresh_daily
from shelfcast.schemas import DAILY, WINDOWED
from shelfcast.sinks.pages import read_page, stored_page_count, write_pages
from shelfcast.sinks.tables import BY_DATE, BY_SKU, compact_windowed, write_windowed
from shelfcast.sources.tables import query_windowed, read_windowed, register_windowed
from shelfcast.suite import fixtures as fx
from shelfcast.workspace import scratch

HOUR = WindowSpec.tumbling("1 hour")


@pytest.fixture(scope="module")
def windows(spark, sf_dir):
    sales = fx.sales(spark, sf_dir).filter("quantity > 0 AND unit_price > 0")
    return window_sales(sales, HOUR).persist()


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("layout", [BY_DATE, BY_SKU])
def test_round_trip_and_lookups(windows, spark, path, layout):
    write_windowed(windows, path + "/w", layout, partitions=4)
    back = read_windowed(spark, path + "/w")
    assert back.columns == WINDOWED.fieldNames() and same(back, windows)
    since, until = datetime(2024, 1, 5, tzinfo=timezone.utc), datetime(2024, 1, 9, 12, tzinfo=timezone.utc)
    expected = windows.filter(
        "store_id = 'STORE_001' AND window_start >= '2024-01-05' AND window_start < '2024-01-09 12:00'"
    )
    assert same(query_windowed(spark, path + "/w", "STORE_001", since=since, until=until), expected)
    one = query_windowed(spark, path + "/w", "STORE_001", "PROD_015")
    assert same(one, windows.filter("store_id = 'STORE_001' AND product_id = 'PROD_015'"))


def test_ids_stay_text_whatever_they_look_like(spark, windows, path):
    numbered = windows.withColumns({"store_id": F.lit("007"), "product_id": F.lit("1")}).limit(5)
    write_windowed(numbered, path + "/w", BY_SKU, partitions=1)
    for rows in (read_windowed(spark, path + "/w"), query_windowed(spark, path + "/w", "007")):
        assert {(r.store_id, r.product_id) for r in rows.collect()} == {("007", "1")}


def test_discovered_schema_merges_files_of_different_age(spark, windows, path):
    windows.limit(5).write.parquet(path + "/w")
    windows.limit(5).withColumn("prediction", F.lit(1.0)).write.mode("append").parquet(path + "/w")
    rows = read_windowed(spark, path + "/w", None, merge_schema=True)
    assert rows.count() == 10 and rows.filter("prediction = 1").count() == 5


def test_compaction_keeps_rows_in_fewer_files(spark, windows, path):
    windows.repartition(12).write.parquet(path + "/small")
    compact_windowed(spark, path + "/small", path + "/big", (), partitions=2)
    assert same(read_windowed(spark, path + "/big"), windows)
    assert len([f for f in os.listdir(path + "/big") if f.endswith(".parquet")]) == 2


def test_a_hot_sku_is_spread_over_files(spark, windows, path):
    hot = windows.withColumns({"store_id": F.lit("S"), "product_id": F.lit("P")})
    write_windowed(hot, path + "/w", (), partitions=4)
    assert len([f for f in os.listdir(path + "/w") if f.endswith(".parquet")]) == 4


def test_sql_and_recent_windows(spark, windows, path):
    write_windowed(windows, path + "/w")
    register_windowed(spark, path + "/w", "w")
    newest = spark.sql("SELECT max(window_start) FROM w WHERE store_id = 'STORE_002'").first()[0]
    rows = recent_windows(read_windowed(spark, path + "/w"), "STORE_002", 3).collect()
    assert len(rows) == 3 and rows[0].window_start == newest


def test_pages_at_any_depth(spark, path):
    rows = spark.range(1000).select(
        F.concat(F.lit("S"), F.format_string("%03d", F.col("id") % 7)).alias("store_id"),
        F.format_string("P%04d", F.pmod(F.col("id") * 37, F.lit(1000))).alias("product_id"), "id",
    )
    write_pages(rows, path + "/p", ranges=6)
    expected = [tuple(r) for r in rows.orderBy("store_id", "product_id").collect()]
    assert stored_page_count(spark, path + "/p", 30).first().asDict() == {"rows": 1000, "pages": 34}
    for number in (0, 5, 17, 33, 34):
        page = read_page(spark, path + "/p", number, 30)
        assert [tuple(r) for r in page.collect()] == expected[30 * number : 30 * number + 30]
        assert page.columns == rows.columns
    plan = read_page(spark, path + "/p", 17, 30)._jdf.queryExecution().executedPlan().toString()
    assert "page_range" in plan.partition("PartitionFilters: [")[2].partition("PushedFilters")[0], plan
    assert "page_place" in plan.partition("PushedFilters: [")[2].partition("ReadSchema")[0], plan
    assert "Offset" not in plan


def test_pages_of_nothing(spark, path):
    empty = spark.createDataFrame([], "store_id string, product_id string, n int")
    write_pages(empty, path + "/p")
    assert read_page(spark, path + "/p", 0).count() == 0
    assert stored_page_count(spark, path + "/p").first().asDict() == {"rows": 0, "pages": 0}


def test_scratch_is_under_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    first, second = scratch(spark, "x"), scratch(spark, "x")
    assert first != second
    if base:
        assert first.startswith(base)


def test_scratch_refuses_a_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch(Session(), "x")


def test_a_rollup_sums_changed_dates_only(spark, windows, path):
    late = F.col("store_id") == "STORE_002"
    some_days = "window_start >= '2024-01-08' AND window_start < '2024-01-10'"
    write_windowed(windows.filter(~late), path + "/w")
    days = refresh_daily(spark, path + "/w", path + "/r", HOUR)
    assert len(days) == windows.select(F.to_date("window_start")).distinct().count()
    assert refresh_daily(spark, path + "/w", path + "/r", HOUR) == []
    assert same(read_daily(spark, path + "/r"), daily_skus(windows.filter(~late), HOUR).select(DAILY.fieldNames()))
    write_windowed(windows.filter(late).filter(some_days), path + "/w")
    assert [d.day for d in refresh_daily(spark, path + "/w", path + "/r", HOUR)] == [8, 9]
    expected = daily_skus(windows.filter(~late | F.expr(some_days)), HOUR).select(DAILY.fieldNames())
    assert same(read_daily(spark, path + "/r"), expected)


def test_ranges_of_a_report_grow_in_number_not_in_size(spark, path, monkeypatch):
    from shelfcast.sinks import pages

    monkeypatch.setattr(pages, "RANGE_ROWS", 500)
    key = F.concat(F.lit("P"), F.lpad(F.col("id").cast("string"), 5, "0"))
    for number in (2000, 8000):
        rows = spark.range(number).select(F.lit("S").alias("store_id"), key.alias("product_id"), "id")
        write_pages(rows, f"{path}/{number}")
        held = [r["rows"] for r in spark.read.parquet(f"{path}/{number}/index").collect()]
        assert len(held) == number // 500 and sum(held) == number and max(held) < 1500
        assert [r.id for r in read_page(spark, f"{path}/{number}", number // 40).collect()] == list(
            range(number // 2, number // 2 + 20)
        )
    assert not rows.is_cached
