"""Corrections, sellers, snapshots and exports."""

from datetime import datetime, timezone

import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shelfcast.operators.demand import join_demand, sku_features
from shelfcast.operators.stock import (
    rejected_updates, repeated_skus, upsert_stock, valid_updates, with_sellers,
)
from shelfcast.plans.health import reorder_list, sku_health
from shelfcast.schemas import INVENTORY, SELLERS, SKU_FEATURES, STOCK_UPDATES, WINDOWED
from shelfcast.sinks.stock import write_inventory
from shelfcast.sinks.tables import export_reorders, write_inventory_csv
from shelfcast.sources.stock import inventory_version, read_inventory_version
from shelfcast.sources.tables import read_inventory, read_sellers

T = [datetime(2024, 3, 1, h, tzinfo=timezone.utc) for h in range(5)]


@pytest.fixture
def stock(spark):
    return spark.createDataFrame(
        [("S1", "P1", 10, 2), ("S1", "P2", 20, 4), ("S2", "P1", 30, 3)], INVENTORY
    )


@pytest.fixture
def updates(spark):
    return spark.createDataFrame(
        [
            ("S1", "P1", 11, T[1]), ("S1", "P1", 12, T[3]), ("S1", "P1", 13, T[2]),
            ("S9", "P9", 5, T[0]), ("S9", "P9", 7, T[0]),
            (" ", "P1", 1, T[0]), ("S1", "", 1, T[0]), (None, "P1", 1, T[0]), (" S1 ", "P1 ", 3, T[0]),
            ("S1", "P2", -1, T[4]), ("S2", "P1", 0, T[0]), ("S2", "P1", None, T[4]),
        ],
        STOCK_UPDATES,
    )


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_upsert(stock, updates):
    assert rows(upsert_stock(stock, updates)) == [
        ("S1", "P1", 12, 2, "updated"),
        ("S1", "P2", 20, 4, "unchanged"),
        ("S2", "P1", 0, 3, "updated"),
        ("S9", "P9", 7, 3, "created"),
    ]
    assert valid_updates(updates).count() == 7
    reasons = [r.reason for r in rejected_updates(updates).collect()]
    assert sorted(reasons) == ["bad_stock", "bad_stock", "no_product", "no_store", "no_store"]


def test_upsert_leaves_one_row_per_sku(spark, stock):
    twice = stock.unionByName(stock.withColumn("current_stock", F.col("current_stock") - 1))
    none = spark.createDataFrame([], STOCK_UPDATES)
    after = upsert_stock(twice, none)
    assert rows(after.select("product_id", "current_stock")) == [("P1", 9), ("P1", 29), ("P2", 19)]
    undated = spark.createDataFrame([("S1", "P1", 4, None), ("S1", "P1", 6, None)], STOCK_UPDATES)
    assert ("S1", "P1", 6, 2, "updated") in rows(upsert_stock(stock, undated))


def test_a_snapshot_that_misses_another_is_refused(spark, stock, path):
    first = write_inventory(stock, path)
    second = write_inventory(stock.limit(2), path, parent=first)
    assert inventory_version(spark, path) == second
    with pytest.raises(ValueError, match="another snapshot"):
        write_inventory(stock.limit(1), path, parent=first)
    assert read_inventory_version(spark, path).count() == 2


def test_upsert_twice_changes_nothing_more(stock, updates):
    once = upsert_stock(stock, updates, default_lead=5).drop("status")
    assert rows(upsert_stock(once, updates, default_lead=5).drop("status")) == rows(once)
    assert ("S9", "P9", 7, 5) in rows(once)


def test_repeated_skus(stock):
    assert repeated_skus(stock).count() == 0
    assert rows(repeated_skus(stock.unionByName(stock.limit(1)))) == [("S1", "P1", 2)]


def test_snapshots_are_seen_once_committed(spark, stock, updates, path):
    write_inventory(stock, path)
    first = read_inventory_version(spark, path)
    write_inventory(upsert_stock(first, updates), path)
    assert rows(first) == rows(stock)  # the old version stays readable
    assert rows(read_inventory_version(spark, path)) == rows(upsert_stock(stock, updates).drop("status"))
    # a snapshot whose writer died before the commit
    stock.limit(1).write.parquet(f"{path}/data/version=ffffffff")
    assert read_inventory_version(spark, path).count() == 4


def test_inventory_csv(spark, stock, path):
    write_inventory_csv(stock, path + "/csv")
    back = read_inventory(spark, path + "/csv")
    assert rows(back) == rows(stock) and back.schema == INVENTORY


def test_inventory_csv_fails_on_text_and_on_other_columns(spark, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_text("store_id,product_id,current_stock,lead_time_days\nS,P,many,3\n")
    with pytest.raises((PySparkException, Py4JError)):
        read_inventory(spark, str(bad)).collect()
    swapped = tmp_path / "swapped.csv"
    swapped.write_text("product_id,store_id,current_stock,lead_time_days\nP,S,1,3\n")
    with pytest.raises((PySparkException, Py4JError)):
        read_inventory(spark, str(swapped)).collect()


def test_sellers_last_line_wins_and_missing_file_is_empty(spark, tmp_path):
    file = tmp_path / "sellers.csv"
    file.write_text(
        "store_id,product_id,seller_name,seller_contact,auto_confirm_eligible\n"
        "S1,P1,Old,1,false\nS2,P1,Other,2, True \nS1,P1,New,3,true\n"
    )
    got = {(r.store_id, r.product_id): r for r in read_sellers(spark, str(file)).collect()}
    assert got["S1", "P1"].seller_name == "New" and got["S2", "P1"].seller_contact == "2"
    empty = read_sellers(spark, str(tmp_path / "nothing.csv"))
    assert empty.schema == SELLERS and empty.isEmpty()


def test_last_seller_wins_across_many_lines(spark, tmp_path):
    file = tmp_path / "sellers.csv"
    lines = [f"S{i % 7},P1,name{i},{i},false" for i in range(40000)]
    file.write_text(
        "store_id,product_id,seller_name,seller_contact,auto_confirm_eligible\n" + "\n".join(lines) + "\n"
    )
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50000)  # many blocks
    try:
        sellers = read_sellers(spark, str(file))
        got = sorted(int(r.seller_contact) for r in sellers.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(range(39993, 40000))


def test_seller_defaults_and_flags(spark, stock):
    sellers = spark.createDataFrame(
        [("S1", "P1", "A", "1", " True "), ("S1", "P2", "B", "2", "FALSE")], SELLERS
    )
    got = {(r.store_id, r.product_id): r for r in with_sellers(stock, sellers).collect()}
    assert got["S1", "P1"].auto_confirm_eligible is True
    assert got["S1", "P2"].auto_confirm_eligible is False
    unmapped = got["S2", "P1"]
    assert (unmapped.seller_name, unmapped.seller_contact) == ("Seller Not Mapped", "NA")
    assert unmapped.auto_confirm_eligible is False


def test_joins_inner_and_left(spark, stock):
    features = spark.createDataFrame([("S1", "P1", 9, 1.0, 0.5, 3), ("S8", "P8", 1, 1.0, 1.0, 1)], SKU_FEATURES)
    assert join_demand(stock, features).count() == 1
    left = {(r.store_id, r.product_id): r for r in join_demand(stock, features, "left").collect()}
    assert len(left) == 3 and left["S2", "P1"].total_units_sold == 0
    assert left["S2", "P1"].total_revenue == 0.0 and left["S1", "P1"].total_units_sold == 9


def test_features_keep_a_prediction_when_asked(spark):
    windows = spark.createDataFrame(
        [(T[0], T[1], "S", "P", 4, 2.0, 1.0, 1), (T[1], T[2], "S", "P", 2, 6.0, 3.0, 5)], WINDOWED
    ).withColumn("prediction", F.col("total_units_sold") * 1.5)
    best = sku_features(windows, with_prediction=True).first()
    assert (best.total_units_sold, best.total_revenue, best.transaction_count, best.prediction) == (4, 6.0, 5, 6.0)
    assert "prediction" not in sku_features(windows).columns
    assert "prediction" not in sku_features(windows.drop("prediction"), with_prediction=True).columns
    assert sku_features(windows, "avg").first().total_units_sold == 3.0
    assert sku_features(windows, "latest").first().total_units_sold == 2


def test_no_demand_keeps_every_sku(stock):
    health = sku_health(stock, None)
    got = rows(health.select("store_id", "product_id", "predicted_daily_demand", "days_of_cover", "risk_level"))
    assert got == [
        ("S1", "P1", 0.0, 10.0, "LOW"), ("S1", "P2", 0.0, 20.0, "LOW"), ("S2", "P1", 0.0, 30.0, "LOW"),
    ]


def test_reorder_list_columns(spark, stock):
    health = sku_health(stock, spark.createDataFrame([(T[0], T[1], "S1", "P1", 4, 2.0, 1.0, 1)], WINDOWED))
    listed = reorder_list(health, spark.createDataFrame([], SELLERS))
    row = listed.first()
    assert listed.count() == 1 and len(listed.columns) == 13
    assert (row.action, row.status, row.last_reorder_date) == ("CREATE_DRAFT_PO", "pending", None)


def test_export_holds_only_reorders(spark, path):
    from shelfcast.schemas import DECISIONS

    decided = spark.createDataFrame(
        [("S", "P", 1, 2.0, "HIGH", 3.0, "REORDER"), ("S", "Q", 9, 2.0, "LOW", 0.0, "NO_ACTION")], DECISIONS
    )
    export_reorders(decided, path + "/out")
    back = spark.read.schema(DECISIONS).option("header", True).csv(path + "/out")
    assert rows(back) == [("S", "P", 1, 2.0, "HIGH", 3.0, "REORDER")]
