"""The commands end to end: lines to windows, model, decisions, reports, stock."""

import pytest

from shelfcast.__main__ import main
from shelfcast.sources.stock import read_inventory_version
from shelfcast.sources.tables import read_windowed
from shelfcast.suite import fixtures as fx
from shelfcast.sinks.tables import write_inventory_csv

SPEC = ["--window", "6 hours", "--slide", "1 hour"]


def test_from_lines_to_reports(spark, sf_dir, path):
    fx.event_lines(spark, sf_dir).write.text(path + "/lines")
    write_inventory_csv(fx.inventory(spark, sf_dir), path + "/stock")
    source = ["--path", path + "/lines", "--once"]
    main(["windows", *source, "--output", path + "/w", "--checkpoint", path + "/c1", *SPEC])
    main(["validate", *source, "--output", path + "/valid", "--checkpoint", path + "/c2"])
    main(["compact", "--windows", path + "/w", "--output", path + "/w2", "--partitions", "3"])
    stored = read_windowed(spark, path + "/w2")
    assert stored.count() == read_windowed(spark, path + "/w").count() > 1000
    assert spark.read.parquet(path + "/valid").count() > 800

    log = ["--models", path + "/models", "--runs", path + "/runs"]
    main(["train", "--windows", path + "/w2", *log, "--trees", "5", "--depth", "4", *SPEC])

    data = ["--windows", path + "/w2", "--inventory", path + "/stock", *SPEC]
    main(["decide", *data, "--output", path + "/d"])
    decided = spark.read.parquet(path + "/d/decisions")
    reorders = spark.read.option("header", True).csv(path + "/d/reorders")
    assert reorders.count() == decided.filter("action = 'REORDER'").count() > 0
    assert spark.read.parquet(path + "/d/action_counts").agg({"count": "sum"}).first()[0] == decided.count()

    main(["reports", *data, *log, "--sellers", path + "/none", "--output", path + "/r", "--limit", "7"])
    assert spark.read.parquet(path + "/r/demand_predictions").count() == 7
    assert spark.read.parquet(path + "/r/trends").count() == 21
    assert spark.read.parquet(path + "/r/model").first().model_version.startswith("demand_rf_model_2")
    health = spark.read.parquet(path + "/r/health")
    assert health.count() == fx.inventory(spark, sf_dir).count()
    kpis = spark.read.parquet(path + "/r/kpis").first()
    assert spark.read.parquet(path + "/r/reorder_list").count() == kpis.at_risk_products


def test_stock_update_makes_a_version(spark, sf_dir, path):
    write_inventory_csv(fx.inventory_li(spark, sf_dir), path + "/stock")
    fx.stock_updates(spark, sf_dir).write.option("header", True).csv(path + "/changes")
    main(["update", "--inventory", path + "/stock", "--updates", path + "/changes", "--output", path + "/v"])
    first = read_inventory_version(spark, path + "/v").count()
    main(["update", "--inventory", "versions:" + path + "/v", "--updates", path + "/changes", "--output", path + "/v"])
    assert read_inventory_version(spark, path + "/v").count() == first > 0


def test_unknown_command():
    with pytest.raises(SystemExit):
        main(["nothing"])
