"""Forest, metrics and run log. The forest depends on partitioning: bounds only."""

import math

import pytest
from pyspark.sql import functions as F

from shelfcast import COMPACT_FOREST, ForestParams, WindowSpec
from shelfcast.constants import FEATURES
from shelfcast.operators.model import (
    assemble, fit_demand_model, importances, regression_metrics, score, split, with_test_flag,
)
from shelfcast.operators.windows import window_sales
from shelfcast.plans.decisions import decision_table
from shelfcast.plans.health import sku_health
from shelfcast.plans.training import current_model, labelled, train, train_run
from shelfcast.sources.tables import latest_run, load_model, read_runs
from shelfcast.suite import fixtures as fx

SPEC = WindowSpec("6 hours", "1 hour")
SMALL = ForestParams(trees=15, depth=6)


@pytest.fixture(scope="module")
def windows(spark, sf_dir):
    sales = fx.sales(spark, sf_dir).filter("quantity > 0 AND unit_price > 0")
    return window_sales(sales, SPEC).persist()


def test_defaults():
    assert (ForestParams().trees, ForestParams().depth, ForestParams().subsampling, ForestParams().seed) == (100, 10, 0.8, 42)
    assert (COMPACT_FOREST.trees, COMPACT_FOREST.depth) == (50, 10)


def test_split_depends_on_the_key_alone(windows):
    train_rows, test_rows = split(windows)
    total, held = windows.count(), test_rows.count()
    assert train_rows.count() + held == total
    assert 0.17 < held / total < 0.23
    keys = ["store_id", "product_id", "window_start"]
    again = split(windows.repartition(7, "product_id"))[1]
    assert again.select(keys).exceptAll(test_rows.select(keys)).isEmpty()
    assert with_test_flag(windows, 0).filter("is_test").isEmpty()


def test_train_proxy_label(windows):
    model, metrics = train(windows, SMALL, spec=SPEC)
    row = metrics.first()
    assert row.r2 > 0.9 and row.rmse >= row.mae > 0 and row.rows > 0
    ranked = importances(model).collect()
    assert {r.feature for r in ranked} == set(FEATURES)
    assert sum(r.importance for r in ranked) == pytest.approx(1)
    assert [r.importance for r in ranked] == sorted((r.importance for r in ranked), reverse=True)


def test_next_window_label_is_no_feature(windows):
    rows, label = labelled(windows, "next_window", SPEC)
    assert label not in FEATURES and rows.count() == windows.count()
    with pytest.raises(ValueError):
        labelled(windows, "other", SPEC)


def test_null_features_vanish_and_no_model_gives_zero(windows):
    some = windows.limit(10).withColumn("total_revenue", F.lit(None).cast("double"))
    assert assemble(some).count() == 0
    assert score(some, None).agg(F.sum("prediction")).first()[0] == 0.0
    with pytest.raises(ValueError, match="total_units_sold"):
        assemble(windows.drop("total_units_sold"))


def test_runs_are_logged_and_models_versioned(spark, windows, path):
    root, log = path + "/models", path + "/runs"
    idle = latest_run(read_runs(spark, log)).first()
    assert (idle.status, idle.model_version, idle.rmse) == ("idle", "demand_rf_model_current", None)
    assert current_model(spark, root, log) is None

    run = train_run(windows, root, log, SMALL, spec=SPEC).first()
    assert run.status == "success" and run.rmse > 0 and run.error is None
    assert run.model_version.startswith("demand_rf_model_2")
    model = current_model(spark, root, log)
    a = score(windows, model).agg(F.sum("prediction")).first()[0]
    b = score(windows, load_model(f"{root}/{run.model_version}")).agg(F.sum("prediction")).first()[0]
    assert math.isclose(a, b)

    failed = train_run(windows.filter("false"), root, log, SMALL, spec=SPEC).first()
    assert (failed.status, failed.error) == ("failed", "no rows")
    assert (failed.rmse, failed.model_version) == (run.rmse, run.model_version)
    assert sorted(r.status for r in read_runs(spark, log).collect()) == ["failed", "running", "running", "success"]
    assert latest_run(read_runs(spark, log)).first().status == "failed"


def test_model_feeds_both_policies(spark, sf_dir, windows):
    model = fit_demand_model(windows, SMALL)
    stock = fx.inventory(spark, sf_dir)
    health = sku_health(stock, windows, model, SPEC)
    plain = sku_health(stock, windows, None, SPEC)
    assert health.count() == plain.count() == stock.count()
    both = health.join(plain.select("store_id", "product_id", F.col("predicted_daily_demand").alias("rate")),
                       ["store_id", "product_id"])
    assert both.filter("predicted_daily_demand < rate").isEmpty()  # the higher of both
    decided = decision_table(stock, windows, model, SPEC)
    assert 0 < decided.count() < stock.count()
    assert decided.filter("predicted_daily_demand < 0").isEmpty()


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame(
        [("a", 1, 2.0), ("a", 3, 3.0), ("b", 5, 5.0)], "g string, total_units_sold int, prediction double"
    )
    row = regression_metrics(rows).first()
    assert row.rmse == pytest.approx(math.sqrt(1 / 3)) and row.mae == pytest.approx(1 / 3)
    assert row.r2 == pytest.approx(1 - 1 / 8)
    groups = {r.g: r for r in regression_metrics(rows, by=["g"]).collect()}
    assert groups["a"].r2 == pytest.approx(0.5) and groups["b"].r2 is None
