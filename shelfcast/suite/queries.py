"""The registered queries: every operator over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import date, datetime, timedelta, timezone
from uuid import uuid4

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import DEFAULT_WINDOW, DEMO_WINDOW, WindowSpec
from ..constants import ACTIONS, METRICS, SKU
from ..functions.numbers import fixed_point
from ..functions.text import sku_key, text_flag, version_stamp
from ..operators import events as ev, filters, model as ml, ordering, stock, summary, trends
from ..operators.demand import join_demand, sku_features
from ..operators.windows import latest_window, next_window_label, window_sales
from ..plans.decisions import decision_table
from ..plans.health import (
    demand_predictions, health_of, reorder_list, sku_health as health_plan,
)
from ..plans.rollup import read_daily, refresh_daily
from ..plans.training import current_model, train, train_run
from ..sinks.bucketed import write_bucketed
from ..sinks.pages import read_page, stored_page_count, write_pages
from ..sinks.tables import (
    BY_SKU, compact_closed, export_reorders, write_inventory_csv, write_windowed,
)
from ..sources.events import parse_events, parse_lines, read_event_lines
from ..sinks.stock import append_changes, correct_inventory, delist, fold_inventory, write_inventory
from ..sources.stock import inventory_changes, read_inventory_version
from ..sources.tables import (
    query_windowed, read_compacted, read_inventory, read_runs, read_sellers, read_windowed,
    register_windowed, require_columns, require_rows, stream_windowed,
)
from ..schemas import DECISIONS, SALES_EVENT
from ..streaming import jobs
from ..streaming.state import open_windows
from ..streaming.progress import QUALITY, ProgressLog, late_report, read_progress
from ..workspace import scratch
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SIX_HOURS = WindowSpec("6 hours", "1 hour")
HOUR = WindowSpec.tumbling("1 hour")
DAY = WindowSpec.tumbling("1 day")
FIVE_WEEKS = WindowSpec("35 days", "7 days")
LATE = WindowSpec("12 days", "1 day")
UTC = timezone.utc
BUCKETS = 16
AS_OF = datetime(2024, 1, 31, 12, tzinfo=UTC)
AS_OF_DAY = date(2024, 1, 28)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- events ---------------------------------------------------------------


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_events(fx.event_lines(spark, sf_dir))


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.valid_sales(fx.sales(spark, sf_dir))


@query
def parse_json_events(spark, sf_dir):
    return _parsed(spark, sf_dir)


@query
def valid_sales(spark, sf_dir):
    return ev.valid_sales(_parsed(spark, sf_dir))


@query
def rejected_sales(spark, sf_dir):
    return ev.rejected_sales(_parsed(spark, sf_dir))


@query
def dead_letters(spark, sf_dir):
    """Refused lines with their place in the source, and a field read from the kept text."""
    refused = ev.dead_letters(parse_lines(fx.event_lines(spark, sf_dir, "offset")))
    mode = F.regexp_extract("line", '"payment_mode":"([A-Za-z]+)"', 1)
    return refused.select("offset", "reason", "corrupt", *SALES_EVENT.fieldNames(), mode.alias("line_mode"))


@query
def event_quality(spark, sf_dir):
    return ev.event_quality(_parsed(spark, sf_dir))


@query
def flag_anomalies(spark, sf_dir):
    return ev.flag_anomalies(fx.sales(spark, sf_dir))


@query
def flag_anomalies_li(spark, sf_dir):
    return ev.flag_anomalies(ev.with_category(fx.sales_li(spark, sf_dir)))


@query
def anomaly_shares(spark, sf_dir):
    return ev.anomaly_shares(ev.flag_anomalies(fx.sales(spark, sf_dir)))


@query
def category_sales(spark, sf_dir):
    return ev.category_sales(_valid(spark, sf_dir))


# --- windows --------------------------------------------------------------


def _windows(spark: SparkSession, sf_dir: str, spec: WindowSpec = SIX_HOURS) -> DataFrame:
    return window_sales(_valid(spark, sf_dir), spec)


def _windows_li(spark: SparkSession, sf_dir: str, spec: WindowSpec = DAY) -> DataFrame:
    return window_sales(ev.valid_sales(fx.sales_li(spark, sf_dir)), spec)


@query
def window_sales_5m_1m(spark, sf_dir):
    return _windows(spark, sf_dir, DEFAULT_WINDOW)


@query
def window_sales_30s_10s(spark, sf_dir):
    return _windows(spark, sf_dir, DEMO_WINDOW)


@query
def window_sales_6h_1h(spark, sf_dir):
    return _windows(spark, sf_dir)


@query
def window_sales_direct(spark, sf_dir):
    return window_sales(_valid(spark, sf_dir), SIX_HOURS, panes=False)


@query
def window_sales_35d_7d(spark, sf_dir):
    return _windows_li(spark, sf_dir, FIVE_WEEKS)


@query
def window_sales_1d(spark, sf_dir):
    return _windows_li(spark, sf_dir)


@query
def window_sales_from_json(spark, sf_dir):
    return window_sales(ev.valid_sales(_parsed(spark, sf_dir)), SIX_HOURS)


@query
def latest_windows(spark, sf_dir):
    return latest_window(_windows_li(spark, sf_dir))


@query
def next_window_labels(spark, sf_dir):
    return next_window_label(_windows(spark, sf_dir), SIX_HOURS)


@query
def next_observed_labels(spark, sf_dir):
    return next_window_label(_windows_li(spark, sf_dir), DAY, observed=True)


@query
def store_windows(spark, sf_dir):
    return filters.for_store(_windows(spark, sf_dir), "STORE_003")


@query
def recent_windows(spark, sf_dir):
    return ordering.recent_windows(_windows_li(spark, sf_dir), "STORE_001", 10)


# --- demand and stock -----------------------------------------------------


@query
def sku_features_max(spark, sf_dir):
    return sku_features(_windows_li(spark, sf_dir))


@query
def sku_features_latest(spark, sf_dir):
    return sku_features(_windows(spark, sf_dir), "latest")


@query
def inventory_demand_inner(spark, sf_dir):
    return join_demand(fx.inventory_li(spark, sf_dir), sku_features(_windows_li(spark, sf_dir)))


@query
def inventory_demand_left(spark, sf_dir):
    features = sku_features(_windows_li(spark, sf_dir))
    return join_demand(fx.inventory_li(spark, sf_dir), features, "left")


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = _windows(spark, sf_dir)
    return health_plan(fx.inventory(spark, sf_dir), windows, spec=SIX_HOURS)


def _health_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health_plan(fx.inventory_li(spark, sf_dir), _windows_li(spark, sf_dir), spec=DAY)


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_table(fx.inventory_li(spark, sf_dir), _windows_li(spark, sf_dir), None, DAY)


@query
def sku_health(spark, sf_dir):
    return _health(spark, sf_dir)


@query
def sku_health_li(spark, sf_dir):
    return _health_li(spark, sf_dir)


@query
def reorders_bucketed(spark, sf_dir):
    """Reorder rows from stored features, stock and sellers; no shuffle before the joins."""
    root, tag = scratch(spark, "bucketed"), uuid4().hex
    tables = {
        "features": sku_features(_windows_li(spark, sf_dir)),
        "stock": fx.inventory_li(spark, sf_dir),
        "sellers": fx.sellers_li(spark, sf_dir),
    }
    features, stocked, sellers = (
        write_bucketed(rows, f"{name}_{tag}", f"{root}/{name}", BUCKETS) for name, rows in tables.items()
    )
    health = health_of(ml.score(join_demand(stocked, features, "left"), None), DAY)
    return reorder_list(health, sellers)


@query
def sku_health_no_demand(spark, sf_dir):
    return health_plan(fx.inventory_li(spark, sf_dir), None, spec=DAY)


@query
def decision_table_6h(spark, sf_dir):
    windows = _windows(spark, sf_dir)
    return decision_table(fx.inventory(spark, sf_dir), windows, None, SIX_HOURS)


@query
def decision_table_li(spark, sf_dir):
    return ordering.sort_decisions(_decisions(spark, sf_dir))


@query
def decisions_by_priority(spark, sf_dir):
    windows = _windows(spark, sf_dir)
    rows = decision_table(fx.inventory(spark, sf_dir), windows, None, SIX_HOURS)
    return ordering.sort_decisions(rows, by_priority=True)


@query
def inventory_upsert(spark, sf_dir):
    return stock.upsert_stock(fx.repeated_stock(spark, sf_dir), fx.stock_updates(spark, sf_dir))


@query
def rejected_updates(spark, sf_dir):
    return stock.rejected_updates(fx.stock_updates(spark, sf_dir))


@query
def repeated_skus(spark, sf_dir):
    return stock.repeated_skus(fx.stock_updates(spark, sf_dir))


def _linear_model() -> PipelineModel:
    """A fixed prediction from the metrics, in the place of a forest."""
    formula = "SELECT *, total_units_sold * 2.5D + transaction_count * 0.25D + 1D AS prediction FROM __THIS__"
    return PipelineModel([SQLTransformer(statement=formula)])


@query
def sku_health_model(spark, sf_dir):
    windows = _windows(spark, sf_dir)
    return health_plan(fx.inventory(spark, sf_dir), windows, _linear_model(), SIX_HOURS)


@query
def decision_table_model(spark, sf_dir):
    windows = _windows(spark, sf_dir)
    return decision_table(fx.inventory(spark, sf_dir), windows, _linear_model(), SIX_HOURS)


@query
def sku_features_prediction(spark, sf_dir):
    scored = ml.score(_windows(spark, sf_dir), _linear_model())
    return sku_features(scored, with_prediction=True)


@query
def sku_features_avg(spark, sf_dir):
    return sku_features(_windows(spark, sf_dir), "avg")


# --- decision summaries ---------------------------------------------------


@query
def risk_counts(spark, sf_dir):
    return summary.risk_counts(_decisions(spark, sf_dir))


@query
def action_counts(spark, sf_dir):
    return summary.action_counts(_decisions(spark, sf_dir))


@query
def store_counts(spark, sf_dir):
    return summary.store_counts(_decisions(spark, sf_dir))


@query
def reorder_totals(spark, sf_dir):
    return summary.reorder_totals(_decisions(spark, sf_dir))


@query
def top_reorder_stores(spark, sf_dir):
    return summary.top_reorder_stores(_decisions(spark, sf_dir))


@query
def top_demand_products(spark, sf_dir):
    return summary.top_demand_products(_decisions(spark, sf_dir))


@query
def row_counts(spark, sf_dir):
    subsets = {a.lower(): F.col("action") == a for a in ACTIONS}
    return summary.row_counts(_decisions(spark, sf_dir), **subsets)


@query
def action_subsets(spark, sf_dir):
    return filters.by_action(_decisions(spark, sf_dir), "MONITOR")


@query
def high_risk_decisions(spark, sf_dir):
    return filters.by_stock_out_risk(_decisions(spark, sf_dir), "HIGH")


# --- health reports -------------------------------------------------------


@query
def home_kpis(spark, sf_dir):
    return summary.home_kpis(_health_li(spark, sf_dir))


@query
def risk_distribution(spark, sf_dir):
    return summary.risk_distribution(_health_li(spark, sf_dir))


@query
def inventory_health(spark, sf_dir):
    return summary.inventory_health(_health(spark, sf_dir))


@query
def top_at_risk(spark, sf_dir):
    return ordering.top_at_risk(_health_li(spark, sf_dir))


@query
def health_filtered(spark, sf_dir):
    return filters.filter_skus(_health_li(spark, sf_dir), "store_01", "9", "MEDIUM")


@query
def reorder_rows(spark, sf_dir):
    return reorder_list(_health_li(spark, sf_dir), fx.sellers_li(spark, sf_dir))


@query
def reorder_queue_filtered(spark, sf_dir):
    rows = reorder_list(_health_li(spark, sf_dir), fx.sellers_li(spark, sf_dir))
    key = sku_key(F.col("store_id"), F.col("product_id"))
    return filters.reorder_queue(rows, "STORE_0", "prod_1").withColumn("key", key)


@query
def demand_predictions_first(spark, sf_dir):
    return demand_predictions(_health_li(spark, sf_dir), 200, AS_OF)


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.prediction_rows(summary.demand_rows(_health_li(spark, sf_dir), AS_OF))


@query
def prediction_rows(spark, sf_dir):
    return _predictions(spark, sf_dir)


@query
def demand_search(spark, sf_dir):
    return filters.search(_predictions(spark, sf_dir), "7 prod_0")


@query
def demand_page(spark, sf_dir):
    return ordering.page(_predictions(spark, sf_dir), 3)


@query
def demand_page_stored(spark, sf_dir):
    """The page in the middle of the stored report."""
    path = scratch(spark, "pages")
    write_pages(_predictions(spark, sf_dir), path)
    pages = stored_page_count(spark, path).first()["pages"]
    return read_page(spark, path, pages // 2)


@query
def demand_page_after(spark, sf_dir):
    return ordering.page_after(_predictions(spark, sf_dir), ("STORE_003", "PROD_100"))


@query
def demand_page_count(spark, sf_dir):
    return ordering.page_count(_predictions(spark, sf_dir))


# --- trends ---------------------------------------------------------------


@query
def trend_scaffold(spark, sf_dir):
    return trends.trend_scaffold(_health_li(spark, sf_dir), 14, AS_OF_DAY)


@query
def trend_kpis(spark, sf_dir):
    return trends.trend_kpis(_health(spark, sf_dir), 7, AS_OF_DAY)


@query
def daily_trend(spark, sf_dir):
    windows, inventory = _windows_li(spark, sf_dir), fx.inventory_li(spark, sf_dir)
    return trends.daily_trend(windows, inventory, DAY)


@query
def daily_trend_rollup(spark, sf_dir):
    """The trend from stored daily totals, after windows of a store came late."""
    root, late = scratch(spark, "rollup"), F.col("store_id") == "STORE_003"
    windows = _windows(spark, sf_dir, HOUR)
    write_windowed(windows.filter(~late), f"{root}/windows")
    refresh_daily(spark, f"{root}/windows", f"{root}/daily", HOUR)
    write_windowed(windows.filter(late), f"{root}/windows")
    refresh_daily(spark, f"{root}/windows", f"{root}/daily", HOUR)
    return trends.trend_of(read_daily(spark, f"{root}/daily"), fx.inventory(spark, sf_dir))


@query
def daily_trend_last_days(spark, sf_dir):
    windows, inventory = _windows(spark, sf_dir, HOUR), fx.inventory(spark, sf_dir)
    return ordering.last_days(trends.daily_trend(windows, inventory, HOUR), 7)


def _daily_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction for each SKU and day from its first to its last sale; days without a
    sale have no actual."""
    daily = trends.daily_skus(_windows(spark, sf_dir, HOUR), HOUR)
    predicted = daily.groupBy(*SKU).agg(
        F.max("demand").alias("predicted_demand"),
        F.min("day").alias("first"),
        F.max("day").alias("last"),
    )
    days = predicted.withColumn("day", F.explode(F.sequence("first", "last")))
    return days.join(daily.select(*SKU, "day", "units"), [*SKU, "day"], "left").select(
        *SKU,
        F.date_format("day", "yyyy-MM-dd").alias("date"),
        "predicted_demand",
        F.col("units").cast("double").alias("actual_demand"),
    )


@query
def daily_predicted_vs_actual(spark, sf_dir):
    return summary.daily_predicted_vs_actual(_daily_predictions(spark, sf_dir))


@query
def top_movers(spark, sf_dir):
    return summary.top_movers(_daily_predictions(spark, sf_dir))


@query
def mover_trend(spark, sf_dir):
    daily = trends.daily_skus(_windows(spark, sf_dir, HOUR), HOUR)
    return trends.mover_trend(daily, AS_OF_DAY, 7)


# --- model ----------------------------------------------------------------


@query
def train_test_split(spark, sf_dir):
    rows = ml.with_test_flag(_windows(spark, sf_dir))
    return rows.select("window_start", *SKU, "is_test")


def _with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of which some lack a metric."""
    lines, units = F.col("transaction_count"), F.col("total_units_sold")
    return _windows(spark, sf_dir).withColumns(
        {
            "total_units_sold": F.when(lines % 5 != 0, units),
            "total_revenue": F.when(units % 7 != 0, F.col("total_revenue")),
        }
    )


@query
def null_features_dropped(spark, sf_dir):
    return filters.drop_null_features(_with_gaps(spark, sf_dir))


@query
def null_features_not_scored(spark, sf_dir):
    """Rows that a model with an assembler leaves out."""
    return ml.assemble(_with_gaps(spark, sf_dir)).drop("features")


@query
def checked_windows(spark, sf_dir):
    """Windows that have their columns and rows, and what is said of some that don't."""
    windows = _windows(spark, sf_dir)
    said = []
    for check in (
        lambda: require_columns(windows.drop("total_revenue", "store_id"), SKU + METRICS),
        lambda: require_rows(windows.filter("total_units_sold < 0")),
    ):
        try:
            check()
        except ValueError as refused:
            said.append(str(refused))
    checked = require_rows(require_columns(windows, [*SKU, *METRICS]))
    return checked.withColumn("refusals", F.lit("; ".join(said)))


@query
def demand_rows_now(spark, sf_dir):
    """Demand rows stamped with the clock, and versions named after their windows' times."""
    began = F.lit(datetime.now(UTC))
    rows = summary.demand_rows(_health(spark, sf_dir))
    late = F.unix_seconds("timestamp") - F.unix_seconds(began)
    return rows.select(*SKU, "predicted_daily_demand", late.between(0, 86400).alias("stamped_now"))


@query
def version_stamps(spark, sf_dir):
    stamp = version_stamp("model", F.col("window_start"))
    return _windows(spark, sf_dir).groupBy(stamp.alias("version")).agg(F.count("*").alias("windows"))


@query
def metric_aggregates(spark, sf_dir):
    rows = next_window_label(_windows(spark, sf_dir), SIX_HOURS)
    scored = rows.withColumn("prediction", F.col("total_units_sold") * 0.5 + 1.0)
    found = ml.regression_metrics(scored, "next_units", by=["store_id"])
    whole = {c: fixed_point(F.col(c), 6) / 1e6 for c in ("rmse", "r2", "mae")}
    return found.withColumns(whole)


@query
def rf_metrics(spark, sf_dir):
    """Facts of a forest's evaluation; its numbers depend on the partitioning."""
    _, metrics = train(_windows(spark, sf_dir), label_mode="next_window", spec=SIX_HOURS)
    return metrics.select(
        "rows",
        (F.col("rmse") >= F.col("mae")).alias("rmse_covers_mae"),
        (F.col("mae") > 0).alias("has_error"),
        (F.col("r2") < 1).alias("r2_below_one"),
    )


@query
def rf_importances(spark, sf_dir):
    model, _ = train(_windows(spark, sf_dir), spec=SIX_HOURS)
    share = F.col("importance")
    return ml.importances(model).agg(
        F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("features"),
        F.every(share.between(0, 1)).alias("shares"),
        (F.abs(F.sum(share) - 1) < 1e-9).alias("sum_to_one"),
    )


@query
def rf_scored_health(spark, sf_dir):
    """Facts of a stored forest, loaded again, in the health plan."""
    root = scratch(spark, "rf")
    windows, inventory = _windows(spark, sf_dir), fx.inventory(spark, sf_dir)
    run = train_run(windows, f"{root}/models", f"{root}/runs", spec=SIX_HOURS).first()
    model = current_model(spark, f"{root}/models", f"{root}/runs")
    units = F.col("total_units_sold")
    low, high = windows.agg(F.min(units), F.max(units)).first()
    beyond = ~F.col("prediction").between(low, high)
    out_of_range = ml.score(windows, model).filter(beyond).count()
    health = health_plan(inventory, windows, model, SIX_HOURS)
    rate = health_plan(inventory, windows, None, SIX_HOURS)
    rate = rate.select(*SKU, F.col("predicted_daily_demand").alias("rate"))
    below = F.count_if(F.col("predicted_daily_demand") < F.col("rate"))
    return health.join(rate, [*SKU]).agg(
        F.lit(run["status"]).alias("status"),
        F.count("*").alias("skus"),
        F.lit(out_of_range).cast("bigint").alias("out_of_range"),
        below.alias("below_rate"),
        F.lit(read_runs(spark, f"{root}/runs").count()).cast("bigint").alias("records"),
    )


# --- stored tables --------------------------------------------------------


@query
def partitioned_scan(spark, sf_dir):
    path = scratch(spark, "windows")
    write_windowed(_windows(spark, sf_dir, HOUR), path)
    return query_windowed(
        spark, path, "STORE_003", since=datetime(2024, 1, 5, tzinfo=UTC),
        until=datetime(2024, 1, 20, tzinfo=UTC),
    )


@query
def partitioned_scan_offsets(spark, sf_dir):
    """Bounds in other zones than the session's."""
    path = scratch(spark, "windows")
    write_windowed(_windows(spark, sf_dir, HOUR), path)
    east, west = timezone(timedelta(hours=5, minutes=30)), timezone(timedelta(hours=-5))
    return query_windowed(
        spark, path, since=datetime(2024, 1, 5, tzinfo=east), until=datetime(2024, 1, 19, 20, tzinfo=west)
    )


@query
def sku_directory_lookup(spark, sf_dir):
    path = scratch(spark, "windows")
    write_windowed(_windows(spark, sf_dir, DAY), path, BY_SKU)
    return query_windowed(spark, path, "STORE_003", "PROD_015")


@query
def compacted_scan(spark, sf_dir):
    """Closed dates of streaming files, rewritten in two runs; the rows are the stream's."""
    path = scratch(spark, "windows")
    with _state_partitions(spark):
        jobs.start_windowed(
            _valid_stream(spark, sf_dir, path), f"{path}/small", f"{path}/state", HOUR, every=None
        ).awaitTermination()
    compact_closed(spark, f"{path}/small", f"{path}/big", date(2024, 1, 8))
    compact_closed(spark, f"{path}/small", f"{path}/big", date(2024, 1, 20))
    return read_compacted(spark, f"{path}/small", f"{path}/big")


@query
def windowed_sql(spark, sf_dir):
    path = scratch(spark, "windows")
    write_windowed(_windows(spark, sf_dir), path)
    register_windowed(spark, path, "stored_windows")
    return spark.sql(
        """
        SELECT store_id, product_id, window_start, total_revenue
        FROM stored_windows
        WHERE store_id = 'STORE_001'
        ORDER BY window_start DESC, product_id
        LIMIT 10
        """
    )


@query
def csv_inventory(spark, sf_dir):
    path = scratch(spark, "inventory")
    write_inventory_csv(fx.inventory_li(spark, sf_dir), path)
    return read_inventory(spark, path)


@query
def inventory_version(spark, sf_dir):
    """Corrections of two periods on a base, the first ones folded."""
    root = scratch(spark, "inventory")
    write_inventory(fx.inventory_li(spark, sf_dir), root)
    updates, early = fx.stock_updates(spark, sf_dir), F.year("updated_at") < 1995
    correct_inventory(spark, root, updates.filter(early))
    fold_inventory(spark, root, after=1)
    correct_inventory(spark, root, updates.filter(~early))
    return read_inventory_version(spark, root)


@query
def stock_change_feed(spark, sf_dir):
    """What differs after corrections and a delisting, read from the log of changes."""
    root = scratch(spark, "inventory")
    first = write_inventory(fx.inventory_li(spark, sf_dir), root)
    corrected = correct_inventory(spark, root, fx.stock_updates(spark, sf_dir))
    last = delist(fx.delisted_li(spark, sf_dir), root, corrected)
    return inventory_changes(spark, root, first, last)


@query
def csv_sellers(spark, sf_dir):
    path = scratch(spark, "sellers")
    fx.sellers_li(spark, sf_dir).write.option("header", True).csv(path)
    flag = text_flag(F.col("auto_confirm_eligible"))
    return read_sellers(spark, path).withColumn("auto_confirm_eligible", flag)


@query
def reorder_export(spark, sf_dir):
    path = scratch(spark, "reorders")
    export_reorders(_decisions(spark, sf_dir), path)
    return spark.read.schema(DECISIONS).option("header", True).csv(path)


# --- streams --------------------------------------------------------------


@contextmanager
def _state_partitions(spark: SparkSession) -> Iterator[None]:
    """One state partition per core for the streams started within.

    The default of 200 would give each micro-batch 200 small commits on a
    small machine; a checkpoint keeps the number it was started with.
    """
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _valid_stream(spark: SparkSession, sf_dir: str, root: str, late: bool = False) -> DataFrame:
    """The sales in four files, each a micro-batch."""
    for events in fx.event_slices(spark, sf_dir, 4, late):
        fx.append_slice(events, f"{root}/events")
    return ev.valid_sales(fx.sales_stream(spark, sf_dir, f"{root}/events"))


@query
def stream_windows_append(spark, sf_dir):
    """Only windows the watermark has closed are written."""
    root = scratch(spark, "stream")
    with _state_partitions(spark):
        jobs.start_windowed(
            _valid_stream(spark, sf_dir, root), f"{root}/out", f"{root}/state", SIX_HOURS, every=None
        ).awaitTermination()
    return read_windowed(spark, f"{root}/out")


@query
def stream_windows_panes(spark, sf_dir):
    """The same from two chained aggregates, panes and their sums."""
    root = scratch(spark, "stream")
    with _state_partitions(spark):
        jobs.start_windowed(
            _valid_stream(spark, sf_dir, root), f"{root}/out", f"{root}/state", SIX_HOURS, every=None,
            panes=True,
        ).awaitTermination()
    return read_windowed(spark, f"{root}/out")


@query
def stream_windows_update(spark, sf_dir):
    root = scratch(spark, "stream")
    with _state_partitions(spark):
        jobs.start_windowed(
            _valid_stream(spark, sf_dir, root), f"{root}/out", f"{root}/state", SIX_HOURS,
            mode="update", every=None, fold_every=2,
        ).awaitTermination()
    return jobs.read_live_windows(spark, f"{root}/out")


@query
def stream_late_data(spark, sf_dir):
    """A tenth of the first span comes last: it counts in the windows that are still open."""
    root = scratch(spark, "stream")
    with _state_partitions(spark):
        jobs.start_windowed(
            _valid_stream(spark, sf_dir, root, late=True), f"{root}/out", f"{root}/state", LATE,
            every=None,
        ).awaitTermination()
    return read_windowed(spark, f"{root}/out")


@query
def stream_late_report(spark, sf_dir):
    """What each batch of the stream above took in, what was valid, and what came too late."""
    root = scratch(spark, "stream")
    for events in fx.event_slices(spark, sf_dir, 4, late=True):
        fx.append_slice(events, f"{root}/events")
    counted = ev.observe_quality(fx.sales_stream(spark, sf_dir, f"{root}/events"), QUALITY)
    log = ProgressLog(spark, f"{root}/progress")
    spark.streams.addListener(log)
    try:
        with _state_partitions(spark):
            running = jobs.start_windowed(
                ev.valid_sales(counted), f"{root}/out", f"{root}/state", LATE, every=None
            )
            running.awaitTermination()
        if not log.finished(running):
            raise RuntimeError("the last batches were not reported")
    finally:
        spark.streams.removeListener(log)
    return late_report(read_progress(spark, f"{root}/progress")).drop("query_id")


@query
def stream_dead_letters(spark, sf_dir):
    root = scratch(spark, "stream")
    fx.event_lines(spark, sf_dir).write.text(f"{root}/lines")
    lines = read_event_lines(spark, "text", f"{root}/lines", keep=("_metadata.file_name AS file",))
    jobs.start_dead_letters(lines, f"{root}/out", f"{root}/state", every=None).awaitTermination()
    rows = spark.read.parquet(f"{root}/out")
    return rows.groupBy("reason").agg(
        F.count("*").alias("lines"), F.count_if(F.col("file").startswith("part-")).alias("placed")
    )


@query
def stream_restart(spark, sf_dir):
    """Stopped after half of the files and started again on the same checkpoint."""
    root = scratch(spark, "stream")
    slices = fx.event_slices(spark, sf_dir, 4)
    with _state_partitions(spark):
        for part in (slices[:2], slices[2:]):
            for events in part:
                fx.append_slice(events, f"{root}/events")
            sales = ev.valid_sales(fx.sales_stream(spark, sf_dir, f"{root}/events"))
            jobs.start_windowed(
                sales, f"{root}/out", f"{root}/state", SIX_HOURS, every=None
            ).awaitTermination()
    return read_windowed(spark, f"{root}/out")


@query
def stream_open_windows(spark, sf_dir):
    """What the state of a restarted job holds: the windows that the sink doesn't have yet."""
    root = scratch(spark, "stream")
    slices = fx.event_slices(spark, sf_dir, 4)
    with _state_partitions(spark):
        for part in (slices[:2], slices[2:]):
            for events in part:
                fx.append_slice(events, f"{root}/events")
            sales = ev.valid_sales(fx.sales_stream(spark, sf_dir, f"{root}/events"))
            jobs.start_windowed(
                sales, f"{root}/out", f"{root}/state", SIX_HOURS, every=None
            ).awaitTermination()
    return open_windows(spark, f"{root}/state")


@query
def stream_decisions_stock(spark, sf_dir):
    """Stock changes between two runs: changed SKUs and those that had sold before they were
    listed are decided again, decisions on delisted ones go."""
    root = scratch(spark, "stream")
    stock = fx.inventory(spark, sf_dir)
    unlisted, gone = fx.unlisted(), F.col("current_stock") % 7 == 0
    version = write_inventory(stock.filter(~unlisted), f"{root}/stock")
    slices = fx.event_slices(spark, sf_dir, 4)
    with _state_partitions(spark):
        for run, part in enumerate((slices[:2], slices[2:])):
            for events in part:
                fx.append_slice(events, f"{root}/events")
            sales = ev.valid_sales(fx.sales_stream(spark, sf_dir, f"{root}/events"))
            jobs.start_windowed(
                sales, f"{root}/windows", f"{root}/state", SIX_HOURS, every=None
            ).awaitTermination()
            jobs.start_decisions(
                stream_windowed(spark, f"{root}/windows"), f"{root}/stock", f"{root}/decisions",
                f"{root}/decision_state", spec=SIX_HOURS, every=None, fold_every=1,
            ).awaitTermination()
            if run == 0:
                more = F.when(F.col("lead_time_days") == 3, 50).otherwise(0)
                changed = stock.filter(unlisted | (F.col("lead_time_days") == 3) | gone).withColumns(
                    {"delisted": gone, "current_stock": (F.col("current_stock") + more).cast("int")}
                )
                version = append_changes(changed, f"{root}/stock", version)
    return jobs.read_decisions(spark, f"{root}/decisions")


@query
def stream_validated(spark, sf_dir):
    root = scratch(spark, "stream")
    fx.event_lines(spark, sf_dir).write.text(f"{root}/lines")
    lines = read_event_lines(spark, "text", f"{root}/lines")
    jobs.start_validated(lines, f"{root}/out", f"{root}/state", every=None).awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query
def stream_decisions(spark, sf_dir):
    """Two streams: sales to closed windows, closed windows to decisions."""
    root = scratch(spark, "stream")
    with _state_partitions(spark):
        jobs.start_windowed(
            _valid_stream(spark, sf_dir, root), f"{root}/windows", f"{root}/state", SIX_HOURS, every=None
        ).awaitTermination()
        jobs.start_decisions(
            stream_windowed(spark, f"{root}/windows"), fx.inventory(spark, sf_dir),
            f"{root}/decisions", f"{root}/decision_state", spec=SIX_HOURS, every=None,
        ).awaitTermination()
    return jobs.read_decisions(spark, f"{root}/decisions")
