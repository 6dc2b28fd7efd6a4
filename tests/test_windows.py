"""Sliding windows, latest and next window."""

from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from shelfcast import DEFAULT_WINDOW, DEMO_WINDOW, WindowSpec
from shelfcast.operators import windows as ow
from shelfcast.operators.windows import latest_window, next_window_label, window_sales
from shelfcast.suite import fixtures as fx

SALE = "event_time timestamp, store_id string, product_id string, unit_price double, quantity int"
BASE = datetime(2024, 3, 1, 10, tzinfo=timezone.utc)
QUIET = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def frame(spark, rows):
    return spark.createDataFrame(rows, SALE)


def brute_force(rows, spec):
    """(start, store, product) -> [units, cents, count] over all windows."""
    out = defaultdict(lambda: [0, 0, 0])
    for at, store, product, price, quantity in rows:
        second = at.timestamp()
        start = second // spec.slide_seconds * spec.slide_seconds
        while start + spec.window_seconds > second:
            cell = out[(int(start), store, product)]
            cell[0] += quantity
            cell[1] += round(price * 100) * quantity
            cell[2] += 1
            start -= spec.slide_seconds
    return dict(out)


def found(windows):
    return {
        (int(r.window_start.replace(tzinfo=timezone.utc).timestamp()), r.store_id, r.product_id): [
            r.total_units_sold, round(r.total_revenue * 100), r.transaction_count
        ]
        for r in windows.collect()
    }


sales_lists = st.lists(
    st.tuples(
        st.integers(-4000, 4000).map(lambda s: BASE + timedelta(seconds=s, milliseconds=250)),
        st.sampled_from(["A", "B"]),
        st.sampled_from(["P", "Q", None]),
        st.integers(1, 9999).map(lambda c: c / 100),
        st.integers(1, 50),
    ),
    max_size=40,
)
specs = st.sampled_from(
    [
        DEFAULT_WINDOW, DEMO_WINDOW, WindowSpec("7 minutes", "3 minutes"),
        WindowSpec("5 minutes", "2 minutes"), WindowSpec.tumbling("10 minutes"),
        WindowSpec("1 hour", "25 minutes"),
    ]
)


@QUIET
@given(rows=sales_lists, spec=specs)
def test_panes_and_direct_equal_brute_force(spark, rows, spec):
    data = frame(spark, rows)
    expected = brute_force(rows, spec)
    assert found(window_sales(data, spec)) == expected
    assert found(window_sales(data, spec, panes=False)) == expected


def test_event_counts_in_as_many_windows_as_overlap(spark):
    one = frame(spark, [(BASE + timedelta(seconds=30.25), "A", "P", 20.0, 2)])
    assert window_sales(one).count() == 5 == DEFAULT_WINDOW.overlap
    assert window_sales(one, DEMO_WINDOW).count() == 3 == DEMO_WINDOW.overlap
    first = window_sales(one).orderBy("window_start").first()
    assert first.window_end - first.window_start == timedelta(minutes=5)
    assert (first.total_units_sold, first.total_revenue, first.avg_units_per_minute) == (2, 40.0, 0.4)


def test_times_before_1970(spark):
    rows = [(datetime(1969, 12, 31, 23, 58, 30, tzinfo=timezone.utc), "A", "P", 1.0, 1)]
    expected = brute_force(rows, DEFAULT_WINDOW)
    for panes in (True, False):
        assert found(window_sales(frame(spark, rows), panes=panes)) == expected


def test_units_over_all_windows(spark, sf_dir):
    sales = fx.sales(spark, sf_dir).filter("quantity > 0 AND unit_price > 0")
    spec = WindowSpec("6 hours", "1 hour")
    total = sales.agg(F.sum("quantity")).first()[0]
    assert window_sales(sales, spec).agg(F.sum("total_units_sold")).first()[0] == total * 6


def test_schema_is_the_same_for_all_specs(spark, sf_dir):
    sales = fx.sales(spark, sf_dir)
    assert window_sales(sales).schema.simpleString() == window_sales(sales, DEMO_WINDOW).schema.simpleString()
    assert dict(window_sales(sales).dtypes)["avg_units_per_minute"] == "double"


@pytest.mark.parametrize("window, slide", [("1 minute", "2 minutes"), ("0 minutes", "0 minutes")])
def test_bad_specs(window, slide):
    with pytest.raises(ValueError):
        WindowSpec(window, slide)


def test_windows_per_day():
    assert WindowSpec().windows_per_day == 288
    assert DEMO_WINDOW.windows_per_day == 2880


@QUIET
@given(rows=sales_lists, spec=st.sampled_from([DEFAULT_WINDOW, WindowSpec("6 minutes", "2 minutes")]))
def test_next_window_label(spark, rows, spec):
    windows = window_sales(frame(spark, rows), spec)
    units = {k: v[0] for k, v in found(windows).items()}
    label = {
        (int(r.window_start.replace(tzinfo=timezone.utc).timestamp()), r.store_id, r.product_id): r.next_units
        for r in next_window_label(windows, spec).collect()
    }
    assert label == {
        (start, s, p): units.get((start + spec.window_seconds, s, p), 0) for start, s, p in units
    }


def test_next_observed_and_latest(spark):
    rows = [(BASE + timedelta(minutes=m), "A", "P", 1.0, q) for m, q in ((0, 1), (30, 2), (90, 4))]
    spec = WindowSpec.tumbling("10 minutes")
    windows = window_sales(frame(spark, rows), spec)
    by_time = next_window_label(windows, spec, observed=True).orderBy("window_start").collect()
    assert [r.next_units for r in by_time] == [2, 4, None]
    last = latest_window(windows).collect()
    assert [(r.total_units_sold, r.window_start.hour) for r in last] == [(4, 11)]


@QUIET
@given(rows=sales_lists, span=st.sampled_from([1, 2, 7]))
def test_next_observed_in_spans(spark, rows, span):
    """Borders of spans, also of empty ones, don't matter."""
    spec = WindowSpec.tumbling("1 minute")
    windows = window_sales(frame(spark, rows), spec)
    before, ow.OBSERVED_SPAN = ow.OBSERVED_SPAN, span
    try:
        got = {(r.window_start, r.store_id, r.product_id): r.next_units
               for r in next_window_label(windows, spec, observed=True).collect()}
    finally:
        ow.OBSERVED_SPAN = before
    times = {}
    for r in windows.collect():
        times.setdefault((r.store_id, r.product_id), []).append((r.window_start, r.total_units_sold))
    expected = {}
    for sku, seen in times.items():
        seen.sort()
        for (start, _), later in zip(seen, [*seen[1:], (None, None)]):
            expected[start, *sku] = later[1]
    assert got == expected


def test_observed_labels_spread_a_hot_sku(spark):
    """A third of all rows on one SKU: no partition of the ordered rows holds it whole."""
    spec = WindowSpec.tumbling("1 minute")
    start = F.timestamp_seconds(F.col("id") * 60)
    windows = spark.range(30000).select(
        start.alias("window_start"), (start + F.expr("INTERVAL 1 MINUTE")).alias("window_end"),
        F.lit("S").alias("store_id"), F.when(F.col("id") % 3 == 0, "P").otherwise(F.concat(F.lit("Q"), F.col("id") % 2000)).alias("product_id"),
        F.col("id").alias("total_units_sold"), F.lit(1.0).alias("total_revenue"),
        F.lit(1.0).alias("avg_units_per_minute"), F.lit(1).cast("long").alias("transaction_count"),
    )
    labelled = next_window_label(windows, spec, observed=True)
    plans = labelled._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(store_id" in plans and "span" in plans
    held = labelled.filter("product_id = 'P'").groupBy(F.spark_partition_id()).count().collect()
    assert len(held) > 1 and sum(r["count"] for r in held) == 10000
    assert labelled.filter("product_id = 'P' AND next_units = total_units_sold + 3").count() == 9999


def test_revenue_does_not_depend_on_row_order(spark):
    rows = [(BASE, "A", "P", 0.1 + i / 1000, 3) for i in range(500)]
    one = window_sales(frame(spark, rows)).collect()
    other = window_sales(frame(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(one) == sorted(other)


@QUIET
@given(rows=sales_lists, span=st.sampled_from([1, 7]), spec=st.sampled_from([DEFAULT_WINDOW, DEMO_WINDOW]))
def test_windows_on_the_borders_of_spans(spark, rows, span, spec):
    before, ow.PANE_SPAN = ow.PANE_SPAN, span
    try:
        assert found(window_sales(frame(spark, rows), spec)) == brute_force(rows, spec)
    finally:
        ow.PANE_SPAN = before


def test_panes_are_multiplied_after_the_last_shuffle(spark, sf_dir):
    from shelfcast.suite import fixtures as fx

    windows = window_sales(fx.sales_li(spark, sf_dir), WindowSpec("35 days", "7 days"))
    text = windows._jdf.queryExecution().executedPlan().toString()
    multiplied = text.index("Generate inline")
    assert "Exchange" not in text[:multiplied] and "Aggregate" not in text[:multiplied]
    assert text.count("Exchange") == 2
