"""Demand, cover, risk and quantity rules at their borders, and tier counts."""

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from shelfcast import DEMO_WINDOW, StockPolicy, WindowSpec
from shelfcast.functions import policy as rules
from shelfcast.functions.numbers import exact_avg, exact_sum, percent, round2
from shelfcast.operators.events import valid_sales
from shelfcast.operators.summary import risk_distribution
from shelfcast.operators.windows import window_sales
from shelfcast.plans.decisions import decide, decision_table
from shelfcast.plans.health import health_of, sku_health
from shelfcast.suite import fixtures as fx

# stock, lead, demand -> cover, tier, stock-out risk, action, quantities of both policies
BORDERS = [
    (10, 3, 10.0, 1.0, "CRITICAL", "HIGH", "REORDER", 40, 40.0),
    (20, 2, 10.0, 2.0, "HIGH", "MEDIUM", "MONITOR", 20, 20.0),
    (40, 3, 10.0, 4.0, "MEDIUM", "LOW", "NO_ACTION", 10, 10.0),
    (60, 3, 10.0, 6.0, "LOW", "LOW", "NO_ACTION", 0, 0.0),
    (1004, 3, 1000.0, 1.0, "CRITICAL", "HIGH", "REORDER", 3996, 3996.0),
    (1, 3, 0.0, 1.0, "CRITICAL", "LOW", "NO_ACTION", 0, 0.0),
    (0, 2, 0.7, 0.0, "CRITICAL", "HIGH", "REORDER", 2, 3.0),
    (30, 3, 10.0, 3.0, "MEDIUM", "MEDIUM", "MONITOR", 20, 20.0),
    (None, 3, 10.0, None, "LOW", "LOW", "NO_ACTION", 0, 0.0),
]


@pytest.mark.parametrize("case", BORDERS)
def test_borders(spark, case):
    stock, lead, demand, cover, tier, risk, action, qty_cover, qty_lead = case
    rows = spark.createDataFrame(
        [("S", "P", stock, lead, demand)],
        "store_id string, product_id string, current_stock int, lead_time_days int, "
        "predicted_daily_demand double",
    )
    decided = decide(rows).first()
    assert (decided.stock_out_risk, decided.action) == (risk, action)
    assert decided.recommended_reorder_quantity == qty_lead
    if stock is None:
        return
    c, d, n = F.col("current_stock"), F.col("predicted_daily_demand"), F.col("lead_time_days")
    got = rows.select(
        rules.days_of_cover(c, d).alias("cover"),
        rules.risk_level(rules.days_of_cover(c, d)).alias("tier"),
        rules.reorder_qty_cover(c, d, n).alias("qty"),
    ).first()
    assert (got.cover, got.tier, got.qty) == (cover, tier, qty_cover)


def test_demand_scales_with_the_window(spark):
    row = spark.range(1).select(
        rules.daily_demand_from_prediction(F.lit(1.5), WindowSpec()).alias("five_minutes"),
        rules.daily_demand_from_prediction(F.lit(1.5), DEMO_WINDOW).alias("half_minute"),
        rules.daily_demand_from_units(F.lit(7), WindowSpec()).alias("units"),
        rules.daily_demand_from_rate(F.lit(1.4)).alias("rate"),
        rules.daily_demand_from_units(F.lit(1), WindowSpec.tumbling("35 days")).alias("slow"),
        rules.blended_demand(F.lit(-3.0), F.lit(0.0)).alias("floor"),
        rules.blended_demand(F.lit(9.0), F.lit(4.0)).alias("higher"),
    ).first()
    assert row.asDict() == {
        "five_minutes": 432.0, "half_minute": 4320.0, "units": 2016.0, "rate": 2016.0,
        "slow": 0.03, "floor": 0.0, "higher": 9.0,
    }


def test_health_takes_the_higher_demand(spark):
    rows = spark.createDataFrame(
        [("S", "P", 10, 3, 2, 100.0)],
        "store_id string, product_id string, current_stock int, lead_time_days int, "
        "total_units_sold bigint, prediction double",
    )
    assert health_of(rows).first().predicted_daily_demand == 28800.0
    rows = rows.withColumn("prediction", F.lit(-1.0))
    assert health_of(rows).first().predicted_daily_demand == 576.0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    rows=st.lists(
        st.tuples(st.integers(0, 5000), st.integers(0, 10), st.integers(0, 200000).map(lambda c: c / 100)),
        min_size=1, max_size=60,
    )
)
def test_rules_are_monotone(spark, rows):
    data = spark.createDataFrame(rows, "s int, n int, d double")
    stock, lead, demand = F.col("s"), F.col("n"), F.col("d")
    tiers = {"CRITICAL": 3, "HIGH": 2, "MEDIUM": 1, "LOW": 0}
    got = data.select(
        *[rules.risk_level(rules.days_of_cover(stock + i, demand)).alias(f"t{i}") for i in (0, 7)],
        *[rules.reorder_qty_cover(stock + i, demand, lead).alias(f"q{i}") for i in (0, 7)],
        *[rules.reorder_qty_lead_time(stock + i, demand, lead).alias(f"l{i}") for i in (0, 7)],
    ).collect()
    for row in got:
        assert tiers[row.t7] <= tiers[row.t0]
        assert 0 <= row.q7 <= row.q0 and 0 <= row.l7 <= row.l0


def test_numbers(spark):
    row = spark.range(1).select(
        round2(F.lit(1.125)).alias("half_up"),
        round2(F.lit(-0.004)).alias("small"),
        round2(F.lit(None).cast("double")).alias("null"),
        percent(F.lit(1), F.lit(0)).alias("empty"),
        percent(F.lit(1), F.lit(3)).alias("third"),
    ).first()
    assert row.asDict() == {"half_up": 1.13, "small": 0.0, "null": None, "empty": 100.0, "third": 33.33}
    values = spark.createDataFrame([(0.1,)] * 1000 + [(None,)], "v double")
    sums = values.agg(exact_sum(F.col("v")).alias("s"), exact_avg(F.col("v")).alias("a")).first()
    assert (sums.s, sums.a) == (100.0, 0.1)
    none = values.filter("v > 9").agg(exact_sum(F.col("v")).alias("s"), exact_avg(F.col("v")).alias("a"))
    assert none.first().asDict() == {"s": None, "a": None}


def _gap(rows):
    """Demand without the SKUs whose numbers add up to a multiple of seven."""
    def number(c):
        return F.regexp_extract(c, r"_(\d+)$", 1).cast("int")

    return rows.filter((number("store_id") + number("product_id")) % 7 != 0)


@pytest.mark.parametrize(
    "source, spec, skus, idle, tiers, three",
    [
        ("sales", WindowSpec("6 hours", "1 hour"), 250, 35, (42, 50, 76, 82), (125, 47)),
        ("sales_li", WindowSpec.tumbling("1 day"), 51731, 7388, (6179, 5943, 11923, 27686), (17722, 5353)),
    ],
)
def test_tier_counts(spark, sf01_dir, source, spec, skus, idle, tiers, three):
    sales = getattr(fx, source)(spark, sf01_dir)
    stocked = {"sales": fx.inventory, "sales_li": fx.inventory_li}[source](spark, sf01_dir)
    sold = sales.select("store_id", "product_id").distinct()
    stocked = stocked.join(sold, ["store_id", "product_id"], "left_semi")
    windows = _gap(window_sales(valid_sales(sales), spec))
    health = sku_health(stocked, windows, spec=spec)
    assert health.count() == skus
    assert health.filter("actual_sales = 0").count() == idle
    row = risk_distribution(health).first()
    assert (row.CRITICAL, row.HIGH, row.MEDIUM, row.LOW) == tiers
    decided = decision_table(stocked, windows, None, spec)
    assert decided.count() == skus - idle
    assert tuple(decided.filter(f"stock_out_risk = '{r}'").count() for r in ("HIGH", "MEDIUM")) == three


def test_policy_is_a_parameter(spark):
    strict = StockPolicy(critical_days=5, buffer_days=10)
    row = spark.range(1).select(
        rules.risk_level(F.lit(4.5), strict).alias("tier"),
        rules.reorder_qty_cover(F.lit(0), F.lit(1.0), F.lit(3), strict).alias("qty"),
    ).first()
    assert (row.tier, row.qty) == ("CRITICAL", 13)
