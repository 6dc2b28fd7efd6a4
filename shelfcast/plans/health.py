"""Days-of-cover policy: SKU health and the reports built on it."""

from __future__ import annotations

from datetime import datetime

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT_WINDOW, StockPolicy, WindowSpec
from ..constants import DEMAND_ROWS, DRAFT_ORDER, REORDER_PENDING, SKU
from ..functions import policy as rules
from ..functions.numbers import round2
from ..operators import summary
from ..operators.demand import join_demand, sku_features
from ..operators.filters import at_risk
from ..operators.model import score
from ..operators.ordering import first_rows, top_at_risk
from ..operators.stock import with_sellers
from ..schemas import SKU_FEATURES


def sku_health(
    inventory: DataFrame, windows: DataFrame | None, model: Transformer | None = None,
    spec: WindowSpec = DEFAULT_WINDOW, policy: StockPolicy = StockPolicy(),
) -> DataFrame:
    """Demand, cover, risk tier and reorder quantity of every stocked SKU.

    Demand is the higher of the model's prediction and the streaming rate.
    ``windows=None`` is the case without any aggregates: all SKUs stay, with
    zero demand.
    """
    if windows is None:
        features = inventory.sparkSession.createDataFrame([], SKU_FEATURES)
    else:
        features = sku_features(windows)
    return health_of(score(join_demand(inventory, features, "left"), model), spec, policy)


def health_of(
    scored: DataFrame, spec: WindowSpec = DEFAULT_WINDOW, policy: StockPolicy = StockPolicy()
) -> DataFrame:
    """SKU health from joined and scored rows.

    The cover is exploded from an array of one. Else a filter on the risk level is pushed
    below all of these columns with their formulas put into each other, which makes a method
    of more than the 8000 bytes that the JVM compiles: a join in it then runs interpreted.
    """
    stock, lead, demand = (
        F.col(c) for c in ("current_stock", "lead_time_days", "predicted_daily_demand")
    )
    predicted = rules.blended_demand(
        rules.daily_demand_from_prediction(F.col("prediction"), spec),
        rules.daily_demand_from_units(F.col("total_units_sold"), spec),
    )
    return to_sku_health(
        scored.withColumns(
            {
                "predicted_daily_demand": predicted,
                "actual_sales": round2(F.col("total_units_sold").cast("double")),
            }
        )
        .withColumn("days_of_cover", F.explode(F.array(rules.days_of_cover(stock, demand))))
        .withColumns(
            {
                "risk_level": rules.risk_level(F.col("days_of_cover"), policy),
                "recommended_reorder_quantity": rules.reorder_qty_cover(
                    stock, demand, lead, policy
                ),
            }
        )
    )


def to_sku_health(rows: DataFrame) -> DataFrame:
    return rows.select(
        *SKU,
        "current_stock",
        "lead_time_days",
        "predicted_daily_demand",
        "actual_sales",
        "days_of_cover",
        "risk_level",
        "recommended_reorder_quantity",
    )


def home_summary(
    health: DataFrame, run: DataFrame | None = None, policy: StockPolicy = StockPolicy()
) -> dict[str, DataFrame]:
    """The parts of the home report by name; ``run`` is ``latest_run(...)``.

    Pass a persisted ``health``: four of the five parts read it.
    """
    parts = {
        "kpis": summary.home_kpis(health, policy).withColumn(
            "last_refresh", F.current_timestamp()
        ),
        "inventory_health": summary.inventory_health(health),
        "risk_distribution": summary.risk_distribution(health),
        "top_at_risk": top_at_risk(health),
    }
    if run is not None:
        parts["model"] = run.select("model_version")
    return parts


def to_reorder_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        *SKU,
        "risk_level",
        "recommended_reorder_quantity",
        "seller_name",
        "seller_contact",
        F.lit(DRAFT_ORDER).alias("action"),
        "auto_confirm_eligible",
        F.lit(REORDER_PENDING).alias("status"),
        F.lit(None).cast("string").alias("last_reorder_date"),
        "current_stock",
        "predicted_daily_demand",
        "days_of_cover",
    )


def reorder_list(health: DataFrame, sellers: DataFrame) -> DataFrame:
    """The at-risk SKUs with their sellers."""
    return to_reorder_rows(with_sellers(at_risk(health), sellers))


def demand_predictions(
    health: DataFrame, limit: int = DEMAND_ROWS, as_of: datetime | None = None
) -> DataFrame:
    """The first ``limit`` SKUs by key with their demand."""
    return summary.demand_rows(first_rows(health, limit), as_of)
