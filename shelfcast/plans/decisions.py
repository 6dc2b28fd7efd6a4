"""Lead-time policy: the decision table and what is read off it."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT_WINDOW, StockPolicy, WindowSpec
from ..constants import ACTIONS, SKU
from ..functions import policy as rules
from ..operators import summary
from ..operators.demand import join_demand, sku_features
from ..operators.filters import by_action
from ..operators.model import score
from ..operators.ordering import sort_decisions


def decide(
    stock_demand: DataFrame, policy: StockPolicy = StockPolicy()
) -> DataFrame:
    """Stock-out risk, reorder quantity and action from ``predicted_daily_demand``."""
    stock, demand, lead = (
        F.col(c) for c in ("current_stock", "predicted_daily_demand", "lead_time_days")
    )
    risk = rules.stock_out_risk(stock, demand, lead, policy)
    quantity = rules.reorder_qty_lead_time(stock, demand, lead, policy)
    return to_decisions(
        stock_demand.withColumns(
            {"stock_out_risk": risk, "recommended_reorder_quantity": quantity}
        ).withColumn("action", rules.action(F.col("stock_out_risk")))
    )


def to_decisions(rows: DataFrame) -> DataFrame:
    return rows.select(
        *SKU,
        "current_stock",
        "predicted_daily_demand",
        "stock_out_risk",
        "recommended_reorder_quantity",
        "action",
    )


def decisions_of(
    stock_features: DataFrame, model: Transformer | None, spec: WindowSpec = DEFAULT_WINDOW,
    policy: StockPolicy = StockPolicy(),
) -> DataFrame:
    """Decisions from joined stock and SKU features.

    Without a model the demand is the streaming rate scaled to a day.
    """
    if model is None:
        demand = rules.daily_demand_from_units(F.col("total_units_sold"), spec)
    else:
        stock_features = score(stock_features, model)
        demand = rules.daily_demand_from_prediction(F.col("prediction"), spec)
    return decide(stock_features.withColumn("predicted_daily_demand", demand), policy)


def decision_table(
    inventory: DataFrame, windows: DataFrame, model: Transformer | None,
    spec: WindowSpec = DEFAULT_WINDOW, policy: StockPolicy = StockPolicy(),
) -> DataFrame:
    """One decision per stocked SKU that has demand, unsorted.

    The result is small next to its inputs: persist it once when several
    summaries are read off it.
    """
    return decisions_of(join_demand(inventory, sku_features(windows)), model, spec, policy)


def decision_insights(decisions: DataFrame) -> dict[str, DataFrame]:
    """All summaries of a decision table by name."""
    return {
        "decisions": sort_decisions(decisions),
        "risk_counts": summary.risk_counts(decisions),
        "action_counts": summary.action_counts(decisions),
        "store_counts": summary.store_counts(decisions),
        "totals": summary.reorder_totals(decisions),
        "top_stores": summary.top_reorder_stores(decisions),
        "top_products": summary.top_demand_products(decisions),
        "sizes": summary.row_counts(
            decisions, **{a.lower(): F.col("action") == a for a in ACTIONS}
        ),
        **{a.lower(): by_action(decisions, a) for a in ACTIONS},
    }
