"""Windows collapsed to one row per SKU, and joined to stock."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import METRICS, SKU
from ..functions.numbers import exact_avg
from .windows import latest_window


def sku_features(
    windows: DataFrame, how: str = "max", *, with_prediction: bool = False
) -> DataFrame:
    """One row per SKU: the ``max``, ``avg`` or ``latest`` of each metric.

    ``max`` and ``avg`` keep an existing ``prediction`` when asked for it.
    """
    if how == "latest":
        return latest_window(windows).select(*SKU, *METRICS)
    fold = {"max": F.max, "avg": exact_avg}[how]
    kept = [*METRICS]
    if with_prediction and "prediction" in windows.columns:
        kept.append("prediction")
    return windows.groupBy(*SKU).agg(*[fold(F.col(c)).alias(c) for c in kept])


def join_demand(inventory: DataFrame, features: DataFrame, how: str = "inner") -> DataFrame:
    """Stock with demand metrics; ``left`` keeps unsold SKUs and fills zeros.

    Both sides hold one row per SKU, so no key is hot. The stock table grows
    with the catalogue and is not hinted: Spark broadcasts it only below its
    size threshold.
    """
    joined = inventory.join(features, [*SKU], how)
    if how == "left":
        joined = joined.fillna(0, subset=[c for c in features.columns if c not in SKU])
    return joined
