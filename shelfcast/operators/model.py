"""The demand model: features, split, forest, scores and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import ForestParams
from ..constants import FEATURES, LABEL, SKU
from ..sources.tables import require_columns


def assembler() -> VectorAssembler:
    """The four metrics as one vector; rows with a null metric vanish."""
    return VectorAssembler(inputCols=[*FEATURES], outputCol="features", handleInvalid="skip")


def assemble(rows: DataFrame) -> DataFrame:
    return assembler().transform(require_columns(rows, FEATURES))


def split(
    rows: DataFrame, test_percent: float = 20.0, keys: Sequence[str] = (*SKU, "window_start")
) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key.

    A row's side depends on its key alone, so it survives repartitioning,
    retried tasks and new data, which a random split does not.
    """
    sides = with_test_flag(rows, test_percent, keys)
    return tuple(
        sides.filter(F.col("is_test") == flag).drop("is_test") for flag in (False, True)
    )


def with_test_flag(
    rows: DataFrame, test_percent: float = 20.0, keys: Sequence[str] = (*SKU, "window_start")
) -> DataFrame:
    """Adds ``is_test``: the first four hex digits of the key's md5 below the share."""
    limit = F.lit(f"{round(test_percent / 100 * 0x10000):04x}")
    types = dict(rows.dtypes)
    parts = [F.unix_seconds(k) if types[k] == "timestamp" else F.col(k) for k in keys]
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return rows.withColumn("is_test", F.substring(digest, 1, 4) < limit)


def fit_demand_model(
    rows: DataFrame, params: ForestParams = ForestParams(), label: str = LABEL
) -> PipelineModel:
    """Assembler and random forest, fitted on the cluster."""
    forest = RandomForestRegressor(
        featuresCol="features",
        labelCol=label,
        numTrees=params.trees,
        maxDepth=params.depth,
        subsamplingRate=params.subsampling,
        seed=params.seed,
        cacheNodeIds=True,  # halves the time per level; same forest
    )
    needed = rows.select(*dict.fromkeys((*FEATURES, label)))
    return Pipeline(stages=[assembler(), forest]).fit(needed)


def score(rows: DataFrame, model: Transformer | None) -> DataFrame:
    """Adds ``prediction``; without a model it is 0.0."""
    if model is None:
        return rows.withColumn("prediction", F.lit(0.0))
    scored = model.transform(require_columns(rows, FEATURES).drop("prediction"))
    return scored.drop("features")


def regression_metrics(
    scored: DataFrame, label: str = LABEL, prediction: str = "prediction",
    by: Sequence[str] = (),
) -> DataFrame:
    """Row count, RMSE, R² and MAE, overall or per group, in one aggregate."""
    y, error = F.col(label).cast("double"), F.col(label) - F.col(prediction)
    squared = F.avg(error * error)
    return scored.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.sqrt(squared).alias("rmse"),
        (1 - F.try_divide(squared, F.var_pop(y))).alias("r2"),
        F.avg(F.abs(error)).alias("mae"),
    )


def importances(model: PipelineModel) -> DataFrame:
    """(feature, importance), largest first; four rows."""
    rows = zip(FEATURES, model.stages[-1].featureImportances.toArray().tolist())
    frame = SparkSession.active().createDataFrame([*rows], "feature string, importance double")
    return frame.orderBy(F.desc("importance"), "feature")
