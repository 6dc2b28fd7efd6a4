"""One training run from windows to a stored model and a run record."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import DEFAULT_WINDOW, ForestParams, WindowSpec
from ..constants import FAILED, LABEL, MODEL_CURRENT, MODEL_NAME, RUNNING, SUCCESS
from ..functions.text import version_stamp
from ..operators.filters import drop_null_features
from ..operators.model import fit_demand_model, regression_metrics, score, split
from ..operators.windows import next_window_label
from ..schemas import RUNS
from ..sinks.tables import append_run, save_model
from ..sources.tables import latest_run, load_model, read_runs, require_rows

NEXT_LABEL = "next_units"


def labelled(windows: DataFrame, label_mode: str, spec: WindowSpec) -> tuple[DataFrame, str]:
    """Rows and label column.

    ``proxy`` predicts the window's own units, which are also a feature, so its
    R² says nothing about forecasts; ``next_window`` predicts the window that
    follows.
    """
    if label_mode == "proxy":
        return windows, LABEL
    if label_mode == "next_window":
        return next_window_label(windows, spec), NEXT_LABEL
    raise ValueError(f"unknown label mode {label_mode!r}")


def train(
    windows: DataFrame, params: ForestParams = ForestParams(), *, label_mode: str = "proxy",
    spec: WindowSpec = DEFAULT_WINDOW,
) -> tuple[PipelineModel, DataFrame]:
    """(model, one row of metrics on the held-out part)."""
    rows, label = labelled(drop_null_features(windows), label_mode, spec)
    # The forest reads its input several times; lost blocks are recomputed.
    rows = rows.persist()
    try:
        fit_rows, test_rows = split(require_rows(rows), params.test_percent)
        model = fit_demand_model(fit_rows, params, label)
        metrics = regression_metrics(score(test_rows, model), label).first()
    finally:
        rows.unpersist()
    frame = windows.sparkSession.createDataFrame(
        [metrics], "rows bigint, rmse double, r2 double, mae double"
    )
    return model, frame


def train_run(
    windows: DataFrame, model_root: str, run_log: str, params: ForestParams = ForestParams(),
    *, label_mode: str = "proxy", spec: WindowSpec = DEFAULT_WINDOW,
) -> DataFrame:
    """Train, evaluate, store the model under its version and log the run.

    The run is logged as running first, so a killed one leaves a trace. A failed
    run logs the error and repeats the last good version and metrics. The returned
    row is the last logged record. A version has microseconds and is never stored
    over another.
    """
    spark = windows.sparkSession
    before = latest_run(read_runs(spark, run_log)).first()
    now = datetime.now(timezone.utc)
    kept = (before["last_run"], before["model_version"], before["rmse"], before["r2"], before["mae"])
    append_run(spark.createDataFrame([(RUNNING, *kept, None, now)], RUNS), run_log)
    try:
        model, metrics = train(windows, params, label_mode=label_mode, spec=spec)
        found = metrics.first()
        version = spark.range(1).select(version_stamp(MODEL_NAME, F.lit(now))).first()[0]
        save_model(model, f"{model_root}/{version}")
        record = (SUCCESS, now, version, found["rmse"], found["r2"], found["mae"], None)
    except Exception as error:  # any failure belongs in the log
        record = (FAILED, *kept, str(error))
    run = spark.createDataFrame([(*record, datetime.now(timezone.utc))], RUNS)
    append_run(run, run_log)
    return run


def current_model(spark: SparkSession, model_root: str, run_log: str) -> PipelineModel | None:
    """The model of the last successful run, if there is one."""
    version = latest_run(read_runs(spark, run_log)).first()["model_version"]
    return None if version == MODEL_CURRENT else load_model(f"{model_root}/{version}")
