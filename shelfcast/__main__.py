"""The jobs as commands, for ``spark-submit`` or ``python -m shelfcast``.

    windows    event lines -> windowed aggregates (stream)
    validate   event lines -> valid events (stream)
    decide     windows + stock -> decision table and reorder export
    reports    windows + stock -> SKU health and every report read off it
    train      windows -> stored model and run record
    update     stock corrections -> new stock snapshot
    compact    many small window files -> few

Master, memory and storage settings come from the submitting command.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from .config import ForestParams, WindowSpec
from .constants import DEMAND_ROWS_MAX, TREND_DAYS
from .operators import summary, trends
from .operators.events import valid_sales
from .operators.ordering import sort_decisions
from .operators.stock import rejected_updates, upsert_stock
from .plans.decisions import decision_table
from .plans.health import demand_predictions, home_summary, reorder_list, sku_health
from .plans.training import current_model, train_run
from .schemas import STOCK_UPDATES
from .sinks.stock import correct_inventory, write_inventory
from .sinks.tables import BY_DATE, BY_SKU, compact_windowed, export_reorders
from .sources.events import parse_events, read_event_lines
from .sources.stock import read_inventory_version
from .sources.tables import (
    latest_run, load_model, read_inventory, read_runs, read_sellers, read_windowed, stream_windowed,
)
from .streaming.jobs import (
    ROW_TRIGGER, WINDOW_TRIGGER, start_decisions, start_validated, start_windowed,
)

LAYOUTS = {"date": BY_DATE, "sku": BY_SKU}


def _lines(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    options = dict(pair.split("=", 1) for pair in args.option)
    return read_event_lines(spark, args.format, args.path, **options)


def _spec(args: argparse.Namespace) -> WindowSpec:
    return WindowSpec(args.window, args.slide, args.watermark)


def _stock(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file or folder, or the root of a versioned snapshot."""
    if path.startswith("versions:"):
        return read_inventory_version(spark, path.removeprefix("versions:"))
    return read_inventory(spark, path)


def windows(spark: SparkSession, args: argparse.Namespace) -> None:
    sales = valid_sales(parse_events(_lines(spark, args)))
    start_windowed(
        sales, args.output, args.checkpoint, _spec(args), mode=args.mode,
        every=None if args.once else args.every or WINDOW_TRIGGER, layout=LAYOUTS[args.layout],
        panes=args.panes,
    ).awaitTermination()


def validate(spark: SparkSession, args: argparse.Namespace) -> None:
    every = None if args.once else args.every or ROW_TRIGGER
    start_validated(_lines(spark, args), args.output, args.checkpoint, every).awaitTermination()


def follow(spark: SparkSession, args: argparse.Namespace) -> None:
    """Decisions on stored windows as they come; ``versions:ROOT`` follows the stock too."""
    root = args.inventory.removeprefix("versions:")
    stock = root if root != args.inventory else read_inventory(spark, root)
    start_decisions(
        stream_windowed(spark, args.windows), stock, args.output, args.checkpoint,
        load_model(args.model) if args.model else None, _spec(args),
        every=None if args.once else args.every or WINDOW_TRIGGER,
    ).awaitTermination()


def decide(spark: SparkSession, args: argparse.Namespace) -> None:
    model = load_model(args.model) if args.model else None
    stored = read_windowed(spark, args.windows)
    decisions = decision_table(_stock(spark, args.inventory), stored, model, _spec(args)).persist()
    sort_decisions(decisions).write.parquet(f"{args.output}/decisions")
    export_reorders(decisions, f"{args.output}/reorders")
    for name, rows in {
        "risk_counts": summary.risk_counts(decisions),
        "action_counts": summary.action_counts(decisions),
        "store_counts": summary.store_counts(decisions),
        "totals": summary.reorder_totals(decisions),
        "top_stores": summary.top_reorder_stores(decisions),
        "top_products": summary.top_demand_products(decisions),
    }.items():
        rows.write.parquet(f"{args.output}/{name}")
    decisions.unpersist()


def reports(spark: SparkSession, args: argparse.Namespace) -> None:
    model = current_model(spark, args.models, args.runs) if args.models else None
    stored = read_windowed(spark, args.windows) if args.windows else None
    health = sku_health(_stock(spark, args.inventory), stored, model, _spec(args)).persist()
    run = latest_run(read_runs(spark, args.runs)) if args.runs else None
    tables = {
        "health": health,
        **home_summary(health, run),
        "demand_predictions": demand_predictions(health, args.limit),
        "trends": trends.trend_scaffold(health, args.days),
        "trend_kpis": trends.trend_kpis(health, args.days),
    }
    if stored is not None and _spec(args).is_tumbling:
        daily = trends.daily_trend(stored, _stock(spark, args.inventory), _spec(args))
        tables["daily_trend"] = daily
    if args.sellers:
        tables["reorder_list"] = reorder_list(health, read_sellers(spark, args.sellers))
    for name, rows in tables.items():
        rows.write.parquet(f"{args.output}/{name}")
    health.unpersist()


def train(spark: SparkSession, args: argparse.Namespace) -> None:
    params = ForestParams(trees=args.trees, depth=args.depth)
    run = train_run(
        read_windowed(spark, args.windows), args.models, args.runs, params,
        label_mode=args.label, spec=_spec(args),
    )
    run.show(truncate=False)
    failure = run.first()["error"]
    if failure is not None:
        raise SystemExit(f"training failed: {failure}")


def update(spark: SparkSession, args: argparse.Namespace) -> None:
    """Refused corrections go to ``--rejected``; text in a number column fails the job."""
    changes = (
        spark.read.schema(STOCK_UPDATES).option("header", True).option("mode", "FAILFAST")
        .csv(args.updates)
    )
    if args.rejected:
        rejected_updates(changes).write.parquet(args.rejected)
    if args.inventory == f"versions:{args.output}":
        correct_inventory(spark, args.output, changes)
    else:
        write_inventory(upsert_stock(_stock(spark, args.inventory), changes), args.output)


def compact(spark: SparkSession, args: argparse.Namespace) -> None:
    compact_windowed(
        spark, args.windows, args.output, LAYOUTS[args.layout], partitions=args.partitions
    )


def _within(low: int, high: int) -> Callable[[str], int]:
    """The bounds of a report's size, which the operators themselves don't have."""

    def number(text: str) -> int:
        if not low <= (value := int(text)) <= high:
            raise argparse.ArgumentTypeError(f"must be within {low}..{high}")
        return value

    return number


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser("shelfcast", description="Retail demand and replenishment jobs")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(job, *required: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(job.__name__)
        sub.set_defaults(job=job)
        for name in required:
            sub.add_argument(f"--{name}", required=True)
        return sub

    def spec(sub: argparse.ArgumentParser) -> None:
        for name in ("window", "slide", "watermark"):
            sub.add_argument(f"--{name}", default=getattr(WindowSpec, name))

    for job in (windows, validate):
        sub = command(job, "output", "checkpoint")
        sub.add_argument("--format", default="text", help="text, kafka or socket")
        sub.add_argument("--path")
        sub.add_argument("--option", action="append", default=[], metavar="KEY=VALUE")
        sub.add_argument("--every", help="trigger interval")
        sub.add_argument("--once", action="store_true", help="work off what is there and stop")
        if job is windows:
            spec(sub)
            sub.add_argument("--mode", choices=["append", "update"], default="append")
            sub.add_argument("--layout", choices=[*LAYOUTS], default="date")
            sub.add_argument("--panes", action="store_true", help="chained aggregates, append mode")

    sub = command(decide, "windows", "inventory", "output")
    sub.add_argument("--model")
    spec(sub)

    sub = command(follow, "windows", "inventory", "output", "checkpoint")
    sub.add_argument("--model")
    sub.add_argument("--every", help="trigger interval")
    sub.add_argument("--once", action="store_true", help="work off what is there and stop")
    spec(sub)

    sub = command(reports, "inventory", "output")
    for name in ("windows", "sellers", "models", "runs"):
        sub.add_argument(f"--{name}")
    sub.add_argument("--days", type=_within(*TREND_DAYS), default=7)
    sub.add_argument("--limit", type=_within(1, DEMAND_ROWS_MAX), default=200)
    spec(sub)

    sub = command(train, "windows", "models", "runs")
    sub.add_argument("--label", choices=["proxy", "next_window"], default="proxy")
    sub.add_argument("--trees", type=int, default=ForestParams.trees)
    sub.add_argument("--depth", type=int, default=ForestParams.depth)
    spec(sub)

    sub = command(update, "inventory", "updates", "output")
    sub.add_argument("--rejected", help="where refused corrections and their reasons go")

    sub = command(compact, "windows", "output")
    sub.add_argument("--layout", choices=[*LAYOUTS], default="date")
    sub.add_argument("--partitions", type=int)
    return parser


def main(arguments: Sequence[str] | None = None) -> None:
    args = _parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"shelfcast-{args.command}").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    args.job(spark, args)


if __name__ == "__main__":
    main()
