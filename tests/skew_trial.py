"""Times jobs on multiplied sales with one hot SKU.

    python -m tests.skew_trial SF_DIR WORK_DIR [COPIES]

``lineitem`` is written COPIES (100) times, a third of all rows moved to one SKU and the
times spread over the day, to WORK_DIR/sales; each job runs whole into the ``noop`` sink.
The balance of tasks is in the event log (``spark.eventLog.enabled``).
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import functions as F

from shelfcast.config import WindowSpec
from shelfcast.operators import trends
from shelfcast.operators.events import valid_sales
from shelfcast.operators.windows import latest_window, next_window_label, window_sales
from shelfcast.plans.health import sku_health
from shelfcast.suite import fixtures as fx
from tests.compare import session

DAY = WindowSpec.tumbling("1 day")


def main(sf_dir: str, work: str, copies: int = 100) -> None:
    spark = session("64")
    hot = F.col("copy") % 3 == 0
    rows = fx.sales_li(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    rows = rows.withColumns(
        {
            "event_time": F.timestamp_seconds(
                F.unix_seconds("event_time") + F.pmod(F.xxhash64("copy", "product_id"), F.lit(86400))
            ),
            **{name: F.when(hot, F.lit(value)).otherwise(F.col(name))
               for name, value in (("store_id", "STORE_001"), ("product_id", "PROD_001"))},
        }
    )
    rows.drop("copy").repartition(48).write.parquet(f"{work}/sales")
    sales = valid_sales(spark.read.parquet(f"{work}/sales"))
    stock, days = fx.inventory_li(spark, sf_dir), window_sales(sales, DAY)
    jobs = {
        "windows 1 d": days,
        "windows 35 d / 7 d": window_sales(sales, WindowSpec("35 days", "7 days")),
        "sku health": sku_health(stock, days, spec=DAY),
        "daily trend": trends.daily_trend(days, stock, DAY),
        "latest window": latest_window(days),
        "next-window label": next_window_label(days, DAY),
    }
    for name, frame in jobs.items():
        began = time.perf_counter()
        frame.write.format("noop").mode("overwrite").save()
        print(f"{name:20s} {time.perf_counter() - began:7.1f} s", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], *map(int, sys.argv[3:]))
