"""Streams over replayable files: equal to the batch, late rows, restarts."""

import json
import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from shelfcast import WindowSpec
from shelfcast.operators.events import observe_quality, valid_sales
from shelfcast.operators.windows import window_sales
from shelfcast.plans.decisions import decision_table
from shelfcast.constants import SKU, WINDOW
from shelfcast.schemas import INVENTORY, SALES_EVENT, WINDOWED
from shelfcast.sinks.stock import append_changes, delist, write_inventory
from shelfcast.sources.stock import CHANGES
from shelfcast.sources.events import parse_events, read_event_lines
from shelfcast.sources.tables import read_windowed, stream_windowed
from shelfcast.streaming import jobs
from shelfcast.streaming.live import live_writer, read_live
from shelfcast.streaming.state import open_windows, state_operators
from shelfcast.streaming.progress import QUALITY, ProgressLog, late_report, read_progress

SPEC = WindowSpec()
BASE = datetime(2024, 3, 1, 10, tzinfo=timezone.utc)


def event(minute, quantity=1, product="PROD_001", price=2.5):
    return {
        "event_time": (BASE + timedelta(minutes=minute)).isoformat(), "store_id": "STORE_001",
        "product_id": product, "category": "Rice", "unit_price": price, "quantity": quantity,
        "payment_mode": "UPI", "is_anomaly": False,
    }


class Feed:
    """A folder of JSON files that a stream reads one per micro-batch."""

    def __init__(self, folder):
        self.folder, self.lines = folder, []
        os.makedirs(folder)

    def add(self, *events):
        number = len(os.listdir(self.folder))
        name = f"{self.folder}/{number:03d}.json"
        text = [json.dumps(e) if isinstance(e, dict) else e for e in events]
        with open(name, "w") as out:
            out.write("\n".join(text) + "\n")
        os.utime(name, (1_700_000_000 + number,) * 2)
        self.lines += text

    def stream(self, spark):
        return valid_sales(parse_events(read_event_lines(spark, "text", self.folder, maxFilesPerTrigger="1")))

    def batch(self, spark):
        return valid_sales(parse_events(spark.createDataFrame([(t,) for t in self.lines], "value string")))


@pytest.fixture
def feed(path):
    return Feed(path + "/in")


def finish(query):
    query.awaitTermination()
    return query


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_append_equals_batch_on_closed_windows(spark, feed, path):
    for minute in range(0, 40, 4):
        feed.add(event(minute, 1), event(minute + 1, 2, "PROD_002"), "not json", event(minute, 0))
    finish(jobs.start_windowed(feed.stream(spark), path + "/out", path + "/state", every=None))
    closed = BASE + timedelta(minutes=37 - 10)
    expected = window_sales(feed.batch(spark)).filter(F.col("window_end") <= closed)
    assert expected.count() > 20
    assert same(read_windowed(spark, path + "/out"), expected)  # the open tail is not written


def test_chained_panes_equal_the_direct_form_with_less_state(spark, feed, path):
    for minute in range(8):
        feed.add(*[event(minute + s / 20, 1 + s % 3, f"PROD_{s % 2:03d}") for s in range(20)])
    feed.add(event(2000))
    updates = []
    for panes in (False, True):
        out = f"{path}/{panes}"
        query = finish(jobs.start_windowed(feed.stream(spark), out + "/out", out + "/state", every=None, panes=panes))
        expected = window_sales(feed.batch(spark)).filter("window_start < '2024-03-01 20:00'")
        assert same(read_windowed(spark, out + "/out"), expected)
        updates.append([sum(p.stateOperators[-1].numRowsUpdated for p in query.recentProgress),
                        sum(p.stateOperators[0].numRowsUpdated for p in query.recentProgress)])
    # The operator that takes in events: a state row per (window, SKU) against one per pane.
    assert updates[0][0] == 8 * 2 * 5 + 5 and min(updates[1]) == 8 * 2 + 1


def test_panes_need_the_append_mode(spark, feed, path):
    feed.add(event(0))
    with pytest.raises(ValueError, match="append"):
        jobs.start_windowed(feed.stream(spark), path + "/o", path + "/s", mode="update", panes=True)


def test_restart_goes_on_where_it_stopped(spark, feed, path):
    feed.add(event(0), event(3))
    finish(jobs.start_windowed(feed.stream(spark), path + "/out", path + "/state", every=None))
    first = read_windowed(spark, path + "/out").count()
    feed.add(event(4, 5))
    feed.add(event(2000))  # closes everything before it
    finish(jobs.start_windowed(feed.stream(spark), path + "/out", path + "/state", every=None))
    expected = window_sales(feed.batch(spark)).filter("window_start < '2024-03-01 12:00'")
    assert first == 0 and same(read_windowed(spark, path + "/out"), expected)


def test_state_of_a_checkpoint(spark, feed, path):
    """What is open before a restart is in the state, and still there after it."""
    for minute in (0, 3, 20):
        feed.add(event(minute), event(minute, 2, "PROD_002"))
    finish(jobs.start_windowed(feed.stream(spark), path + "/out", path + "/state", every=None))
    keys = [*WINDOW, *SKU]

    def open_and_written():
        return open_windows(spark, path + "/state").unionByName(read_windowed(spark, path + "/out").select(keys))

    assert same(open_and_written(), window_sales(feed.batch(spark)).select(keys))
    before = open_windows(spark, path + "/state").collect()
    last = state_operators(spark, path + "/state").first()
    assert last.operatorName.startswith("stateStoreSave") and last.numPartitions == 4
    feed.add(event(40))
    finish(jobs.start_windowed(feed.stream(spark), path + "/out", path + "/state", every=None))
    assert same(open_and_written(), window_sales(feed.batch(spark)).select(keys))
    again = open_windows(spark, path + "/state", last.maxBatchId).collect()
    assert sorted(again) == sorted(before) and len(before) > 0


def dropped(query):
    return sum(
        s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators
    )


def test_late_rows(spark, feed, path):
    feed.add(event(0))
    feed.add(event(60))           # the watermark becomes minute 50 for what is closed,
    feed.add(event(35, 7))        # but rows are dropped by the one before: still counted
    feed.add(event(55, 3))        # late within the watermark
    feed.add(event(36, 9))        # now behind the watermark: dropped
    feed.add(event(2000))
    query = finish(jobs.start_windowed(feed.stream(spark), path + "/out", path + "/state", every=None))
    units = [r.total_units_sold for r in read_windowed(spark, path + "/out").collect()]
    assert sorted(units) == [1] * 10 + [3] * 5 + [7] * 5
    assert dropped(query) == 5  # the five windows of the one dropped row


def test_live_table_folds_its_tail(spark, path):
    """Two snapshots and a short tail, whatever number of batches; a replayed fold is the same."""
    part = F.date_format("window_start", "yyyy-MM-dd")
    step = live_writer(path, WINDOWED, (*WINDOW, *SKU), part, 3)

    def batch(n):
        rows = [
            (BASE + timedelta(days=d), BASE + timedelta(days=d, minutes=5), "S", f"P{p}", n, 1.0, 1.0, 1)
            for d, p in ((n // 4, 0), (n // 4, n), (0, 99))
        ]
        return spark.createDataFrame(rows, WINDOWED)

    expected = {}
    for n in range(13):
        step(batch(n), n)
        expected |= {(r.window_start, r.product_id): r.total_units_sold for r in batch(n).collect()}
        if n in (5, 12):
            step(batch(n), n)  # a replay, once with a fold
        got = {
            (r.window_start, r.product_id): r.total_units_sold
            for r in read_live(spark, path, WINDOWED, (*WINDOW, *SKU)).collect()
        }
        assert got == expected
        assert len(os.listdir(f"{path}/tail")) <= 7  # two folds' worth, and Spark's marker
    folds = [f for f in os.listdir(f"{path}/snapshots") if os.path.isdir(f"{path}/snapshots/{f}/part=2024-03-01")]
    assert len(folds) <= 2


def test_a_foreign_checkpoint_is_refused(spark, feed, path):
    feed.add(event(0))
    args = {"mode": "update", "every": None}
    finish(jobs.start_windowed(feed.stream(spark), path + "/out", path + "/state", **args))
    feed.add(event(1))
    finish(jobs.start_windowed(feed.stream(spark), path + "/out", path + "/state", **args))
    with pytest.raises(ValueError, match="another checkpoint"):
        jobs.start_windowed(feed.stream(spark), path + "/out", path + "/state2", **args)
    assert same(jobs.read_live_windows(spark, path + "/out"), window_sales(feed.batch(spark)))


def test_absurd_prices_do_not_stop_a_stream(spark, feed, path):
    feed.add(event(0, 1, "PROD_001", 1e16), event(1, 1, "PROD_001", 1e16), event(2, 1, "PROD_002", 1e300))
    finish(jobs.start_windowed(feed.stream(spark), path + "/out", path + "/state", mode="update", every=None))
    rows = jobs.read_live_windows(spark, path + "/out").collect()
    assert max(r.total_revenue for r in rows) == 2e16 and {r.product_id for r in rows} == {"PROD_001"}


def test_update_mode_shows_open_windows_and_survives_replay(spark, feed, path):
    for minute in range(0, 12, 2):
        feed.add(event(minute), event(minute, 4, "PROD_002"))
    finish(jobs.start_windowed(feed.stream(spark), path + "/out", path + "/state", mode="update", every=None))
    assert same(jobs.read_live_windows(spark, path + "/out"), window_sales(feed.batch(spark)))
    # a replayed batch overwrites its own directory
    tail = sorted(os.listdir(path + "/out/tail"))[-1]
    last = spark.read.schema(WINDOWED).parquet(f"{path}/out/tail/{tail}").collect()
    step = live_writer(path + "/out", WINDOWED, (*WINDOW, *SKU), F.date_format("window_start", "yyyy-MM-dd"))
    step(spark.createDataFrame(last, WINDOWED), int(tail.partition("=")[2]))
    assert same(jobs.read_live_windows(spark, path + "/out"), window_sales(feed.batch(spark)))


def test_unknown_mode(spark, feed, path):
    feed.add(event(0))
    with pytest.raises(ValueError):
        jobs.start_windowed(feed.stream(spark), path + "/out", path + "/state", mode="complete")


def test_validated_stream(spark, feed, path):
    feed.add(event(0), "not json", event(1, 0), event(2, price=-1), event(3) | {"event_time": "garbage"})
    lines = read_event_lines(spark, "text", path + "/in")
    finish(jobs.start_validated(lines, path + "/out", path + "/state", every=None))
    rows = spark.read.parquet(path + "/out")
    assert rows.columns == SALES_EVENT.fieldNames()
    assert rows.count() == 2 and rows.filter("event_time IS NULL").count() == 1


STOCK = [
    ("STORE_001", "PROD_001", 4000, 3), ("STORE_001", "PROD_002", 10, 3), ("STORE_001", "PROD_003", 1, 3),
]


def run_decisions(spark, feed, path):
    """Windows of what is there, then decisions, one stored file per batch."""
    finish(jobs.start_windowed(feed.stream(spark), path + "/w", path + "/ws", every=None))
    windows = stream_windowed(spark, path + "/w", maxFilesPerTrigger="1")
    stock = spark.createDataFrame(STOCK, INVENTORY)
    return finish(jobs.start_decisions(windows, stock, path + "/out", path + "/state", every=None))


def test_decisions_follow_the_highest_window_of_all_batches(spark, feed, path):
    feed.add(event(0, 9), event(0, 1, "PROD_002"))
    feed.add(event(30, 2))
    feed.add(event(60, 1, "PROD_002"))
    run_decisions(spark, feed, path)
    stock = spark.createDataFrame(STOCK, INVENTORY)
    expected = decision_table(stock, read_windowed(spark, path + "/w"), None)
    assert expected.count() == 2
    assert same(jobs.read_decisions(spark, path + "/out"), expected)


def test_decisions_restart_with_their_state(spark, feed, path):
    feed.add(event(0, 9))
    feed.add(event(100))
    run_decisions(spark, feed, path)
    before = jobs.read_decisions(spark, path + "/out").first()
    feed.add(event(130, 2))
    feed.add(event(2000, 1, "PROD_002"))
    query = run_decisions(spark, feed, path)
    after = jobs.read_decisions(spark, path + "/out").first()
    assert before.predicted_daily_demand == 9 * 288  # and not the 2 units of the later windows
    assert after == before and query.lastProgress.stateOperators[0].numRowsTotal == 1


def follow(spark, feed, path):
    finish(jobs.start_windowed(feed.stream(spark), path + "/w", path + "/ws", every=None))
    windows = stream_windowed(spark, path + "/w", maxFilesPerTrigger="1")
    return finish(jobs.start_decisions(windows, path + "/stock", path + "/out", path + "/state", every=None, fold_every=2))


def decided(spark, path):
    return {r.product_id: (r.current_stock, r.predicted_daily_demand) for r in jobs.read_decisions(spark, path + "/out").collect()}


def test_listed_after_their_sales_and_delisted(spark, feed, path):
    version = write_inventory(spark.createDataFrame(STOCK[:1], INVENTORY), path + "/stock")
    feed.add(event(0, 9), event(0, 2, "PROD_002"), event(0, 4, "PROD_004"))
    feed.add(event(100))
    follow(spark, feed, path)
    assert decided(spark, path) == {"PROD_001": (4000, 9 * 288)}
    listed = spark.createDataFrame([("STORE_001", "PROD_002", 10, 3, False)], CHANGES)
    version = append_changes(listed, path + "/stock", version)
    feed.add(event(200))  # closes windows of PROD_001 only
    follow(spark, feed, path)
    assert decided(spark, path) == {"PROD_001": (4000, 9 * 288), "PROD_002": (10, 2 * 288)}
    gone = spark.createDataFrame(STOCK[:1], INVENTORY)
    delist(gone, path + "/stock", version)
    feed.add(event(300))
    follow(spark, feed, path)
    assert decided(spark, path) == {"PROD_002": (10, 2 * 288)}
    feed.add(event(400, 1, "PROD_002"))  # the state stays right when the stock does not change
    follow(spark, feed, path)
    assert decided(spark, path) == {"PROD_002": (10, 2 * 288)}


@pytest.mark.parametrize("fails_in", ["remember", "decide", "commit"])
def test_a_replayed_batch_decides_the_same(spark, feed, path, monkeypatch, fails_in):
    """The batch that meets new stock fails between its writes, and runs again."""
    version = write_inventory(spark.createDataFrame(STOCK[:2], INVENTORY), path + "/stock")
    feed.add(event(0, 9), event(0, 2, "PROD_002"), event(0, 4, "PROD_003"))
    feed.add(event(100))
    follow(spark, feed, path)
    changed = [("STORE_001", "PROD_002", 70, 3, False), ("STORE_001", "PROD_003", 1, 3, False)]
    append_changes(spark.createDataFrame(changed, CHANGES), path + "/stock", version)
    feed.add(event(200))
    broken = {"done": 0}
    writer = jobs.live_writer

    def failing(where, *args, **kwargs):
        step = writer(where, *args, **kwargs)
        mine = "remember" if where.endswith("features") else "decide"

        def write(batch, batch_id):
            step(batch, batch_id)
            if batch_id and mine == fails_in and not broken["done"]:
                broken["done"] = 1
                raise RuntimeError("lost")

        return write

    if fails_in == "commit":
        created = type(spark).createDataFrame

        def create(self, data, *args, **kwargs):
            if args[:1] == ("version string",) and not broken["done"] and decided(spark, path).get("PROD_003"):
                broken["done"] = 1
                raise RuntimeError("lost")
            return created(self, data, *args, **kwargs)

        monkeypatch.setattr(type(spark), "createDataFrame", create)
    monkeypatch.setattr(jobs, "live_writer", failing)
    with pytest.raises(Exception, match="lost"):
        follow(spark, feed, path)
    monkeypatch.undo()
    assert broken["done"]
    follow(spark, feed, path)
    assert decided(spark, path) == {"PROD_001": (4000, 9 * 288), "PROD_002": (70, 2 * 288), "PROD_003": (1, 4 * 288)}


def test_a_fold_writes_files_by_rows(spark, path):
    """A date of 900 rows in files of at most a few hundred, each from a task of its own."""
    part = F.date_format("window_start", "yyyy-MM-dd")
    step = live_writer(path, WINDOWED, (*WINDOW, *SKU), part, 1, file_rows=100)
    rows = [(BASE + timedelta(days=p % 10 // 9), BASE, "S", f"P{p}", p, 1.0, 1.0, 1) for p in range(1000)]
    step(spark.createDataFrame(rows, WINDOWED), 0)
    days = sorted(d for d in os.listdir(f"{path}/snapshots/upto=0") if d.startswith("part="))
    files = [[f for f in os.listdir(f"{path}/snapshots/upto=0/{d}") if f.endswith(".parquet")] for d in days]
    assert [len(f) for f in files] == [9, 1]
    assert len({f.split("-")[1] for names in files for f in names}) == 10  # one file a task
    assert read_live(spark, path, WINDOWED, (*WINDOW, *SKU)).count() == 1000


def test_state_before_a_batch(spark, path):
    part = F.lit("0")
    step = live_writer(path, WINDOWED, (*WINDOW, *SKU), part, 2)
    for n in range(5):
        step(spark.createDataFrame([(BASE, BASE, "S", "P", n, 1.0, 1.0, 1)], WINDOWED), n)
        for before in range(max(1, n - 1), n + 2):  # a replay reads what the batch before had left
            got = read_live(spark, path, WINDOWED, (*WINDOW, *SKU), before).collect()
            assert [r.total_units_sold for r in got] == [before - 1]


def test_decisions_with_the_rocksdb_state_store(spark, feed, path):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        feed.add(event(0, 9), event(1, 2, "PROD_002"))
        feed.add(event(100))
        run_decisions(spark, feed, path)
    finally:
        spark.conf.unset(key)
    assert jobs.read_decisions(spark, path + "/out").count() == 2


def test_quality_counts_of_each_micro_batch(spark, feed, path):
    feed.add(event(0), "not json")
    feed.add(event(1, 0))
    rows = observe_quality(parse_events(read_event_lines(spark, "text", path + "/in", maxFilesPerTrigger="1")), "quality")
    query = finish(jobs._start(valid_sales(rows), path + "/out", path + "/state", None))
    seen = [p.observedMetrics["quality"] for p in query.recentProgress if p.numInputRows]
    assert [(s.events, s.unreadable, s.nonpositive_quantity, s.valid) for s in seen] == [(2, 1, 0, 1), (1, 0, 1, 0)]


def test_progress_is_logged_batch_by_batch(spark, feed, path):
    feed.add(event(0), "not json")
    feed.add(event(60))
    feed.add(event(61))
    feed.add(event(36, 9), event(37, 9))  # behind the watermark
    parsed = observe_quality(parse_events(read_event_lines(spark, "text", path + "/in", maxFilesPerTrigger="1")), QUALITY)
    log = ProgressLog(spark, path + "/progress")
    spark.streams.addListener(log)
    try:
        query = finish(jobs.start_windowed(valid_sales(parsed), path + "/out", path + "/state", every=None))
        assert log.finished(query)
    finally:
        spark.streams.removeListener(log)
    report = {r.batch_id: (r.rows_in, r.valid, r.late) for r in late_report(read_progress(spark, path + "/progress")).collect()}
    assert report == {0: (2, 1, 0), 1: (1, 1, 0), 2: (1, 1, 0), 3: (2, 2, 6)}  # six windows hold them
    whole = read_progress(spark, path + "/progress")
    assert whole.filter("query_id IS NOT NULL AND state_rows >= 0").count() == whole.count() >= 4
    again = whole.filter("batch_id = 2").withColumn("reported_at", F.lit("9999")).withColumn("late", F.lit(1).cast("long"))
    again.write.mode("append").parquet(path + "/progress")  # the batch ran again
    assert read_progress(spark, path + "/progress").filter("batch_id = 2").first().late == 1


def test_progress_of_nothing(spark, path):
    assert read_progress(spark, path + "/none").count() == 0


def test_dead_letters_keep_their_lines(spark, feed, path):
    feed.add(event(0), "not json", "{}", '{"unit_price": "5"}', event(1, 0))
    lines = read_event_lines(spark, "text", path + "/in", keep=("_metadata.file_name AS file",))
    finish(jobs.start_dead_letters(lines, path + "/out", path + "/state", every=None))
    got = {r.line: (r.reason, r.file) for r in spark.read.parquet(path + "/out").collect()}
    assert got == {
        "not json": ("bad_json", "000.json"), "{}": ("no_fields", "000.json"),
        '{"unit_price": "5"}': ("bad_field", "000.json"), feed.lines[4]: ("bad_quantity", "000.json"),
    }


def test_console_sink_runs(spark, feed):
    feed.add(event(0))
    query = finish(jobs.start_console(feed.stream(spark), every=None))
    assert query.exception() is None
