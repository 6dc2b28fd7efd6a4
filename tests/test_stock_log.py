"""Stock as a base and a log of changes: against a dictionary, files touched, change feeds."""

import os
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from shelfcast.operators.stock import upsert_stock
from shelfcast.schemas import INVENTORY, STOCK_UPDATES
from shelfcast.sinks.stock import (
    append_changes, correct_inventory, delist, fold_inventory, write_inventory,
)
from shelfcast.sources.stock import (
    CHANGES, files_of, inventory_changes, inventory_version, line_of, part_of,
    read_inventory_snapshot, read_inventory_version,
)

T = datetime(2024, 3, 1, tzinfo=timezone.utc)


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def stock_of(spark, number):
    skus = [(f"S{i % 7}", f"P{i}", i, 2 + i % 3) for i in range(number)]
    return spark.createDataFrame(skus, INVENTORY)


def corrections(spark, *changed):
    return spark.createDataFrame([(s, p, n, T) for s, p, n in changed], STOCK_UPDATES)


def written(root):
    return {
        os.path.relpath(os.path.join(folder, name), root)
        for folder, _, names in os.walk(root) for name in names if name.endswith(".parquet")
    }


def test_a_small_correction_writes_and_reads_its_parts_only(spark, path):
    write_inventory(stock_of(spark, 400), path)
    before = written(path)
    skus = [("S1", "P1", 999), ("S2", "P2", 998), ("S9", "P999", 7)]
    changed = corrections(spark, *skus)
    parts = {r[0] for r in changed.select(part_of(16)).collect()}
    correct_inventory(spark, path, changed)
    new = written(path) - before
    assert {f.split("/")[2] for f in new if f.startswith("deltas")} == {f"part={p}" for p in parts}
    assert not [f for f in new if f.startswith("data")] and before <= written(path)
    base, log = files_of(line_of(spark, path, inventory_version(spark, path)))
    assert len(base) == 16 and len(log) == len(parts)
    expected = upsert_stock(stock_of(spark, 400), changed).drop("status")
    assert rows(read_inventory_version(spark, path)) == rows(expected)


def test_a_fold_rewrites_the_parts_that_are_due(spark, path):
    write_inventory(stock_of(spark, 400), path)
    for n in range(3):
        correct_inventory(spark, path, corrections(spark, ("S1", "P1", 500 + n)))
    correct_inventory(spark, path, corrections(spark, ("S2", "P2", 600)))
    version, stocked = inventory_version(spark, path), rows(read_inventory_version(spark, path))
    before = written(path)
    assert fold_inventory(spark, path, after=9) is None
    folded = fold_inventory(spark, path, after=3)
    due = corrections(spark, ("S1", "P1", 0)).select(part_of(16)).first()[0]
    assert {f.rpartition("/")[0] for f in written(path) - before if f.startswith("data")} == {
        f"data/version={folded}/part={due}"
    }
    assert rows(read_inventory_version(spark, path)) == stocked
    assert rows(read_inventory_snapshot(spark, path, version)) == stocked
    _, log = files_of(line_of(spark, path, folded))
    assert len(log) == 1  # the other part's change is still merged


def test_many_versions_against_a_dictionary(spark, path):
    draw = random.Random(2)
    model = {(r[0], r[1]): (r[2], r[3]) for r in rows(stock_of(spark, 60))}
    version = write_inventory(stock_of(spark, 60), path, parts=4)
    seen = {version: dict(model)}
    for step in range(7):
        if step % 3 == 1:
            gone = draw.sample(sorted(model), 3) + [("S0", "nowhere")]
            version = delist(spark.createDataFrame(gone, "store_id string, product_id string"), path, version)
            for sku in gone:
                model.pop(sku, None)
        elif step % 3 == 2:
            version = fold_inventory(spark, path, after=1)
        else:
            changed = [(f"S{i % 7}", f"P{i}", draw.randrange(90)) for i in draw.sample(range(80), 5)]
            version = correct_inventory(spark, path, corrections(spark, *changed))
            for store, product, number in changed:
                model[store, product] = number, model.get((store, product), (0, 3))[1]
        seen[version] = dict(model)
    for version, expected in seen.items():
        got = rows(read_inventory_snapshot(spark, path, version))
        assert got == sorted((*sku, *values) for sku, values in expected.items())
    order = list(seen)
    for a, b in [(0, 1), (0, 4), (2, 5), (1, 7), (3, 3)]:
        old, new = seen[order[a]], seen[order[b]]
        feed = {(r.store_id, r.product_id): r for r in inventory_changes(spark, path, order[a], order[b]).collect()}
        assert set(feed) == {k for k in {*old, *new} if old.get(k) != new.get(k)}
        for sku, row in feed.items():
            assert row.change == ("new" if sku not in old else "delisted" if sku not in new else "changed")
            assert (row.old_current_stock, row.old_lead_time_days) == old.get(sku, (None, None))
            assert (row.current_stock, row.lead_time_days) == new.get(sku, (None, None))


def test_the_feed_of_a_rewritten_snapshot(spark, path):
    first = write_inventory(stock_of(spark, 20), path)
    more = stock_of(spark, 22).filter("product_id <> 'P3'").withColumn(
        "current_stock", F.when(F.col("product_id") == "P5", 77).otherwise(F.col("current_stock"))
    )
    second = write_inventory(more, path, parent=first)
    feed = rows(inventory_changes(spark, path, first, second).select("product_id", "change"))
    assert feed == [("P20", "new"), ("P21", "new"), ("P3", "delisted"), ("P5", "changed")]
    assert inventory_changes(spark, path, second, second).count() == 0


def test_null_stock_and_empty_tables(spark, path):
    first = write_inventory(spark.createDataFrame([("S", "P", None, 2)], INVENTORY), path)
    assert rows(read_inventory_version(spark, path)) == [("S", "P", None, 2)]
    changed = spark.createDataFrame([("S", "P", 4, None, False)], CHANGES)
    second = append_changes(changed, path, first)
    assert [r.change for r in inventory_changes(spark, path, first, second).collect()] == ["changed"]
    third = append_changes(changed.limit(0), path, second)
    assert rows(read_inventory_snapshot(spark, path, third)) == [("S", "P", 4, None)]
    empty = write_inventory(stock_of(spark, 0), path, parent=third)
    assert read_inventory_snapshot(spark, path, empty).count() == 0
    assert [r.change for r in inventory_changes(spark, path, third, empty).collect()] == ["delisted"]


def test_changes_on_an_outdated_version_are_refused(spark, path):
    first = write_inventory(stock_of(spark, 5), path)
    correct_inventory(spark, path, corrections(spark, ("S1", "P1", 3)))
    with pytest.raises(ValueError, match="another snapshot"):
        delist(stock_of(spark, 1), path, first)
    assert read_inventory_version(spark, path).count() == 5


def test_merged_stock_joins_whatever_is_broadcast_at_run_time(spark, path):
    """A join whose small side shows only at run time changes how its rows are dealt."""
    first = write_inventory(stock_of(spark, 400), path)
    skus = [(f"S{i % 7}", f"P{i}", 900 + i) for i in range(0, 400, 50)]
    early = correct_inventory(spark, path, corrections(spark, *skus))
    late = delist(spark.createDataFrame([("S1", "P1"), ("S0", "P0")], "store_id string, product_id string"), path, early)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
        "spark.sql.shuffle.partitions": "5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        fed = [rows(inventory_changes(spark, path, a, b)) for a, b in ((first, early), (first, late))]
        gone = [(r[0], r[1]) for r in rows(inventory_changes(spark, path, early, late))]
        grouped = read_inventory_version(spark, path).groupBy("store_id", "product_id").count()
        assert grouped.filter("count = 1").count() == 398
        again = correct_inventory(spark, path, corrections(spark, ("S2", "P2", 7), ("S0", "P0", 8)))
        assert read_inventory_snapshot(spark, path, again).filter("current_stock IN (7, 8)").count() == 4
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert [r[:3] for r in fed[0]] == sorted((s, p, "changed") for s, p, _ in skus)
    assert {r[:3] for r in fed[1]} == {r[:3] for r in fed[0]} - {("S0", "P0", "changed")} | {
        ("S0", "P0", "delisted"), ("S1", "P1", "delisted")
    }
    assert gone == [("S0", "P0"), ("S1", "P1")]


def test_change_feeds_where_no_side_is_broadcast(spark, path):
    """Joins that all shuffle by SKU share their shuffles; the feed is the difference of the snapshots."""
    versions = [write_inventory(stock_of(spark, 90), path, parts=4)]
    some = [(f"S{i % 7}", f"P{i}", 900 + i) for i in range(0, 100, 4)]
    versions.append(correct_inventory(spark, path, corrections(spark, *some)))
    gone = spark.createDataFrame(some[::3], "store_id string, product_id string, number int")
    versions.append(delist(gone, path, versions[-1]))
    back = [(store, product, 7) for store, product, _ in some[::6]]
    versions.append(correct_inventory(spark, path, corrections(spark, *back, ("S1", "P1", 3))))
    versions.append(fold_inventory(spark, path, after=2))
    odd = [("S2", "P2", 5, 2, None), ("S3", "P3", 6, 2, True), ("S8", "P800", 4, 2, False), (None, "P5", 1, 2, False)]
    versions.append(append_changes(spark.createDataFrame(odd, CHANGES), path, versions[-1]))
    versions.append(write_inventory(stock_of(spark, 80), path, parent=versions[-1]))
    stock = []
    for version in versions:
        known = read_inventory_snapshot(spark, path, version).dropna(subset=["store_id", "product_id"])
        stock.append({r[:2]: r[2:] for r in rows(known)})
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        for a, b in [(0, 1), (0, 2), (0, 5), (1, 3), (2, 3), (2, 4), (3, 4), (4, 5)]:
            expected = []
            for sku in {*stock[a], *stock[b]}:
                old, new = stock[a].get(sku), stock[b].get(sku)
                change = "new" if old is None else "delisted" if new is None else "changed"
                (was, lead), (now, next_lead) = old or (None, None), new or (None, None)
                if old != new:
                    expected.append((*sku, change, was, now, lead, next_lead))
            fed = inventory_changes(spark, path, versions[a], versions[b]).collect()
            assert {tuple(r) for r in fed} == set(expected) and len(fed) == len(expected)
        whole = inventory_changes(spark, path, versions[5], versions[6]).dropna(subset=["store_id"])
        assert whole.count() == sum(stock[5].get(k) != stock[6].get(k) for k in {*stock[5], *stock[6]})
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
