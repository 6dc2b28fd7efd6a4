"""Parsing, validation, quality counts, categories and anomaly rules."""

import json

import pytest
from pyspark.sql import Observation, functions as F

from shelfcast.functions.text import category_of
from shelfcast.operators.events import (
    dead_letters,
    anomaly_shares, event_quality, flag_anomalies, observe_quality, rejected_sales, valid_sales,
    with_category,
)
from shelfcast.operators.windows import window_sales
from shelfcast.sources.events import parse_events, parse_lines, read_event_lines

GOOD = {
    "event_time": "2024-03-01T10:00:30.250+00:00", "store_id": "STORE_001",
    "product_id": "PROD_011", "category": "Snacks", "unit_price": 20.0, "quantity": 2,
    "payment_mode": "UPI", "is_anomaly": False,
}

# name -> (line, reason of rejection, counted by a window)
CASES = {
    "good": (json.dumps(GOOD), None, True),
    "not_json": ("not json", "bad_json", False),
    "cut": (json.dumps(GOOD)[:-8], "bad_json", False),
    "empty": ("", "bad_json", False),
    "no_field": ("{}", "bad_json", False),
    "null_line": (None, "bad_json", False),
    "null_time": (json.dumps(GOOD | {"event_time": None}), "bad_time", False),
    "garbage_time": (json.dumps(GOOD | {"event_time": "garbage"}), "bad_time", False),
    "negative_price": (json.dumps(GOOD | {"unit_price": -1}), "bad_price", False),
    "zero_price": (json.dumps(GOOD | {"unit_price": 0}), "bad_price", False),
    "null_price": (json.dumps(GOOD | {"unit_price": None}), "bad_price", False),
    "text_price": (json.dumps(GOOD | {"unit_price": "7.5"}), "bad_price", False),
    "zero_quantity": (json.dumps(GOOD | {"quantity": 0}), "bad_quantity", False),
    "null_quantity": (json.dumps(GOOD | {"quantity": None}), "bad_quantity", False),
    "half_quantity": (json.dumps(GOOD | {"quantity": 1.5}), "bad_quantity", False),
    "no_product": (json.dumps({k: v for k, v in GOOD.items() if k != "product_id"}), None, True),
}


def lines(spark, *names):
    return spark.createDataFrame([(CASES[n][0],) for n in names], "value string")


def test_good_line_is_typed(spark):
    row = parse_events(lines(spark, "good")).withColumn(
        "event_time", F.unix_micros("event_time")
    ).first()
    assert row.asDict() == GOOD | {"event_time": 1709287230250000}


@pytest.mark.parametrize("name", CASES)
def test_reason(spark, name):
    rows = parse_events(lines(spark, name))
    assert [r.reason for r in rejected_sales(rows).collect()] == ([CASES[name][1]] if CASES[name][1] else [])
    assert window_sales(valid_sales(rows)).count() == (5 if CASES[name][2] else 0)


def test_other_fields_of_a_rejected_row_are_kept(spark):
    row = rejected_sales(parse_events(lines(spark, "half_quantity"))).first()
    assert (row.store_id, row.unit_price, row.quantity) == ("STORE_001", 20.0, None)


def test_without_time_rejected_is_the_complement_of_valid(spark):
    rows = parse_events(lines(spark, *CASES))
    kept = valid_sales(rows).count()
    assert kept + rejected_sales(rows, require_time=False).count() == len(CASES)
    assert kept == 4  # good, no_product and both without a usable time


def test_quality_counts(spark):
    found = event_quality(parse_events(lines(spark, *CASES))).first().asDict()
    assert found == {
        "events": 16, "unreadable": 5, "null_time": 7, "null_store": 5, "null_product": 6,
        "null_price": 7, "nonpositive_price": 2, "null_quantity": 7, "nonpositive_quantity": 1,
        "valid": 4,
    }


def test_observed_counts_equal_the_aggregate(spark):
    rows, seen = parse_events(lines(spark, *CASES)), Observation()
    assert observe_quality(rows, seen).count() == len(CASES)
    assert seen.get == event_quality(rows).first().asDict()


def test_text_files_batch_and_offset(spark, path):
    lines(spark, "good", "cut").write.text(path + "/in")
    rows = read_event_lines(spark, "text", path + "/in", streaming=False)
    assert rows.columns == ["value"] and rows.count() == 2
    shifted = json.dumps(GOOD | {"event_time": "2024-03-01T15:30:30.250+05:30"})
    row = parse_events(spark.createDataFrame([(shifted,)], "value string"))
    assert row.select(F.unix_micros("event_time")).first()[0] == 1709287230250000


@pytest.mark.parametrize(
    "product, expected",
    [
        ("PROD_001", "Rice"), ("PROD_010", "Rice"), ("PROD_011", "Snacks"), ("PROD_030", "Beverages"),
        ("PROD_031", "Dairy"), ("PROD_050", "Personal Care"), ("PROD_051", "General"),
        ("PROD_000", "General"), ("PROD", "General"), (None, "General"),
    ],
)
def test_category(spark, product, expected):
    row = spark.createDataFrame([(product,)], "p string").select(category_of(F.col("p"))).first()
    assert row[0] == expected


def test_anomaly_rules(spark):
    rows = spark.createDataFrame(
        [
            ("S", "PROD_001", 239.99, 1, False), ("S", "PROD_001", 240.0, 1, True),
            ("S", "PROD_001", 50.0, 10, True), ("S", "PROD_001", 50.0, 9, True),
            ("S", "PROD_077", 200.0, 1, False),
        ],
        "store_id string, product_id string, unit_price double, quantity int, is_anomaly boolean",
    )
    flagged = flag_anomalies(rows)
    assert [r.rule_anomaly for r in flagged.collect()] == [False, True, True, False, True]
    shares = {r.product_id: r for r in anomaly_shares(flagged).collect()}
    assert (shares["PROD_001"].anomaly_percent, shares["PROD_001"].agreement_percent) == (50.0, 75.0)
    assert shares["PROD_077"].producer_anomalies == 0
    assert with_category(rows).filter("category = 'Rice'").count() == 4


def test_dead_letters_tell_broken_text_from_empty_objects(spark):
    lines = spark.createDataFrame(
        [
            (1, "{}"), (2, ""), (3, None), (4, '{"store_id": "S"'), (5, "[1]"), (6, '{"quantity": "x"}'),
            (7, '{"event_time": "2024-03-01T10:00:00Z", "unit_price": 2.5, "quantity": 1}'),
            (8, '{"unit_price": 2.5, "quantity": 1}'), (9, '{"event_time": "2024-03-01T10:00:00Z", "quantity": 1}'),
            (10, '{"event_time": "2024-03-01T10:00:00Z", "unit_price": NaN, "quantity": 1}'),
        ],
        "offset int, value string",
    )
    parsed = parse_lines(lines)
    got = {r.offset: r.reason for r in dead_letters(parsed).collect()}
    assert got[1] == got[2] == got[3] == "no_fields"
    assert got[4] == "bad_json" and got[6] == "bad_field" and 7 not in got
    assert (got[8], got[9], got[10]) == ("bad_time", "bad_price", "bad_price")
    assert {r.offset: r.line for r in parsed.collect()} == {r.offset: r.value for r in lines.collect()}
