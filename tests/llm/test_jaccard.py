"""The n-gram join against brute force, its index against the pigeonhole guarantee."""

import random
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import groups, jaccard
from shelfcast.llm.neardup import shingle_hashes
from tests.llm.test_neardup import brute, shingles


def check(frame, rows, n, percent):
    got = frame.collect()
    assert len(got) == len(rows)
    want = brute(rows, n, percent)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    sizes = {}
    for doc_id, text in rows:
        sizes.setdefault(doc_id, []).append(len(shingles(text, n)))
    assert all(r.n_shingles in sizes[r.doc_id] for r in got)
    assert all(r.component_id is None for r in got if r.doc_id is None)


@pytest.mark.parametrize("n, percent", [(4, 85), (2, 70)])
def test_whole_documents(spark, sf01_dir, n, percent):
    documents = spark.read.parquet(f"{sf01_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    check(jaccard.ngram_join(documents, n, percent), rows, n, percent)


@pytest.mark.parametrize("seed", [1, 2])
def test_many_edits_of_one_text(spark, seed):
    """A crowd in which links only reach some documents through others."""
    draw = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for doc_id in range(160):
        words = list(base)
        for _ in range(draw.randrange(0, 12)):
            words[draw.randrange(len(words))] = f"x{draw.randrange(20)}"
        rows.append((doc_id, " ".join(words[: draw.randrange(100, 121)])))
    frame = spark.createDataFrame(rows, "doc_id int, text string")
    check(jaccard.ngram_join(frame, 2, 85), rows, 2, 85)


def test_linked_sets_share_a_key():
    """All sizes and differences that a link allows, also where segments are nearly empty."""
    draw = np.random.RandomState(5)
    checked = 0
    for percent in (60, 85, 95):
        for _ in range(1500):
            size = draw.choice([6, 7, 9, 12, 15, 30, 80, 300])
            pool = draw.randint(0, 1 << 62, 2 * size + 2, dtype=np.int64).astype(np.uint64)
            if draw.rand() < 0.5:  # all in few segments
                pool &= np.uint64(0xFFFFFF | (draw.randint(1, 4) << 24) | (0xFFFF << 46))
            left = np.unique(pool[:size])
            out = draw.randint(0, max(1, len(left) // 4) + 1)
            more = draw.randint(0, max(1, len(left) // 4) + 1)
            right = np.unique(np.concatenate([left[out:], pool[size : size + more]]))
            both = len(np.intersect1d(left, right))
            same = out == more == 0
            if same or 100 * both < percent * (len(left) + len(right) - both):
                continue
            checked += 1
            shared = np.intersect1d(jaccard.index_keys(left, percent), jaccard.index_keys(right, percent))
            assert len(shared), (percent, len(left), len(right), both)
    assert checked > 300


def test_differences_that_may_link_meet(spark):
    """Members of a group that a centre doesn't link: all linked pairs are found."""
    draw = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    edits = [[f"e{e}_{i}" for i in range(8)] for e in range(12)]
    rows = []
    for doc_id in range(90):
        words = list(base)
        for edit in draw.sample(edits, draw.randrange(0, 4)):
            at = draw.randrange(len(words))
            words[at:at] = edit
        rows.append((doc_id, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id int, text string")
    keyed = frame.select(F.lit(1).cast("long").alias("key"), F.col("doc_id").cast("long").alias("node"))
    found = groups.linked_components(keyed, frame, lambda t: jaccard.shingle_hashes(t, 3), 80)
    got = {r.node: r.component for r in found.collect()}
    want = brute(rows, 3, 80)
    assert {i: got.get(i, i) for i in want} == want


def test_elements_of_one_member_are_not_shuffled_to_meet(spark, monkeypatch):
    """Only elements that two members share go to the join, and each is found: links are
    those of brute force, in a group of several parts."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for doc_id in range(3 * 40):
        last = [f"last{doc_id}"] * (doc_id % 3 == 2)  # linked with the document before
        own = [f"own{doc_id - len(last)}_{i}" for i in range(20)]
        rows.append((doc_id, " ".join(base + own + last)))
    kept, settled = {}, groups.settled
    monkeypatch.setattr(groups, "settled", lambda f, n: kept.setdefault((n, len(kept)), settled(f, n)))
    frame = spark.createDataFrame(rows, "doc_id int, text string")
    keyed = frame.select(F.lit(1).cast("long").alias("key"), F.col("doc_id").cast("long").alias("node"))
    found = groups.linked_components(keyed, frame, partial(shingle_hashes, n=1), 85)
    got = {r.node: r.component for r in found.collect()}
    want = brute(rows, 1, 85)
    assert len(set(want.values())) == 80
    assert {i: got.get(i, i) for i in want} == want
    meeting = [f for (name, _), f in kept.items() if name == "parted"]
    for parted in meeting:
        column = next(c for c in ("shared", "first") if c in parted.columns)
        element = F.explode(f"{column}.element" if column == "shared" else column).alias("element")
        times = parted.select("centre", "node", element).groupBy("centre", "element")
        assert times.agg(F.countDistinct("node").alias("n")).where("n < 2").isEmpty()
    assert len(meeting) == 2 and meeting[0].select("node").distinct().count() in (78, 80)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "a b c d"), (6, "a b c d"),
        (7, "A B\nC  D"), (8, long), (9, long + " more"), (10, "é b"), (11, "É b"), (None, "a b c d"),
        (None, None), (12, "a b c"), (13, "a b c"),
    ]
    frame = spark.createDataFrame(rows, "doc_id int, text string")
    frame = frame.withColumns({c: F.lit(0) for c in ("node", "key", "size", "centre", "hashes")})
    check(jaccard.ngram_join(frame, 4, 85), rows, 4, 85)
    assert jaccard.ngram_join(frame.limit(0), 4, 85).count() == 0
