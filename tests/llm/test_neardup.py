"""Near-duplicates against brute force on whole tables, and the odd cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import groups, neardup
from shelfcast.llm.groups import components_of


def shingles(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    n = min(n, len(words))
    return {(n, *words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n, percent):
    """{doc_id: smallest doc_id reachable}."""
    sets = [(doc_id, shingles(text, n)) for doc_id, text in rows if doc_id is not None]
    leader = {doc_id: doc_id for doc_id, _ in sets}

    def find(x):
        while leader[x] != x:
            x = leader[x]
        return x

    for i, (a, left) in enumerate(sets):
        for b, right in sets[i + 1 :]:
            if 100 * min(len(left), len(right)) < percent * max(len(left), len(right)):
                continue  # too different in size
            both = len(left & right)
            if both and 100 * both >= percent * (len(left) + len(right) - both):
                x, y = find(a), find(b)
                leader[max(x, y)] = min(x, y)
    return {doc_id: find(doc_id) for doc_id, _ in sets}


def check(frame, rows, n, percent=80):
    got = frame.collect()
    assert len(got) == len(rows)
    want = brute(rows, n, percent)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(doc_id, []).append(len(shingles(text, n)))
    assert all(r.n_shingles in texts[r.doc_id] for r in got)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("n", [2, 5])
def test_whole_documents(spark, sf01_dir, n):
    documents = spark.read.parquet(f"{sf01_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    check(neardup.near_duplicates(documents, n), rows, n)


def test_crowded_buckets_keep_every_link(spark):
    """Many independent edits of one text: links only reach some of them through others."""
    draw = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for doc_id in range(160):
        words = list(base)
        for _ in range(draw.randrange(0, 14)):
            words[draw.randrange(len(words))] = f"x{draw.randrange(40)}"
        rows.append((doc_id, " ".join(words[: draw.randrange(100, 121)])))
    check(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string"), 2), rows, 2)


def test_clusters_far_from_a_centre_are_not_confirmed_pair_by_pair(spark, monkeypatch):
    """Eight clusters of 50 meet in one group: most of them are far from its centre."""
    draw = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    bases = [base]
    for cluster in range(1, 8):
        far = {k: f"c{cluster}_{k}" for k in draw.sample(range(150), 16)}
        bases.append([far.get(i, word) for i, word in enumerate(base)])
    rows = []
    for doc_id in range(400):
        words = list(bases[doc_id % 8])
        for _ in range(draw.randrange(4)):
            words[draw.randrange(150)] = f"e{draw.randrange(10**6)}"
        rows.append((doc_id, " ".join(words)))
    met, confirmed = [], groups.confirmed

    def counted(pairs, sets, percent):
        met.append(pairs.count())
        return confirmed(pairs, sets, percent)

    monkeypatch.setattr(groups, "confirmed", counted)
    check(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string"), 2), rows, 2)
    assert sum(met) < 2 * len(rows)


def test_parities_differ_no_more_than_sets():
    draw = np.random.RandomState(4)
    for _ in range(50):
        left, right = (np.unique(draw.randint(0, 400, draw.randint(0, 300))) for _ in "ab")
        left, right = (s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for s in (left, right))
        odd = groups.parity(left) ^ groups.parity(right)
        places = sum(int(word).bit_count() for word in odd.view(np.uint64))
        assert places <= len(np.setxor1d(left, right)) and len(odd) == groups.PARITIES // 64


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "a b c d"), (6, "a b c d"),
        (7, "A B\nC  D"), (8, long), (9, long + " more"), (10, "é b"), (11, "É b"), (None, "a b c d"),
        (None, None),
    ]
    frame = spark.createDataFrame(rows, "doc_id int, text string")
    frame = frame.withColumns({c: F.lit(0) for c in ("node", "key", "size", "kept", "hashes")})
    check(neardup.near_duplicates(frame, 2), rows, 2)
    kept = neardup.drop_near_duplicates(frame, 2)
    assert kept.columns == frame.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 2, 3, 4, 6, 6, 8, 10, 11, None, None]
    assert neardup.near_duplicates(frame.limit(0), 2).count() == 0
    assert neardup.drop_near_duplicates(frame.limit(0), 2).count() == 0


def test_signatures_within_the_guarantee_share_a_key(spark):
    draw = np.random.RandomState(3)
    rows = []
    for pair in range(60):
        left = draw.randint(0, 65536, neardup.SYMBOLS)
        right = left.copy()
        wrong = draw.choice(neardup.SYMBOLS, neardup.GUARANTEED, replace=False)
        right[wrong] = (right[wrong] + 1 + draw.randint(0, 60000, len(wrong))) % 65536
        rows += [(pair, bytearray(s.astype(">u2").tobytes())) for s in (left, right)]
    frame = spark.createDataFrame(rows, "pair int, sig binary")
    keys = frame.select("pair", F.explode(neardup._chunk_keys("sig")).alias("key"))
    shared = keys.groupBy("pair", "key").count().where("count > 1")
    assert shared.select("pair").distinct().count() == 60


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 60), (51, 60)], "a long, b long")
    got = {r.node: r.component for r in components_of(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 51: 50, 60: 50}
