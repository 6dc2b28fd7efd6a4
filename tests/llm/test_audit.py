"""The filter audit against applying every order to every document."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from shelfcast.llm import audit
from shelfcast.llm.queries import op13_filter_interactions
from tests.compare import connect, difference
from shelfcast.llm.queries import ORACLE


def failed(text):
    words = text.encode().split()
    upper = sum("A" <= c <= "Z" for c in text)
    return {
        *("A" * (len(words) < 50)),
        *("B" * (100 * len(set(words)) < 65 * len(words))),
        *("C" * (100 * upper > 5 * len(text))),
        *("D" * any(c in "#$%&*|" for c in text)),
    }


def brute(documents, labels):
    """{(part, order, step): the seven counts} by running each chain of filters."""
    firsts, marks = {}, {}
    for doc_id, text, _ in documents:
        if doc_id is not None:
            firsts[text or ""] = min(doc_id, firsts.get(text or "", doc_id))
    for doc_id, quality, toxic in labels:
        good, bad = marks.get(doc_id, (False, False))
        marks[doc_id] = good or quality == 1, bad or toxic == 1
    parts = {}
    for doc_id, text, source in documents:
        fails = failed(text or "")
        if doc_id is not None and doc_id > firsts[text or ""]:
            fails.add("E")
        parts.setdefault(source or "", []).append((fails, *(marks.get(doc_id, (False, False)) if doc_id is not None else (False, False))))
    found = {}
    for part, rows in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, name in enumerate(order, 1):
                gone = [r for r in left if name in r[0]]
                left = [r for r in left if name not in r[0]]
                shapley[name] += len(gone)
                found[part, "".join(order), step] = [
                    len(left), len(gone), sum(name in r[0] for r in rows) - len(gone),
                    sum(r[0] == {name} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone),
                ]
        for (p, order, step), counts in found.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return {key: tuple(counts) for key, counts in found.items()}


def rows_of(frame):
    return {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in frame.collect()}


@pytest.mark.parametrize("at", [0, 1])
def test_whole_documents(spark, sf_dir, sf01_dir, at):
    path = (sf_dir, sf01_dir)[at]
    assert difference(
        op13_filter_interactions(spark, path), connect(path), ORACLE["op13_filter_interactions"]
    ) is None


def test_brute_force_and_odd_rows(spark):
    draw = random.Random(3)
    some = ["a " * 60, "word", "B C D " * 30, "x # y", " ".join(f"w{i}" for i in range(80)), "", None, "é" * 100]
    documents = [
        (draw.choice([None, *range(40)]), draw.choice(some), draw.choice(["p", "q", None, ""])) for _ in range(150)
    ]
    documents.append((999, "long " * 40000, "q"))
    labels = [(draw.randrange(45), draw.choice([0, 1, None]), draw.choice([0, 1, 2])) for _ in range(60)]
    labels.append((None, 1, 1))
    docs = spark.createDataFrame(documents, "doc_id int, text string, source string")
    docs = docs.withColumns({c: F.lit(0) for c in ("mask", "digest", "part", "good")})
    marks = spark.createDataFrame(labels, "doc_id int, quality int, toxic int").withColumn("good", F.lit(7))
    assert rows_of(audit.audit(docs, marks)) == brute(documents, labels)
    assert rows_of(audit.audit(docs, marks.limit(0))) == brute(documents, [])
    assert audit.audit(docs.limit(0), marks).count() == 0


def test_diagrams_in_all_orders():
    draw = random.Random(1)
    counts = {mask: (draw.randrange(9), draw.randrange(3)) for mask in draw.sample(range(32), 20)}
    diagram, orders = audit.Diagram("ABCDE", counts), set()
    for place in [None, *audit.plain_changes(5)]:
        if place is not None:
            diagram.swap(place)
        orders.add("".join(diagram.order))
        at = 0
        for name, kept, gone in diagram.steps():
            bit = 1 << "ABCDE".index(name)
            for i in range(2):
                assert gone[i] == sum(c[i] for m, c in counts.items() if not m & at and m & bit)
                assert kept[i] == sum(c[i] for m, c in counts.items() if not m & (at | bit))
            at |= bit
        for above, level in zip(diagram.levels, diagram.levels[1:]):
            children = {id(n) for node in above for n in (node.passing, node.failing)}
            assert children == {id(node) for node in level}
    assert len(orders) == 120


def test_equal_nodes_are_one():
    diagram = audit.Diagram("ABCDE", {0: (5,)})
    assert [len(level) for level in diagram.levels] == [1, 2, 2, 2, 2]
