"""What each filter removes in each order of a chain of filters, from decision diagrams.

Every document has a mask of the filters that it fails. Spark counts documents (all, good,
toxic) for each part and mask; the counts of a part, at most 2 ** filters rows, become one
decision diagram with a filter on each level and counts on the nodes. Following the branch
"passes" from the root meets the documents that are still there; the branch "fails" of a
node holds those that its filter removes. All orders are visited by swapping two adjacent
levels at a time, which rebuilds these two levels only.

The filters: A under 50 words; B under 65 % distinct words; C over 5 % ASCII capitals;
D a character of ``#$%&*|``; E the text of a document with a smaller id.

Copies are found by a digest: the first id of a digest is a minimum that Spark combines on
the map side, and only rows that are their digest's first are joined back (by digest and
id), so a text with a third of all rows is no hot key. What isn't first is a copy.

Defined results: a null text is an empty one, and equal to it; a null part is an empty
string. A document without an id is never a copy and makes no other one a copy; rows that
repeat an id and text are all first. A document is good or toxic if any of its labels says
so. Empty documents give no rows. Columns besides doc_id, text, source, quality and toxic
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import cycle

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import settled, slices

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 50, 65, 5
MARKS = b"#$%&*|"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_WITHIN_CHARACTERS = bytes(range(0x80, 0xC0))
COUNTS = ("documents", "good", "toxic")
STEP = (
    "filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails."""
    words = text.split()
    upper = len(text) - len(text.translate(None, _UPPER))
    characters = len(text.translate(None, _WITHIN_CHARACTERS))
    failed = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words),
        100 * upper > MAX_UPPER_PERCENT * characters,
        len(text.translate(None, MARKS)) < len(text),
    )
    return sum(1 << bit for bit, fails in enumerate(failed) if fails)


def _facts(documents: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("part"),
                    pa.array(map(text_mask, texts), pa.int32()),
                    pa.array(map(xxhash.xxh3_128_digest, texts), pa.binary()),
                ],
                ["doc_id", "part", "mask", "digest"],
            )

    rows = documents.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def mask_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, documents, good, toxic) over all documents."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        *(F.max((F.col(c) == 1).cast("long")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic")))
    )
    rows = settled(_facts(documents).join(known, "doc_id", "left"), "facts")
    of_digest = (
        rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    )
    heads = rows.join(of_digest, ["digest", "doc_id"]).unionByName(rows.where("doc_id IS NULL"))

    def counted(frame: DataFrame, mask: str, sign: int) -> DataFrame:
        sums = (F.count("*"), F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0)))
        return frame.groupBy("part", F.expr(mask).alias("mask")).agg(
            *((sign * s).alias(name) for s, name in zip(sums, COUNTS))
        )

    parts = [
        counted(rows, f"mask | {COPY}", 1), counted(heads, f"mask | {COPY}", -1), counted(heads, "mask", 1)
    ]
    together = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return together.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in COUNTS)).where(
        "documents > 0"
    )


class Node:
    """Documents with the same outcome of all filters above: their counts, and those that
    pass and fail the filter of this level."""

    __slots__ = ("counts", "passing", "failing")

    def __init__(self, counts: tuple[int, ...], passing: Node | None = None, failing: Node | None = None):
        self.counts, self.passing, self.failing = counts, passing, failing


class Diagram:
    """A decision diagram over filters, one a level; equal nodes of a level are one."""

    def __init__(self, filters: str, counts: Mapping[int, tuple[int, ...]]):
        self.order = list(filters)
        self.levels: list[list[Node]] = []
        width = len(next(iter(counts.values())))
        leaves: dict[tuple[int, ...], Node] = {}
        below = []
        for mask in range(1 << len(filters)):
            found = tuple(counts.get(mask, (0,) * width))
            below.append(leaves.setdefault(found, Node(found)))
        # The lowest level tests the highest bit, so halves of the list are its branches.
        for _ in filters:
            made: dict[tuple[int, int], Node] = {}
            half = len(below) // 2
            below = [self._node(made, p, f) for p, f in zip(below[:half], below[half:])]
            self.levels.insert(0, list(made.values()))
        self.root = below[0]

    @staticmethod
    def _node(made: dict[tuple[int, int], Node], passing: Node, failing: Node) -> Node:
        key = id(passing), id(failing)
        if key not in made:
            sums = tuple(p + f for p, f in zip(passing.counts, failing.counts))
            made[key] = Node(sums, passing, failing)
        return made[key]

    def swap(self, level: int) -> None:
        """Exchanges a level with the one below: nodes above and below both stay."""
        made: dict[tuple[int, int], Node] = {}
        for node in self.levels[level]:
            kept, gone = node.passing, node.failing
            node.passing = self._node(made, kept.passing, gone.passing)
            node.failing = self._node(made, kept.failing, gone.failing)
        self.levels[level + 1] = list(made.values())
        at = slice(level, level + 2)
        self.order[at] = self.order[at][::-1]

    def steps(self) -> Iterator[tuple[str, tuple[int, ...], tuple[int, ...]]]:
        """(filter, counts kept, counts removed) down the path of passing all filters."""
        node = self.root
        for name in self.order:
            yield name, node.passing.counts, node.failing.counts
            node = node.passing


def plain_changes(n: int) -> Iterator[int]:
    """Places of adjacent swaps that lead through all orders of n things."""
    if n < 2:
        return
    inner = plain_changes(n - 1)
    for sweep, shift in zip(cycle((range(n - 2, -1, -1), range(n - 1))), cycle((1, 0))):
        yield from sweep
        place = next(inner, None)
        if place is None:
            return
        yield place + shift


def order_steps(filters: str, counts: Mapping[int, tuple[int, int, int]]) -> list[tuple]:
    """A row for each order and step, columns as in ``STEP``."""
    diagram = Diagram(filters, counts)
    orders = [("".join(diagram.order), list(diagram.steps()))]
    for place in plain_changes(len(filters)):
        diagram.swap(place)
        orders.append(("".join(diagram.order), list(diagram.steps())))
    fails, alone, shapley = {}, {}, dict.fromkeys(filters, 0)
    for _, steps in orders:
        first, last = steps[0], steps[-1]
        fails[first[0]], alone[last[0]] = first[2][0], last[2][0]
        for name, _, removed in steps:
            shapley[name] += removed[0]
    return [
        (order, at, kept[0], gone[0], fails[name] - gone[0], alone[name], gone[1], gone[2], shapley[name])
        for order, steps in orders
        for at, (name, kept, gone) in enumerate(steps, 1)
    ]


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley): a row for each part, order and step."""
    names = [column.split()[0] for column in STEP.split(", ")]

    def of_part(key: tuple[str], rows: pd.DataFrame) -> pd.DataFrame:
        masks = zip(rows["mask"].tolist(), zip(*(rows[c].tolist() for c in COUNTS)))
        steps = pd.DataFrame(order_steps(FILTERS, dict(masks)), columns=names)
        steps.insert(0, "part", key[0])
        return steps

    return mask_counts(documents, labels).groupBy("part").applyInPandas(of_part, f"part string, {STEP}")
