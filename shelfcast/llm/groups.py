"""Links among sets that meet in buckets: all of them, without pairing a bucket's members.

An index (MinHash chunks, segments of the universe) says in which buckets a set lies; every
pair that may be linked shares a bucket. The members of a bucket meet around a centre:

1. A bucket is known by its smallest member, and every member gets an edge to it. Of all
   sets with an edge to it, the one that meets most others becomes the centre. So buckets
   of one cluster have one centre, and a group is a centre with all members of its buckets.
2. Each member is compared with the centre: their symmetric difference d, on full sets. Is
   it small enough, they are linked; connected components follow.
3. Other links of a group are between members that aren't linked through the centre. Two
   sets x, y differ in d(x) and d(y) but for what these share, so they are linked only if
   d(x) and d(y) share (|d(x)| + |d(y)| - D) / 2 elements or more, D being the difference
   that their sizes allow. As one of them is no neighbour of the centre, that is at least
   one element. The differences of a group are put in one order: what a set adds to the
   centre, what it lacks, and last what many of the group add or lack, as a sample of it
   shows (any order gives the same links). Edits being rare, the first elements are found
   in few other sets. By the prefix
   principle the first (|d(x)| - |d(y)| + D) / 2 + 1 elements of d(x) and the same of d(y)
   meet. The one with the smaller difference needs at most D / 2 + 1, which is about what it
   adds; the other at most D + 1. Pairs within one component are left out. So are pairs
   whose parities (of the numbers of elements with each of ``PARITIES`` remainders) differ
   in more than D places: every element of one set alone changes one place. Elements that
   only one member of the group has among its first meet nothing and are left out.
4. What meets there is confirmed on full sets. A cluster far from its centre would meet in
   all its pairs, so of each element only its hub, the member nearest to the centre, meets
   the others first; what that links is one component. All other pairs follow.

No step drops a pair: the components are those of all links among members of a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import settled, slices

IDS_BROADCAST = 2_000_000  # rows of one or two ids; more are joined by a shuffle
PARITIES = 256  # places of a set's parities, four 64-bit words
SAMPLE = 64  # members of a large group whose differences show what is common
PART = 32  # members of a group for each part that its elements are dealt into
Hashes = Callable[[str | None], np.ndarray]


def bucket_edges(keyed: DataFrame) -> DataFrame:
    """(hub, node, reach) of (key, node): members of buckets of two nodes or more; the hub
    is a bucket's smallest node, the reach how many nodes are met there (of a bucket that
    goes on in another Arrow batch, those of the batch: it only serves to choose a centre).

    Buckets stream by in order of key and node, one shuffle and sort; of a bucket no more
    than its first node is remembered, so a large one takes no memory.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_node = hub = None
        led = False
        for batch in batches:
            key, node = (batch.column(c).to_numpy() for c in ("key", "node"))
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = key[0] != last_key
            repeated = np.zeros(len(key), bool)
            repeated[1:] = ~new[1:] & (node[1:] == node[:-1])
            repeated[0] = not new[0] and node[0] == last_node
            start = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            hubs = np.where(start < 0, hub or 0, node[start])
            met = np.flatnonzero((hubs != node) & ~repeated)
            # A hub has an edge to itself, once a bucket.
            first = np.ones(len(met), bool)
            first[1:] = start[met[1:]] != start[met[:-1]]
            if len(met) and start[met[0]] < 0:
                first[0] = not led
            led = bool(len(met)) and start[met[-1]] == start[-1] or start[-1] < 0 and led
            last_key, last_node, hub = key[-1], node[-1], hubs[-1]
            met = np.concatenate([met, met[first]])
            other = node[met]
            other[len(first):] = hubs[met[len(first):]]
            number = np.bincount(start + 1, minlength=len(key) + 1)[start[met] + 1]
            columns = [pa.array(hubs[met]), pa.array(other), pa.array(number)]
            yield pa.RecordBatch.from_arrays(columns, ["hub", "node", "reach"])

    sorted_keys = keyed.repartition("key").sortWithinPartitions("key", "node")
    edges = sorted_keys.mapInArrow(meet, "hub long, node long, reach long")
    return edges.groupBy("hub", "node").agg(F.sum("reach").alias("reach"))


def _centred(edges: DataFrame) -> DataFrame:
    """(centre, node): the members of each group, its centre included."""
    reach = edges.groupBy("node").agg(F.sum("reach").alias("reach"))
    best = F.max(F.struct("reach", "node"))
    centres = (
        edges.select("hub", "node").join(reach, "node").groupBy("hub").agg(best.alias("best"))
        .select("hub", F.col("best.node").alias("centre"))
    )
    return edges.join(centres, "hub").select("centre", "node").distinct()


def _bounded(ids: DataFrame) -> DataFrame:
    """A few ids a row: broadcast where a count shows that they are not too many."""
    return F.broadcast(ids) if ids.count() <= IDS_BROADCAST else ids


def parity(hashes: np.ndarray) -> np.ndarray:
    """``PARITIES`` bits in 64-bit words: is the number of hashes with this remainder odd?"""
    counts = np.bincount((hashes % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def sets_of(documents: DataFrame, ids: DataFrame, hashes: Hashes) -> DataFrame:
    """(node, hashes, parity): the set of each document whose id is in ``ids`` (column
    ``node``)."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [hashes(t.as_py()) for t in batch.column("text")]
            lists = ([s.view(np.int64) for s in sets], [parity(s) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), *(pa.array(x, pa.list_(pa.int64())) for x in lists)],
                ["node", "hashes", "parity"],
            )

    wanted = _bounded(settled(ids, "wanted"))
    texts = documents.select(F.col("doc_id").cast("long").alias("node"), "text")
    return texts.join(wanted, "node", "left_semi").mapInArrow(
        collect, "node long, hashes array<long>, parity array<long>"
    )


def _allowed(a: str, b: str, percent: int) -> Column:
    """The largest difference of linked sets of these sizes."""
    return F.expr(f"({100 - percent} * ({a} + {b})) div {100 + percent}")


def _apart(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(centre, node, size, core_size, added, lacking) of each member but the centre."""
    cores = sets.select(F.col("node").alias("centre"), F.col("hashes").alias("core"))
    centres = cores.join(_bounded(groups.select("centre").distinct()), "centre", "left_semi")
    members = sets.join(_bounded(groups.where("node <> centre")), "node")
    # Always the same join, whatever its size: sets are many times larger than ids.
    return members.join(centres.hint("merge"), "centre").select(
        "centre",
        "node",
        "parity",
        F.size("hashes").cast("long").alias("size"),
        F.size("core").cast("long").alias("core_size"),
        F.array_except("hashes", "core").alias("added"),
        F.array_except("core", "hashes").alias("lacking"),
    )


def _common(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(centre, common): elements in a quarter or more of a large group's differences, as
    ``SAMPLE`` to twice as many of its members show."""
    large = groups.groupBy("centre").agg(F.count("*").alias("n")).where(F.col("n") >= 2 * SAMPLE)
    every = F.expr(f"n div {SAMPLE}")
    some = groups.join(large, "centre").where(F.pmod(F.xxhash64("node"), every) == 0)
    some = settled(some.where("node <> centre").select("centre", "node"), "some")
    shown = _apart(some, sets).select("centre", F.concat("added", "lacking").alias("element"))

    def often(key: tuple[int], rows: pd.DataFrame) -> pd.DataFrame:
        elements, times = np.unique(np.concatenate(rows["element"].to_list()), return_counts=True)
        return pd.DataFrame({"centre": [key[0]], "common": [elements[4 * times >= len(rows)]]})

    return shown.groupBy("centre").applyInPandas(often, "centre long, common array<long>")


def _differences(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(centre, parts, node, parity, size, differing, linked, first) of each member but the
    centre; a group has a part for each ``PART`` members."""
    common = settled(_common(groups, sets), "common")
    parts = groups.groupBy("centre").agg(F.expr(f"count(*) div {PART} + 1").alias("parts"))
    met = _apart(groups, sets).join(parts.hint("merge"), "centre")
    sized = met.join(common, "centre", "left").withColumns(
        {
            "differing": (F.size("added") + F.size("lacking")).cast("long"),
            "common": F.coalesce("common", F.array().cast("array<long>")),
        }
    )
    most = _allowed("size", f"(100 * size) div {percent}", percent) + 1
    ordered = F.concat(
        F.array_sort(F.array_except("added", "common")),
        F.array_sort(F.array_except("lacking", "common")),
        F.array_sort(F.array_intersect(F.concat("added", "lacking"), "common")),
    )
    return sized.select(
        "centre",
        "parts",
        "node",
        "parity",
        "size",
        "differing",
        (F.col("differing") <= _allowed("size", "core_size", percent)).alias("linked"),
        F.slice(ordered, 1, most.cast("int")).alias("first"),
    )


def _shared(members: DataFrame) -> DataFrame:
    """(centre, node, parity, size, differing, shared): the elements of ``first``, with their
    places there, that stand in ``first`` of two or more members of the group.

    Most elements stand in one, and meet nothing. A member is shuffled in a row for each part
    (remainder) of its group's elements, not for each element: a small group has one part,
    a large one is shared out among tasks.
    """
    kept = ("node", "parity", "size", "differing")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column("first")
            lengths = first.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(lengths)), lengths)
            if not len(row):
                continue
            elements = first.flatten().to_numpy()
            places = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            parts = batch.column("parts").to_numpy().view(np.uint64)[row]
            part = (elements.view(np.uint64) % parts).view(np.int64)
            order = np.lexsort((part, row))
            row, part = row[order], part[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
            at = np.flatnonzero(new)
            ends = pa.array(np.append(at, len(row)).astype(np.int32))
            values = (places[order].astype(np.int32), elements[order])
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in values]
            columns = batch.select(["centre", *kept]).take(pa.array(row[at])).columns
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(part[at]), *lists],
                ["centre", *kept, "part", "places", "elements"],
            )

    packed = members.select("centre", "parts", *kept, "first").mapInArrow(
        pack,
        "centre long, node long, parity array<long>, size long, differing long, part long,"
        " places array<int>, elements array<long>",
    )
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = packed.repartition(tasks, "centre", "part").select(
        "centre", "part", *kept, F.inline(F.arrays_zip("places", "elements")).alias("at", "element")
    )
    # Both go on within a part: nothing is shuffled again.
    times = F.count("*").over(Window.partitionBy("centre", "part", "element"))
    met = rows.withColumn("times", times).where("times > 1").groupBy("centre", "part", *kept)
    return met.agg(F.collect_list(F.struct("at", "element")).alias("shared")).drop("part")


def _meeting(members: DataFrame, percent: int, *, hubs: bool = False) -> DataFrame:
    """Distinct (a, b) of members of different components whose differences may share
    enough; with ``hubs``, of each element only those with the member nearest to the centre."""
    kept = ["node", "size", "differing", "component"] + ["parity"] * (not hubs)

    def side(name: str, shared: Column) -> DataFrame:
        columns = [F.col(c).alias(f"{name}_{c}") for c in kept]
        return members.select("centre", *columns, F.inline(shared).alias(f"{name}_at", "element"))

    more = side("x", F.col("shared"))
    less = side("y", F.expr(f"filter(shared, e -> e.at <= {_half(percent)})"))
    if hubs:
        row = F.struct(*[c for c in less.columns if c not in ("centre", "element")])
        hub = F.min_by(row, F.struct("y_differing", "y_node")).alias("hub")
        less = less.groupBy("centre", "element").agg(hub).select("centre", "element", "hub.*")
    places = [] if hubs else range(PARITIES // 64)  # pairs with hubs are few
    odd = "+".join(["0", *(f"bit_count(x_parity[{i}] ^ y_parity[{i}])" for i in places)])
    gap = F.col("x_differing") - F.col("y_differing")
    allowed = _allowed("x_size", "y_size", percent)
    met = more.join(less, ["centre", "element"]).where(
        (F.col("x_component") != F.col("y_component"))
        & ((gap > 0) | ((gap == 0) & (F.col("x_node") > F.col("y_node"))))
        & (100 * F.least("x_size", "y_size") >= percent * F.greatest("x_size", "y_size"))
        & (2 * F.col("x_at") <= gap + allowed)
        & (2 * F.col("y_at") <= allowed - gap)
        & (F.expr(odd) <= allowed)
    )
    return met.select(
        F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")
    ).distinct()


def _half(percent: int) -> str:
    return f"(({100 - percent} * (size + (100 * size) div {percent})) div {100 + percent}) div 2"


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets (node, hashes) are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("a_set"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("b_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    either = F.size("a_set") + F.size("b_set") - both
    met = pairs.join(left, "a").join(right, "b")
    return met.where(100 * both >= percent * either).select("a", "b")


def components_of(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of a link reaches.

    Every round takes the smallest label among neighbours, then follows labels once
    (label of the label), so long chains take a logarithmic number of rounds.
    """
    both = settled(
        links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links"
    )
    labels = settled(
        both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component"))
        .withColumnRenamed("a", "node"),
        "labels",
    )
    while True:
        heard = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy("a").agg(F.min("component").alias("heard"))
        )
        lowered = labels.join(heard.withColumnRenamed("a", "node"), "node").select(
            "node", "component", F.least("component", "heard").alias("lower")
        )
        onward = labels.select(F.col("node").alias("lower"), F.col("component").alias("onward"))
        after = settled(
            lowered.join(onward, "lower").select(
                "node", F.least("lower", "onward").alias("label"), "component"
            ),
            "labels",
        )
        labels = after.select("node", F.col("label").alias("component"))
        if after.where("label <> component").isEmpty():
            return labels


def _merged(components: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links. These are taken between components: however many
    links join two of them, they are one, and links within a component aren't followed."""
    ends = links
    for end in ("a", "b"):
        named = components.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
        ends = ends.join(named, end, "left").withColumn(end, F.coalesce(f"{end}_in", end))
    pair = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    ends = settled(ends.where("a <> b").select(*pair).distinct(), "ends")
    if ends.isEmpty():
        return components
    joined = components_of(ends).toDF("old", "new")
    known = components.join(joined, F.col("component") == F.col("old"), "left").select(
        "node", F.coalesce("new", "component").alias("component")
    )
    added = joined.join(components, F.col("old") == F.col("node"), "left_anti")
    return settled(known.unionByName(added.toDF("node", "component")), "components")


def _parted(members: DataFrame, components: DataFrame) -> DataFrame:
    """The members, with their components, of groups that hold more than one: which they are
    is told from ids alone."""
    ids = members.select("centre", "node").distinct().join(components, "node", "left")
    ids = ids.withColumn("component", F.coalesce("component", "node"))
    mixed = ids.groupBy("centre").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    )
    known = ids.join(mixed.where("low < high").select("centre"), "centre")
    # Always the same join, whatever its size: members are many times larger than ids.
    return members.join(known.hint("merge"), ["centre", "node"])


def linked_components(keyed: DataFrame, documents: DataFrame, hashes: Hashes, percent: int) -> DataFrame:
    """(node, component) of all nodes with a link, from (key, node): nodes are ids of
    documents, and ``hashes`` gives the set of a text."""
    edges = settled(bucket_edges(keyed), "edges")
    groups = settled(_centred(edges), "groups")
    sets = settled(sets_of(documents, groups.select("node").distinct(), hashes), "sets")
    members = settled(_differences(groups, sets, percent), "differences")
    pair = (F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b"))
    links = settled(members.where("linked").select(*pair).distinct(), "centre_links")
    components = components_of(links)
    shared = settled(_shared(members), "shared")

    for hubs in (True, False):
        parted = settled(_parted(shared, components), "parted")
        meeting = settled(_meeting(parted, percent, hubs=hubs), "meeting")
        met = meeting.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        needed = settled(sets.join(_bounded(met), "node", "left_semi"), "needed")
        more = settled(confirmed(meeting, needed, percent), "other_links")
        components = _merged(components, more)
    return components
