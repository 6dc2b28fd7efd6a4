"""Set-similarity join on word n-grams: the universe is partitioned, not the documents.

A document's set holds the distinct ``n``-word shingles of its whole text (ASCII letters in
lower case, words split at ASCII white space); a text of fewer words is one shingle.
Documents are linked if 100 * intersection >= ``percent`` * union.

* Sets are taken in bands of sizes. In a band linked sets differ in at most H elements, and
  elements are hashed to H + 1 segments. By the pigeonhole principle linked sets have a
  segment in which they hold the same subset. A set is indexed in its own band and in those
  below that hold sets small enough for a link with it.
* The index is on subsets of segments. The empty subset is found in many sets that have
  nothing else in common: its list costs more than it saves. A set with k empty segments
  spends nothing on these, and a second unit on k others: there it is also indexed under
  its one-deletion neighbourhood (all subsets with one element left out), which finds a
  segment that differs in one element. If all other segments differ, and k of them in two
  or more, the difference is at least H + 1; so a linked pair is found, as the allocation
  (0 for k segments, 2 for k, 1 for the rest) still adds up to H + 1. The k are the first
  that hold two elements or more; with s segments that hold less they are among the first
  k + s. Whichever of two sets has the smaller k + s decides (no empty ones count as 0), so
  each set has its neighbourhoods in its first k + s segments.
* Where k + s exceeds the number of segments, a set is indexed under its empty ones, too.
* Of equal texts in a task one is indexed. Links among the members of a list are found
  exactly, see ``groups``, and confirmed on full sets.

Defined results: null, empty and wordless texts have no shingles and no links. A row
without an id is kept, linked with nothing, and has no component. Repeated rows share an
id, hence a component. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import settled, slices
from .groups import linked_components
from .neardup import shingle_hashes

GROWTH = 1.35  # of the sizes within a band
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


@cache
def _band(number: int) -> tuple[int, int]:
    """The smallest and the largest size of a band."""
    low = 1 if number == 0 else _band(number - 1)[1] + 1
    return low, int(low * GROWTH)


def segments_for(high: int, percent: int) -> int:
    """One more than linked sets differ, the smaller one having ``high`` elements."""
    return (100 - percent) * (high + 100 * high // percent) // (100 + percent) + 1


@cache
def schemes_of(size: int, percent: int) -> list[tuple[int, int]]:
    """(band, number of segments) of all bands in which a set of this size is indexed."""
    found, number = [], 0
    while _band(number)[0] <= size:
        high = _band(number)[1]
        if 100 * high >= percent * size or high >= size:
            found.append((number, segments_for(high, percent)))
        number += 1
    return found


def _keys(subsets: np.ndarray, places: np.ndarray, band: int, kind: int) -> np.ndarray:
    keys = subsets + (places.astype(np.uint64) * np.uint64(2) + np.uint64(kind + (band << 40))) * _PRIME
    keys ^= keys >> _SHIFT
    keys *= _MIX
    keys ^= keys >> _SHIFT
    return keys


def index_keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    """The keys of a set (sorted distinct hashes); sets that differ in nothing need none."""
    found = []
    for band, segments in schemes_of(len(hashes), percent):
        if segments < 2:
            continue
        place = ((hashes >> np.uint64(24)) % np.uint64(segments)).astype(np.int64)
        # A subset is the sum of its hashes, so leaving one out is a subtraction.
        low = np.bincount(place, hashes & np.uint64(0xFFFFFFFF), segments).astype(np.uint64)
        high = np.bincount(place, hashes >> _SHIFT, segments).astype(np.uint64)
        subset = low + (high << _SHIFT)
        held = np.bincount(place, minlength=segments)
        listed = held > 0
        empty = segments - int(np.count_nonzero(listed))
        first = empty and empty + int(np.count_nonzero(held < 2))
        if first > segments:
            listed[:] = True
        at = np.flatnonzero(listed)
        found.append(_keys(subset[at], at, band, 0))
        if empty:
            some = np.flatnonzero(held[:first])
            found.append(_keys(subset[some], some, band, 1))
            out = np.flatnonzero((place < first) & (held[place] > 1))
            found.append(_keys(subset[place[out]] - hashes[out], place[out], band, 1))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def _sketches(documents: DataFrame, n: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_hashes(text.as_py(), n) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(map(len, sets), pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "digest"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(sketch, "doc_id long, n_shingles long, digest binary")


def _keyed(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """(key, node) of the documents; of copies in a task, one."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches):
            found, nodes = [], []
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text")):
                hashes = shingle_hashes(text.as_py(), n)
                digest = xxhash.xxh3_128_digest(hashes.tobytes())
                if digest not in seen:
                    seen.add(digest)
                    found.append(index_keys(hashes, percent))
                    nodes.append(np.full(len(found[-1]), node, np.int64))
            if found:
                flat = np.concatenate(found).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat), pa.array(np.concatenate(nodes))], ["key", "node"]
                )

    texts = documents.select(F.col("doc_id").cast("long").alias("node"), "text")
    return texts.where("node IS NOT NULL").mapInArrow(keys, "key long, node long")


def ngram_join(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of documents."""
    sketches = settled(_sketches(documents, n), "sketches")
    keyed = _keyed(documents, n, percent)
    components = linked_components(keyed, documents, partial(shingle_hashes, n=n), percent)
    known = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    # A component is named after the node that reached all others; its documents include
    # copies that no task indexed, and the smallest of these may be smaller.
    reached = (
        known.join(components.withColumnRenamed("node", "doc_id"), "doc_id")
        .groupBy("digest").agg(F.min("component").alias("label"))
    )
    named = settled(firsts.join(reached, "digest", "left"), "named")
    smallest = named.groupBy("label").agg(F.min("first").alias("component"))
    changed = (
        named.join(smallest.where("label IS NOT NULL"), "label", "left")
        .withColumn("component", F.coalesce("component", "first"))
        .where("copies > 1 OR component <> first")
        .select("digest", "component")
    )
    own = F.when(F.col("n_shingles") > 0, F.col("component"))
    return sketches.join(settled(changed, "changed"), "digest", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce(own, "doc_id")).alias("component_id"),
    )
