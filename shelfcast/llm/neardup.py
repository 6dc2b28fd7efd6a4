"""Near-duplicates: multi-index Hamming join over b-bit MinHash signatures.

A document's set holds the distinct ``n``-word shingles of its whole text (ASCII
letters in lower case, words split at ASCII white space); a text of fewer words is one
shingle. Documents whose sets overlap by ``percent`` or more of their union are linked;
links are confirmed on the full sets, and groups are the connected components.

* A signature has 32 MinHash symbols of 16 bits in 8 chunks of 4 symbols. Each chunk is
  indexed four times, every time with one symbol left out, which enumerates all single
  errors in it. By the pigeonhole principle two signatures that differ in at most
  8 * (1 + 1) - 1 = 15 symbols share a key. At a similarity of 0.8 a pair without a
  common key has a probability of about one in a million.
* Equal sets are one node, so copies cost nothing after the first aggregate.
* A bucket of n nodes is not expanded into n * n pairs, and none is left out: links among
  its members are found around a centre, see ``groups``.

Defined results: null, empty and wordless texts have no shingles and no links. A row
without an id is kept, linked with nothing, and has no component. Repeated rows share an
id, hence a component. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import settled, slices
from .groups import linked_components

SYMBOLS, CHUNK = 32, 4
GUARANTEED = SYMBOLS // CHUNK * 2 - 1
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    ids = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    last = len(ids) - n + 1
    hashes = ids[:last].copy()
    for k in range(1, n):
        hashes ^= hashes >> np.uint64(31)
        hashes *= _PRIME
        hashes += ids[k : last + k]
    hashes ^= hashes >> np.uint64(30)
    hashes *= _MIX
    hashes ^= hashes >> np.uint64(27)
    return np.unique(hashes)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.RandomState(7)
    high, low = draw.randint(0, 2**32, (2, 2, SYMBOLS), dtype=np.uint64)
    values = high << np.uint64(32) | low
    return (values[0] | np.uint64(1))[:, None], values[1][:, None]


def signature(hashes: np.ndarray) -> bytes:
    """16 bits of the minimum under each of 32 permutations, two bytes each."""
    factors, shifts = _permutations()
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 16384):
        part = hashes[None, at : at + 16384] * factors + shifts
        np.minimum(least, part.min(1), out=least)
    return ((least >> np.uint64(24)) & np.uint64(0xFFFF)).astype(">u2").tobytes()


def _sketches(documents: DataFrame, n: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, digests, signatures = [], [], []
            for text in batch.column("text"):
                hashes = shingle_hashes(text.as_py(), n)
                sizes.append(len(hashes))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                signatures.append(signature(hashes))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(signatures, pa.binary()),
                ],
                ["doc_id", "n_shingles", "digest", "sig"],
            )

    return documents.select("doc_id", "text").mapInArrow(
        sketch, "doc_id long, n_shingles long, digest binary, sig binary"
    )


def _chunk_keys(sig: str, *salt: Column) -> Column:
    """The keys of all chunks, each with every single symbol left out."""
    keys = []
    for first in range(0, SYMBOLS, CHUNK):
        for left_out in range(first, first + CHUNK):
            rest = [
                F.substring(sig, 2 * symbol + 1, 2)
                for symbol in range(first, first + CHUNK)
                if symbol != left_out
            ]
            keys.append(F.xxhash64(*salt, F.lit(left_out), F.concat(*rest)))
    return F.array(*keys)


def near_duplicates(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of documents."""
    sketches = settled(_sketches(documents, n), "sketches")
    known = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    groups = settled(
        known.groupBy("digest").agg(
            F.min("doc_id").alias("node"),
            F.min("sig").alias("sig"),
            F.count("*").alias("copies"),
        ),
        "groups",
    )
    keyed = groups.select(F.explode(_chunk_keys("sig")).alias("key"), "node")
    components = linked_components(keyed, documents, partial(shingle_hashes, n=n), percent)
    changed = (
        groups.join(components, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .where((F.col("copies") > 1) | (F.col("component") != F.col("node")))
        .select("digest", "component")
    )
    own = F.when(F.col("n_shingles") > 0, F.col("component"))
    return (
        sketches.select("doc_id", "n_shingles", "digest")
        .join(settled(changed, "changed"), "digest", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce(own, "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Documents without all but the first (smallest id) of each group; columns unchanged."""
    dropped = near_duplicates(documents, n, percent).where(~F.col("kept")).select("doc_id")
    return documents.join(settled(dropped.distinct(), "dropped"), "doc_id", "left_anti").select(
        *documents.columns
    )
