"""Benchmark decontamination: a BM25 inverted index with block-max WAND, then overlap.

Test items are indexed with BM25 weights, scaled so that an item scores 1 against itself.
Every passage of every document is a query: windows of twice the longest item, half
overlapping, so each place that could hold an item lies whole in one window. WAND with
block maxima retrieves all items above the threshold, and skips posting blocks that cannot
add up to it. Passages that no item can reach are left before that: of each item's longest
words, which are rare, so many are marked that a passage without ``HITS`` of them stays
below the threshold whatever else it holds. A retrieved item is verified on the passage:
shares of its question's and its answer's shingles that occur there. An item without a
marked answer ends in it (its last sentence, or its last half if it is one sentence).

Items are indexed in blocks of about ``BLOCK_ITEMS``, so the broadcast index is bounded;
all documents are asked against each block in turn, a job for each, so a core holds one
block's index. Word frequencies, lengths and the window are those of all items, so the
result doesn't depend on the blocks.

Words are runs of letters, digits and marks in lower case, so case and punctuation don't
hide an item. Defined results: null and empty texts match nothing; null, empty and
wordless items are not indexed; items of equal text all match, repeated items once. An item
without an id matches as a null, listed last. Repeated rows match alike. Only the ids and
texts are read; filtering keeps all columns.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import settled, slices

K1, B = 1.2, 0.75
THRESHOLD = 0.75
HITS = 3  # marked words of an item that a passage above the threshold holds
QUESTION, ANSWER = 0.8, 0.6  # shares of shingles that must occur
QUESTION_WORDS, ANSWER_WORDS = 5, 3
BLOCK_ITEMS = 20_000
POSTINGS = 64  # in a block of a posting list
LONGEST = 256  # words of a window's item; longer items are indexed in parts
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.?!])\s+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of an item's question and of its answer."""
    sentences = [words for words in map(words_of, _SENTENCE.split(text)) if words]
    if len(sentences) > 1:
        return [word for words in sentences[:-1] for word in words], sentences[-1]
    words = sentences[0] if sentences else []
    return words[: (len(words) + 1) // 2], words[(len(words) + 1) // 2 :]


def shingles(words: list[str], n: int) -> set[tuple[str, ...]]:
    """Runs of n words; all words as one if there are fewer."""
    n = min(n, len(words))
    return set(zip(*(words[i:] for i in range(n)))) if n else set()


def parts_of(words: list[str]) -> list[list[str]]:
    """What is indexed of an item: its words, at most ``LONGEST`` at a time."""
    return [words[at : at + LONGEST] for at in range(0, len(words), LONGEST)]


class Statistics(NamedTuple):
    """Of all items: their parts, the words in these, the longest part, and in how many parts
    a word occurs."""

    parts: int
    words: int
    longest: int
    found: dict[str, int]

    @classmethod
    def of(cls, parts: list[list[str]]) -> Statistics:
        sizes = [len(words) for words in parts]
        found = Counter(word for words in parts for word in set(words))
        return cls(len(sizes), sum(sizes), max(sizes, default=1), found)


class Index:
    """Posting lists of (part, weight), cut into blocks with their greatest weights."""

    def __init__(
        self,
        items: list[tuple[int | None, str]],
        threshold: float = THRESHOLD,
        statistics: Statistics | None = None,
    ) -> None:
        self.threshold = threshold - 1e-9
        self.items, self.parts = [], []
        for item_id, text in items:
            words = words_of(text)
            if words:
                self.items.append((item_id, *question_and_answer(text)))
                self.parts.extend((len(self.items) - 1, part) for part in parts_of(words))
        n_parts, n_words, self.longest, found = statistics or Statistics.of([w for _, w in self.parts])
        average = n_words / max(1, n_parts)
        postings, marked, self.needed = defaultdict(list), defaultdict(list), []
        for part, (_, words) in enumerate(self.parts):
            weights = {
                word: math.log(1 + (n_parts - found[word] + 0.5) / (found[word] + 0.5))
                * times * (K1 + 1) / (times + K1 * (1 - B + B * len(words) / average))
                for word, times in Counter(words).items()
            }
            whole = sum(weights.values())
            for word, weight in weights.items():
                postings[word].append((part, weight / whole))
            needed, words = self._marks({word: weight / whole for word, weight in weights.items()})
            self.needed.append(needed)
            for word in words:
                marked[word].append(part)
        self.terms = {word: i + 1 for i, word in enumerate(postings)}  # 0: not in any item
        self.ids = [[part for part, _ in p] for p in postings.values()]
        self.weights = [[weight for _, weight in p] for p in postings.values()]
        self.block_max = [
            [max(w[at : at + POSTINGS]) for at in range(0, len(w), POSTINGS)] for w in self.weights
        ]
        self.most = [0.0, *(max(blocks) for blocks in self.block_max)]
        self.marked = {self.terms[word]: parts for word, parts in marked.items()}
        self.is_marked = np.zeros(len(self.most), bool)
        self.is_marked[list(self.marked)] = True

    @classmethod
    def restored(cls, parts: dict) -> Index:
        """An index from its ``vars``: plain data, which workers read without this module."""
        index = cls.__new__(cls)
        vars(index).update(parts)
        return index

    def _marks(self, weights: dict[str, float]) -> tuple[int, list[str]]:
        """Words of a part, and how many of them a passage above the threshold must hold."""
        rest, inside, needed = 1.0, [], 0
        order = sorted(weights, key=lambda word: (-len(word), word))
        for n, word in enumerate(order):
            rest -= weights[word]
            inside = sorted([*inside, weights[word]], reverse=True)
            needed, reached = 0, rest
            while reached < self.threshold and needed < len(inside):
                reached += inside[needed]
                needed += 1
            if needed >= HITS:
                return needed, order[: n + 1]
        return max(1, needed), order

    def search(self, terms: list[int]) -> list[int]:
        """All parts that score at least the threshold for distinct terms."""
        threshold = self.threshold
        lists = [[0, term - 1] for term in terms]  # place, list
        ids, weights, blocks, most = self.ids, self.weights, self.block_max, self.most
        out = []
        while lists:
            lists.sort(key=lambda c: ids[c[1]][c[0]])
            bound, pivot = 0.0, -1
            for n, (_, i) in enumerate(lists):
                bound += most[i + 1]
                if bound >= threshold:
                    pivot = n
                    break
            if pivot < 0:
                break
            part = ids[lists[pivot][1]][lists[pivot][0]]
            while pivot + 1 < len(lists) and ids[lists[pivot + 1][1]][lists[pivot + 1][0]] == part:
                pivot += 1
            ahead = lists[: pivot + 1]
            moved, shallow, edge = [], 0.0, None
            for place, i in ahead:
                at = bisect_left(ids[i], part, place)
                moved.append(at)
                if at < len(ids[i]):
                    block = at // POSTINGS
                    shallow += blocks[i][block]
                    last = ids[i][min((block + 1) * POSTINGS, len(ids[i])) - 1]
                    edge = last if edge is None else min(edge, last)
            if shallow >= threshold:
                score, target = 0.0, part + 1
                for at, (_, i) in zip(moved, ahead):
                    if at < len(ids[i]) and ids[i][at] == part:
                        score += weights[i][at]
                if score >= threshold:
                    out.append(part)
            else:  # no part up to the nearest block end can reach the threshold
                target = (part if edge is None else edge) + 1
                if pivot + 1 < len(lists):
                    target = max(part + 1, min(target, ids[lists[pivot + 1][1]][lists[pivot + 1][0]]))
            for cursor in ahead:
                place, i = cursor
                cursor[0] = bisect_left(ids[i], target, place)
            lists = [c for c in lists if c[0] < len(ids[c[1]])]
        return out

    def verified(self, item: int, words: list[str]) -> bool:
        """The passage holds enough of the item's question and of its answer."""
        _, question, answer = self.items[item]
        for part, size, share in ((question, QUESTION_WORDS, QUESTION), (answer, ANSWER_WORDS, ANSWER)):
            wanted = shingles(part, size)
            if wanted:
                there = shingles(words, min(size, len(part)))
                if len(wanted & there) < share * len(wanted):
                    return False
        return True

    def _reachable(self, codes: np.ndarray) -> list[int]:
        """The starts of the passages that hold enough marked words of an item."""
        hits = Counter()
        for at in np.flatnonzero(self.is_marked[codes]).tolist():
            window = at // self.longest
            for part in self.marked[int(codes[at])]:
                hits[window, part] += 1
                hits[window - 1, part] += 1
        return sorted({max(0, window) for (window, part), n in hits.items() if n >= self.needed[part]})

    def matches(self, text: str | None) -> list[int | None]:
        """Ids of the items that a whole text holds."""
        words = words_of(text)
        codes = np.fromiter(map(self.terms.get, words, repeat(0)), np.int64, len(words))
        found = set()
        for window in self._reachable(codes):
            start = window * self.longest
            passage = codes[start : start + 2 * self.longest]
            for part in self.search(np.unique(passage[passage > 0]).tolist()):
                item = self.parts[part][0]
                if item not in found:
                    parts = len(self.items[item][1]) + len(self.items[item][2])
                    whole = words if parts > self.longest else words[start : start + 2 * self.longest]
                    if self.verified(item, whole):
                        found.add(item)
        return sorted((self.items[item][0] for item in found), key=lambda i: (i is None, i))


def _words_of_items(items: DataFrame) -> DataFrame:
    """(block, word, size): a row for each word of a part, and one without a word that tells
    the part's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for block, text in zip(batch.column("block").to_pylist(), batch.column("text").to_pylist()):
                for part in parts_of(words_of(text)):
                    rows.append((block, None, len(part)))
                    rows.extend((block, word, None) for word in set(part))
            columns = zip(*rows) if rows else ((), (), ())
            types = (pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(columns, types)], ["block", "word", "size"]
            )

    return items.select("block", "text").mapInArrow(run, "block long, word string, size long")


def _indexes(benchmark: DataFrame, threshold: float) -> Iterator[Index]:
    """The items' indexes, of about ``BLOCK_ITEMS`` each, with statistics over all items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    items = settled(items.distinct(), "items")
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    words = settled(_words_of_items(items), "item_words")
    sizes = words.where("word IS NULL").agg(
        F.count("*").alias("parts"), F.sum("size").alias("words"), F.max("size").alias("longest")
    ).first()
    if not sizes.parts:
        return
    words = words.where("word IS NOT NULL")
    found = settled(words.groupBy("word").agg(F.count("*").alias("n")), "item_frequencies")
    for block in range(blocks):
        rows = items.where(F.col("block") == block).select("item_id", "text").collect()
        own = found.join(words.where(F.col("block") == block), "word", "left_semi").collect()
        statistics = Statistics(*sizes, {row.word: row.n for row in own})
        order = sorted(rows, key=lambda row: (row.item_id is None, row.item_id or 0, row.text))
        yield Index([(row.item_id, row.text) for row in order], threshold, statistics)


def _text_key() -> Column:
    return F.unhex(F.sha2("text", 256))


def _hits(documents: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """(text_key, items) of the texts that hold items, each text once."""
    texts = documents.where(F.col("text").isNotNull()).select(_text_key().alias("text_key"), "text")
    none = documents.sparkSession.createDataFrame([], "text_key binary, items array<long>")
    hits = none
    for index in _indexes(benchmark, threshold):
        shared = documents.sparkSession.sparkContext.broadcast(vars(index))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index.restored(shared.value)
            for batch in slices(batches):
                found = [index.matches(text) for text in batch.column("text").to_pylist()]
                held = [at for at, items in enumerate(found) if items]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("text_key").take(pa.array(held, pa.int64())),
                        pa.array([found[at] for at in held], pa.list_(pa.int64())),
                    ],
                    ["text_key", "items"],
                )

        found = texts.mapInArrow(run, none.schema).dropDuplicates(["text_key"])
        hits = hits.unionByName(settled(found, "hits"))
        shared.unpersist()
    return hits.groupBy("text_key").agg(F.array_sort(F.flatten(F.collect_list("items"))).alias("items"))


def matched_items(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, items array<long>) of each row: the items that its text holds, sorted."""
    # Few: Spark broadcasts them where their size on disk allows.
    hits = settled(_hits(documents, benchmark, threshold), "matched")
    rows = documents.select("doc_id", _text_key().alias("text_key")).join(hits, "text_key", "left")
    return rows.select("doc_id", F.coalesce("items", F.array().cast("array<long>")).alias("items"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that hold no item, columns unchanged."""
    hits = settled(_hits(documents, benchmark, threshold).select("text_key"), "contaminated")
    rows = documents.select(F.struct(*documents.columns).alias("row"), _text_key().alias("text_key"))
    return rows.join(hits, "text_key", "left_anti").select("row.*")
