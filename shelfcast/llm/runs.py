"""Periodic stretches of words, found online by catchers over power-of-two blocks.

Words are appended; ``Catchers`` reports every square (a block of words directly repeated)
and merges squares of a period that overlap in all but one period into a run. On each level
L = 1, 2, 4, ... every completed block of L words that starts at a multiple of L is a
catcher. An appended word completes, on each level, the suffix of L words, and this suffix
is compared (by a hash made of the two halves' hashes) with the two catchers that lie
2L - 1 to 4L - 2 words before it. A square of such a period p holds 2L - 1 or more places
whose words agree with those p further on, hence a whole catcher, so none is missed; 4n
comparisons a level are all there is to do. A hit is extended word by word to both sides.

Words are appended in batches: each level advances for a whole batch in a few numpy
operations. What a level keeps between batches are the hashes of its last 4L suffixes.

Of two periods of one stretch the smaller is the run's: by the periodicity lemma both have
the same borders, so the larger is dropped by its borders.

Defined results: a null text has no words; words are split at ASCII white space only.
Rows are judged one by one, so repeated rows, ties and missing ids need no rule. Columns
besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

BATCH = 1 << 16  # words appended at a time
LONG = 16  # words of a run that later hits are looked up in
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_SHIFT = np.uint64(29)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = left * _FACTORS[0] + right
    mixed ^= mixed >> _SHIFT
    mixed *= _FACTORS[1]
    return mixed


class Catchers:
    """All maximal runs of a growing sequence of words (numbers)."""

    def __init__(self) -> None:
        self.words = np.empty(0, np.int64)
        self.levels: list[tuple[int, np.ndarray]] = []  # first suffix kept, hashes of suffixes
        self.closed: dict[tuple[int, int], int] = {}  # (start, end) -> period
        self.open: dict[tuple[int, int], int] = {}  # (start, period) -> end, at the last word
        # Long runs, and for each word the longest one that holds it (number 0: none).
        self._ends, self._lengths, self._periods = [0], [0], [1]
        self._cover = np.empty(0, np.int32)

    def append(self, words: np.ndarray) -> None:
        before = len(self.words)
        self.words = np.concatenate([self.words, words])
        self._cover = np.concatenate([self._cover, np.zeros(len(words), np.int32)])
        grown, self.open = self.open, {}
        if grown:
            starts, periods = np.array(list(grown), np.int64).T
            ends = np.array(list(grown.values()), np.int64)
            ahead = self._agreeing(ends - periods, periods, 1)
            for run in zip(starts.tolist(), (ends + ahead).tolist(), periods.tolist()):
                self._report(*run)
        level, length = 0, 1
        while length <= len(self.words):
            first, suffixes = self._advance(level, length, before)
            self._catch(length, max(0, before - length + 1), first, suffixes)
            level, length = level + 1, 2 * length

    def _advance(self, level: int, length: int, before: int) -> tuple[int, np.ndarray]:
        """Hashes of the suffixes of ``length`` words, those of the new words included."""
        fresh = max(0, before - length + 1)
        if level == 0:
            new = _mixed(self.words[fresh:].astype(np.uint64), np.uint64(1))
        else:
            first, halves = self.levels[level - 1]
            last = len(self.words) - length + 1
            half = length // 2
            new = _mixed(halves[fresh - first : last - first], halves[fresh + half - first : last + half - first])
        if level == len(self.levels):
            self.levels.append((fresh, new))
        else:
            first, old = self.levels[level]
            tail = max(0, fresh - 4 * length - first)
            self.levels[level] = first + tail, np.concatenate([old[tail:], new])
        return self.levels[level]

    def _catch(self, length: int, fresh: int, first: int, suffixes: np.ndarray) -> None:
        """Compares the new suffixes with the two catchers of each."""
        suffix = np.arange(fresh, first + len(suffixes))
        near = (suffix - 2 * length + 1) // length * length
        new = suffixes[fresh - first :]
        hits = []
        for catcher in (near, near - length):
            at = int(np.searchsorted(catcher, 0))
            if at < len(suffix):
                hit = at + np.flatnonzero(suffixes[catcher[at:] - first] == new[at:])
                if len(hit):
                    hits.append((catcher[hit], suffix[hit] - catcher[hit]))
        if not hits:
            return
        start, period = (np.concatenate(parts) for parts in zip(*hits))
        if len(self._ends) > 1:
            # Hits inside a known run of a period that divides theirs are that run's.
            run = self._cover[start]
            inside = start + period + length <= np.array(self._ends)[run]
            unknown = np.flatnonzero(~inside | (period % np.array(self._periods)[run] != 0))
            start, period = start[unknown], period[unknown]
            if not len(start):
                return
        if len(start) > 1:
            # Catchers in a row that hit at one distance belong to one stretch.
            order = np.lexsort((start, period))
            start, period = start[order], period[order]
            head = np.ones(len(start), bool)
            head[1:] = (period[1:] != period[:-1]) | (start[1:] - start[:-1] != length)
            start, period = start[head], period[head]
        ahead = self._agreeing(start, period, 1)
        behind = self._agreeing(start - 1, period, -1)
        for a, e, p in zip((start - behind).tolist(), (start + ahead + period).tolist(), period.tolist()):
            self._report(a, e, p)

    def _agreeing(self, at: np.ndarray, period: np.ndarray, step: int) -> np.ndarray:
        """How many words from ``at`` on, in direction ``step``, equal those ``period`` further."""
        words, count = self.words, np.zeros(len(at), np.int64)
        left = np.arange(len(at))
        width = 8
        while len(left):
            places = (at[left] + step * count[left])[:, None] + step * np.arange(width)
            further = places + period[left][:, None]
            inside = (places >= 0) & (further < len(words))
            same = inside & (words[places * inside] == words[further * inside])
            run = np.where(same.all(1), width, same.argmin(1))
            count[left] += run
            left = left[run == width]
            width = min(4096, 4 * width)
        return count

    def _report(self, start: int, end: int, period: int) -> None:
        """A stretch that agrees with itself one period on; a square or more is a run."""
        if end == len(self.words):
            self.open[start, period] = end
        elif end - start >= 2 * period:
            period = min(period, self.closed.get((start, end), period))
            self.closed[start, end] = period
        if end - start >= max(LONG, 3 * period):
            span = self._cover[start:end]
            span[np.array(self._lengths)[span] < end - start] = len(self._ends)
            self._ends.append(end)
            self._lengths.append(end - start)
            self._periods.append(period)

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs so far, by start, then period."""
        found = dict(self.closed)
        for (start, period), end in self.open.items():
            if end - start >= 2 * period:
                found[start, end] = min(period, found.get((start, end), period))
        return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def word_runs(words: list[bytes], min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``min_length`` words and ``min_exponent``
    periods or more (two at least)."""
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(word, at) for at, word in enumerate(words)], np.int64)
    if len(index) == len(words):
        return []
    catchers = Catchers()
    for at in range(0, len(ids), BATCH):
        catchers.append(ids[at : at + BATCH])
    return [r for r in catchers.runs() if r[1] >= max(min_length, min_exponent * r[2])]


def collapsed_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[at] for at in np.flatnonzero(keep)]


def periodic_runs(documents: DataFrame, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each document: its runs, by start and period,
    and its words without their repetitions, joined by single spaces (UTF-8)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            numbers, found, texts = [], [], []
            for text in batch.column("text").to_pylist():
                words = (text or b"").split()
                runs = word_runs(words, min_length, min_exponent)
                numbers.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                texts.append(b" ".join(collapsed_words(words, runs)))
            span = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(numbers, pa.int64()),
                    pa.array(found, pa.list_(span)),
                    pa.array(texts, pa.binary()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    rows = documents.selectExpr("doc_id", "cast(text AS binary) AS text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, n_words long, runs {RUNS}, collapsed binary")
