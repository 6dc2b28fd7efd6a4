"""Quality rules with risk-controlled thresholds.

Every rule compares a signal of the text with a cutoff and rejects what lies above; a
document is kept if no rule rejects it. The cutoffs are not set by hand: for each stratum
(language), each setting of all rules together (a cutoff of its grid, or off, for each) is
tested on the labelled good documents of the stratum. With k of n good documents rejected
by any rule, a setting passes if Binomial(n, RISK) gives k or fewer with a probability of
at most ``ERROR`` / number of tests (Bonferroni over strata and settings); that is the same
as an exact upper bound on the rejection rate below RISK. Of the settings that pass, the one
that rejects most labelled bad documents holds; of equals, the one that rejects fewest good
ones, then the one with the lower cutoffs. With all rules off nothing is rejected, so that
needs no test. So with probability 1 - ERROR the verdict rejects no more than RISK of the
good documents in any stratum. The bound is one on independent documents: where labelled
texts repeat each other it is weaker.

Only counts leave the executors, at most one a (stratum, level of each rule): all labelled
rows count, and an id labelled both good and bad does not.

Defined results: a null or empty text has no words and fails the base rules. A null
language is a stratum of its own; a stratum without labels has no rules. Repeated rows are
judged alike, and count as often as they are labelled. Empty labels switch all rules off.
Columns besides doc_id, text and lang are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import settled

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
RISK, ERROR = 0.02, 0.05
UNKNOWN = "\0"

# Signals as SQL over the counts, and the cutoffs to test, from strict to lenient.
RULES = {
    "symbols_per_char": ("n_symbols / greatest(word_chars, 1)", (0.02, 0.05, 0.1, 0.2)),
    "dup_lines_per_word": ("n_dup_lines / greatest(n_words, 1)", (0.005, 0.01, 0.02, 0.05)),
    "repeated_words": ("n_repeat_words / greatest(n_words, 1)", (0.05, 0.1, 0.2, 0.35)),
    "upper_per_word": ("n_upper / greatest(n_words, 1)", (0.1, 0.2, 0.4, 0.6)),
    "marks_per_word": ("n_marks / greatest(n_words, 1)", (0.1, 0.25, 0.5, 1.0)),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of a whole text, in the order of ``COUNTS``.

    A word is a run without ASCII white space. Words of a three-word window that is
    found more than once count as repeated, in all its places.
    """
    text = text or ""
    words = text.encode().split()
    seen: set[str] = set()
    repeated_lines = 0
    for line in text.split("\n"):
        if line in seen:
            repeated_lines += 1
        elif line.strip(SPACES):
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    repeated = 0
    if len(times) < len(windows):
        covered_to = 0
        for at, window in enumerate(windows):
            if times[window] > 1:
                repeated += at + 3 - max(at, covered_to)
                covered_to = at + 3
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    upper = sum(map(str.isupper, text.split()))
    return len(words), chars, symbols, repeated_lines, repeated, upper, text.count("!")


def _counted(documents: DataFrame, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_counts(text.as_py()) for text in batch.column("text")]
            columns = [pa.array(column, pa.int64()) for column in zip(*rows)] or [
                pa.array([], pa.int64()) for _ in COUNTS
            ]
            kept = [batch.column(name) for name in keep]
            yield pa.RecordBatch.from_arrays([*kept, *columns], [*keep, *COUNTS])

    types = [f"`{name}` {documents.schema[name].dataType.simpleString()}" for name in keep]
    return documents.select(*keep, "text").mapInArrow(
        run, ", ".join(types + [f"{name} long" for name in COUNTS])
    )


def _base_failed() -> Column:
    repeated = 100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    return (F.col("n_words") < MIN_WORDS) | repeated


def at_most(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), exactly summed."""
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
        + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(min(k, n) + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def levels(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, a level for each rule, good, bad): how many labelled documents exceed that
    many of the rule's cutoffs, for each rule."""
    known = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("quality").alias("other")
    )
    known = known.where("quality = other").select("doc_id", "quality")
    exceeded = [
        sum((F.when(F.expr(signal) > cutoff, 1).otherwise(0) for cutoff in cutoffs), F.lit(0)).alias(rule)
        for rule, (signal, cutoffs) in RULES.items()
    ]
    passed = counted.where(~_base_failed()).select("doc_id", "stratum", *exceeded)
    return passed.join(known, "doc_id").groupBy("stratum", *RULES).agg(
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")
    )


def most_rejected(n: int, risk: float, error: float) -> int:
    """The greatest k that passes the test, -1 if none does."""
    return bisect_right(range(n + 1), error, key=lambda k: at_most(k, n, risk)) - 1


def chosen(frame: pd.DataFrame, risk: float, error: float) -> list[float | None]:
    """A cutoff or None for each rule, from the levels of one stratum."""
    shape = [len(cutoffs) + 1 for _, cutoffs in RULES.values()]
    places = tuple(frame[rule].to_numpy() for rule in RULES)
    rejected = {}
    for label in ("good", "bad"):
        kept = np.zeros(shape, np.int64)
        np.add.at(kept, places, frame[label].to_numpy())
        n = int(kept.sum())
        for axis in range(kept.ndim):  # setting i of a rule keeps the levels 0 to i
            kept = kept.cumsum(axis)
        rejected[label] = n - kept
    n = int(frame["good"].sum())
    passed = rejected["good"] <= (most_rejected(n, risk, error) if n else -1)
    passed[tuple(size - 1 for size in shape)] = True  # all off
    settings = zip(*np.nonzero(passed))
    best = min(settings, key=lambda s: (-rejected["bad"][s], rejected["good"][s], sum(s), s))
    return [cutoffs[i] if i < len(cutoffs) else None for i, (_, cutoffs) in zip(best, RULES.values())]


def certify(counts: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, then a cutoff or null for each rule) from the counts of ``levels``.

    A group is a stratum, with at most as many rows as there are settings.
    """
    settings = math.prod(len(cutoffs) + 1 for _, cutoffs in RULES.values()) - 1
    tests = settings * max(1, counts.select("stratum").distinct().count())

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        row = {"stratum": frame["stratum"].iloc[0], **dict(zip(RULES, chosen(frame, risk, error / tests)))}
        return pd.DataFrame([row]).astype({rule: float for rule in RULES})

    return counts.groupBy("stratum").applyInPandas(
        run, ", ".join(["stratum string", *(f"{rule} double" for rule in RULES)])
    )


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, the counts, base_failed, kept, failed_rules) of each row."""
    columns = documents.select(
        "doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("stratum")
    )
    counted = settled(_counted(columns, ["doc_id", "stratum"]), "counts")
    counts = settled(levels(counted, labels), "levels")
    cutoffs = settled(certify(counts), "cutoffs")
    failed = F.array_compact(
        F.array(*(F.when(F.expr(signal) > F.col(rule), F.lit(rule)) for rule, (signal, _) in RULES.items()))
    )
    judged = (
        counted.join(cutoffs, "stratum", "left")
        .withColumn("base_failed", _base_failed())
        .withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "failed_rules")
