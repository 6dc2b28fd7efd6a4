"""Toxicity: a subsequence string-kernel SVM with Nyström landmarks over words.

The kernel of two words counts their common subsequences of three characters, with gaps of
up to three inserted characters, each gap at a discount; so ``id-iot``, ``idi0ot`` and
inflected forms stay close to ``idiot``. A run of single letters (``i d i o t``) hides where
its words end, so it is read as all its pieces of ``RUN`` letters, however long it is; a
long word is read as overlapping pieces.

Training takes labelled texts, at most ``PER_CLASS`` of each class. A toxic text is toxic
by some of its words, so first the words are found that stand in toxic texts more often
than chance allows, in how many different contexts, and hardly in clean ones. They train the machine
against words of clean texts, first a sample, then those that score highest. Landmarks are
picked greedily by what the earlier ones leave unexplained (pivoted Cholesky). The Nyström
features are linear in the subsequences, so the machine is folded into one weight for each
subsequence, and scoring a word costs as many look-ups as it has subsequences. A text's
score is the logistic function, fitted on the sample, of its highest word score.

Defined results: a null or empty text, and one without letters, has the lowest score.
Where no word passes the test (as without labels) all scores are 0. Repeated rows score
alike. Only the id and the text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import keep_rows, settled

PER_CLASS = 3000
POSITIVES, NEGATIVES, HARD = 600, 4000, 2000
LANDMARKS = 128
SPAN, DISCOUNT = 6, 0.6
WORD, STEP = 24, 12  # longer words are cut into pieces of WORD characters, STEP apart
RUN = range(5, 13)  # sizes of the pieces of a run of single letters
CODES = 64
RIDGE = 0.001
PURE = 0.8  # of an insult's contexts that are toxic, at least
CACHED = 100_000
_GAPS = [(i, i + j) for i in range(1, SPAN - 1) for j in range(1, SPAN - i)]
_TABLE = CODES**3


def words_of(text: str | None) -> list[str]:
    """Words in lower case, without signs at the ends, in order."""
    found: list[str] = []
    letters: list[str] = []
    for raw in (text or "").lower().split():
        if len(raw) == 1 and raw.isalpha():
            letters.append(raw)
        elif letters:
            found += _run_words(letters)
            letters = []
        word = raw if raw.isalpha() else _trimmed(raw)
        if not word or len(raw) == 1:
            continue
        if len(word) <= WORD:
            found.append(word)
        else:
            found += [word[at : at + WORD] for at in range(0, len(word) - STEP, STEP)]
    return found + _run_words(letters)


def _run_words(letters: list[str]) -> list[str]:
    """What a run of single letters may say: a word if it is short, else all its pieces.

    A word within a piece of other letters scores low, so pieces have all sizes and places.
    """
    if len(letters) <= RUN[0]:
        return ["".join(letters)] if len(letters) > 2 else letters
    run = "".join(letters)
    return [run[at : at + size] for size in RUN for at in range(len(run) - size + 1)]


def _trimmed(raw: str) -> str:
    first, last = 0, len(raw)
    while first < last and not raw[first].isalpha():
        first += 1
    while last > first and not raw[last - 1].isalpha():
        last -= 1
    return raw[first:last]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all three-character subsequences, and their weights, a row a word.

    A row has length 1 in weights; places that a word doesn't have weigh 0. Word ends
    count as characters.
    """
    width = WORD + 2
    flat = "".join([f"\x01{word[:WORD]}\x02".ljust(width, "\0") for word in words])
    points = np.frombuffer(flat.encode("utf-32-le", "replace"), np.uint32).reshape(-1, width)
    codes = np.where(points > 2, 3 + points % 61, points).astype(np.uint32)
    present = points > 0
    columns, weights = [], []
    for second, third in _GAPS:
        last = width - third
        code = (codes[:, :last] * CODES + codes[:, second : last + second]) * CODES
        columns.append(code + codes[:, third:])
        weights.append(np.where(present[:, third:], np.float32(DISCOUNT ** (third - 2)), np.float32(0)))
    weight = np.concatenate(weights, 1)
    norm = np.sqrt((weight**2).sum(1, keepdims=True))
    return np.concatenate(columns, 1), weight / np.maximum(norm, 1e-6)


def weighed(words: list[str], table: np.ndarray) -> np.ndarray:
    """Sum of the table's entries over each word's subsequences."""
    out = np.empty(len(words), np.float32)
    for at in range(0, len(words), 4096):
        codes, weights = subsequences(words[at : at + 4096])
        out[at : at + 4096] = (table[codes] * weights).sum(1)
    return out


def kernel_table(word: str) -> np.ndarray:
    """A word's subsequences as a table: ``weighed(words, kernel_table(w))`` is the kernel."""
    codes, weights = subsequences([word])
    return np.bincount(codes[0], weights[0], _TABLE).astype(np.float32)


def _landmarks(words: list[str], wanted: int) -> tuple[list[int], np.ndarray]:
    """Places of the landmarks, and the kernel of all words with them."""
    own = np.array([kernel_table_norm(word) for word in words])
    left, picked, columns = own.copy(), [], []
    factor = np.zeros((len(words), 0))
    while len(picked) < min(wanted, len(words)):
        at = int(left.argmax())
        if left[at] < 1e-3:
            break
        column = weighed(words, kernel_table(words[at])).astype(float)
        step = (column - factor @ factor[at]) / math.sqrt(left[at])
        factor = np.column_stack([factor, step])
        left = np.maximum(left - step**2, 0)
        left[at] = 0
        picked.append(at)
        columns.append(column)
    return picked, np.column_stack(columns)


def kernel_table_norm(word: str) -> float:
    codes, weights = subsequences([word])
    _, inverse = np.unique(codes[0], return_inverse=True)
    return float((np.bincount(inverse, weights[0]) ** 2).sum())


def support_vector_machine(words: list[str], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """(table, intercept) of the L2 machine over Nyström features, classes weighed alike.

    Newton steps on the squared hinge: each solves for the words inside the margin.
    """
    positive = [i for i, label in enumerate(labels) if label]
    negative = [i for i, label in enumerate(labels) if not label]
    chosen: list[int] = []
    for places in (positive, negative):
        picked, _ = _landmarks([words[i] for i in places[:2500]], LANDMARKS // 2)
        chosen += [places[i] for i in picked]
    tables = [kernel_table(words[i]) for i in chosen]
    kernel = np.column_stack([weighed(words, table) for table in tables]).astype(float)
    values, vectors = np.linalg.eigh(kernel[chosen] + 1e-6 * np.eye(len(chosen)))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    features = np.column_stack([kernel @ root, np.ones(len(words))])
    signs = np.where(labels > 0, 1.0, -1.0)
    costs = np.where(labels > 0, len(words) / max(1, len(positive)), len(words) / max(1, len(negative)))
    costs /= len(words)
    ridge = RIDGE * np.eye(features.shape[1])
    ridge[-1, -1] = 1e-9
    weights = np.zeros(features.shape[1])
    inside = np.ones(len(words), bool)
    for _ in range(50):
        f = features[inside]
        weights = np.linalg.solve(ridge + f.T @ (f * costs[inside, None]), f.T @ (signs * costs)[inside])
        now = signs * (features @ weights) < 1
        if (now == inside).all():
            break
        inside = now
    table = sum(a * t for a, t in zip(root @ weights[:-1], tables))
    return table.astype(np.float32), float(weights[-1])


@dataclass
class Model:
    """One weight for each subsequence, and the logistic function's two numbers."""

    table: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, highest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * highest + self.shift, -30, 30)))


class Highest:
    """The highest word score of a text; remembers the scores of words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[str, float] = {}

    def __call__(self, texts) -> np.ndarray:
        out: list[float] = []
        for own in self._word_sets(texts):
            if len(self.known) > CACHED:
                self.known.clear()
            known = self.known
            missing = [word for word in set().union(*own) if word not in known]
            scores = weighed(missing, self.model.table) + self.model.intercept
            known.update(zip(missing, scores.tolist()))
            out += [max(map(known.__getitem__, words), default=self.model.intercept - 1) for words in own]
        return np.array(out, float)

    @staticmethod
    def _word_sets(texts) -> Iterator[list[set[str]]]:
        """The texts' words, of at most 256 texts and of few if they have many words."""
        own: list[set[str]] = []
        for text in texts:
            own.append(set(words_of(text)))
            if len(own) == 256 or len(own[-1]) > CACHED // 10:
                yield own
                own = []
        if own:
            yield own


def _contexts(sample: DataFrame) -> DataFrame:
    """(word, toxic, clean): different words that stand before it in texts of the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
                words = words_of(text.as_py())
                pairs = list(set(zip(words, ["", *words])))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([word for word, _ in pairs], pa.string()),
                        pa.array([before for _, before in pairs], pa.string()),
                        pa.array([label] * len(pairs), pa.int32()),
                    ],
                    ["word", "before", "label"],
                )

    pairs = sample.select("text", "label").mapInArrow(run, "word string, before string, label int")
    contexts = pairs.groupBy("word", F.xxhash64("before").alias("before")).agg(
        F.max("label").alias("toxic"), F.max(1 - F.col("label")).alias("clean")
    )
    return contexts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _insults(words: DataFrame) -> Column:
    """Which words are toxic by more than chance: true for a few, also if labels are wrong.

    If words stood in either class at random, less than one of all would have a share of
    toxic contexts that is as large for its number of contexts (Chernoff's bound of the
    binomial tail). And that share must be ``PURE`` or more: clean contexts, as of wrong
    labels or quotations, count against a word but don't rule it out.
    """
    toxic, clean, known = words.agg(F.sum("toxic"), F.sum("clean"), F.count("*")).first()
    if not toxic or not clean:
        return F.lit(False)
    base = toxic / (toxic + clean)
    number = F.col("toxic") + F.col("clean")
    share = F.col("toxic") / number
    apart = share * F.log(share / base) + F.when(
        F.col("clean") > 0, (1 - share) * F.log((1 - share) / (1 - base))
    ).otherwise(0.0)
    strong = number * apart >= math.log(known)
    return F.coalesce((F.col("toxic") >= 3) & (share >= max(PURE, (1 + base) / 2)) & strong, F.lit(False))


def _logistic(highest: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift, by Newton's method with a little ridge."""
    x = np.column_stack([highest, np.ones(len(highest))])
    weights = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - labels) + 0.01 * weights
        curve = x.T @ (x * (p * (1 - p))[:, None]) + 0.01 * np.eye(2)
        weights = weights - np.linalg.solve(curve, gradient)
    return float(weights[0]), float(weights[1])


def fit(sample: DataFrame) -> Model | None:
    """A model from a bounded sample (doc_id, text, label); None where nothing is learnt."""
    sample = settled(sample, "labelled")
    words = settled(_contexts(sample), "words")
    judged = words.withColumn("insult", _insults(words))
    # Bounded lists: the strongest words, a sample by hash, and the highest scored.
    insults = judged.where("insult")
    insults = [r.word for r in insults.orderBy(F.desc("toxic"), "word").limit(POSITIVES).collect()]
    clean = judged.where("clean > 0 AND NOT insult")
    others = [r.word for r in clean.orderBy(F.xxhash64("word"), "word").limit(NEGATIVES).collect()]
    if not insults or not others:
        return None

    def machine(negatives: list[str]) -> Model:
        labels = np.array([1] * len(insults) + [0] * len(negatives))
        return Model(*support_vector_machine([*insults, *negatives], labels))

    model = machine(others)
    word_score = F.pandas_udf(_word_scores(model), "double")
    hard = clean.select("word", word_score("word").alias("score"))
    hard = [r.word for r in hard.orderBy(F.desc("score"), "word").limit(HARD).collect()]
    model = machine([*hard, *(word for word in others if word not in set(hard))])
    highest = F.pandas_udf(_highest(model), "double")
    seen = sample.select("label", highest("text").alias("highest")).toPandas()
    model.slope, model.shift = _logistic(seen["highest"].to_numpy(), seen["label"].to_numpy(float))
    return model


def _word_scores(model: Model):
    def run(words: pd.Series) -> pd.Series:
        return pd.Series(weighed(words.tolist(), model.table).astype(float))

    return run


def _highest(model: Model):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        highest = Highest(model)
        for texts in batches:
            yield pd.Series(highest(texts.tolist()))

    return run


def scorer(model: Model | None):
    """A column function: text to the probability of being toxic."""
    if model is None:
        return lambda text: F.lit(0.0)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        highest = Highest(model)
        for texts in batches:
            yield pd.Series(model.probability(highest(texts.tolist())))

    return F.pandas_udf(run, "double")


def score(documents: DataFrame, model: Model | None, threshold: float, held_out: Column) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    probability = scorer(model)
    scored = documents.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        probability(F.col("text")).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(documents: DataFrame, model: Model | None, threshold: float) -> DataFrame:
    """Documents below the threshold, columns unchanged."""
    if model is None:
        return documents

    def judge():
        highest = Highest(model)
        return lambda texts: model.probability(highest(texts)) < threshold

    return keep_rows(documents, judge)
