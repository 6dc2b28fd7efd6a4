"""The trained classifiers: held-out labels, folds, odd rows."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import quality, toxicity
from shelfcast.llm.common import labelled
from shelfcast.llm.queries import QUERIES

ODD = [(1, None), (2, ""), (3, " \n"), (4, "!!!"), (5, "word " * 30000), (6, "x" * 200000), (None, "some text"), (2, "")]


def odd_frame(spark):
    frame = spark.createDataFrame(ODD, "doc_id int, text string")
    return frame.withColumns({c: F.lit("z") for c in ("score", "label", "predicted", "held_out")})


@pytest.mark.parametrize(
    "name, label, modulus, rest, least",
    [("op1_quality_ftrl", "quality", 5, 0, 0.93), ("op7_toxicity_string_kernel", "toxic", 3, 1, 0.93)],
)
def test_held_out_labels(spark, sf01_dir, name, label, modulus, rest, least):
    rows = QUERIES[name](spark, sf01_dir).toPandas().set_index("doc_id")
    assert list(rows.columns) == ["held_out", "score", "predicted"]
    assert len(rows) == spark.read.parquet(f"{sf01_dir}/documents.parquet").count()
    assert rows["score"].between(0, 1).all()
    for doc_id, held_out in rows["held_out"].items():
        assert held_out == (zlib.crc32(str(doc_id).encode()) % modulus == rest)
    labels = spark.read.parquet(f"{sf01_dir}/labels.parquet").toPandas().set_index("doc_id")
    both = rows.join(labels, how="inner")
    held = both[both["held_out"]]
    assert (held["predicted"] == held[label]).mean() >= least
    positive, negative = held.loc[held[label] == 1, "score"], held.loc[held[label] == 0, "score"]
    above = (positive.to_numpy()[:, None] > negative.to_numpy()[None, :]).mean()
    assert above > 0.9  # area under the curve, from some thirty toxic training texts


def test_quality_of_odd_rows(spark):
    frame = odd_frame(spark)
    weights = np.zeros(quality.BUCKETS + 1, np.float32)
    weights[-1] = 0.5
    rows = quality.score(frame, weights, 0.3, F.lit(None).cast("boolean")).collect()
    empty = 1 / (1 + np.exp(-0.5))
    assert len(rows) == len(ODD) and all(not r.held_out for r in rows)
    assert [r.score for r in rows if r.doc_id in (1, 2, 3)] == pytest.approx([empty] * 4)
    assert quality.score(frame.limit(0), weights, 0.3, F.lit(True)).count() == 0


def test_quality_without_both_classes_is_even(spark):
    frame = spark.createDataFrame([(1, "some text", 1)], "doc_id int, text string, label int")
    assert not quality.fit(frame).any() and not quality.fit(frame.limit(0)).any()


def test_follow_the_leader_learns_and_is_sparse():
    draw = np.random.RandomState(0)
    rows = []
    for _ in range(400):
        label = int(draw.rand() < 0.5)
        buckets = np.unique(np.append(draw.randint(100, 5000, 8), label))
        rows.append((buckets, np.full(len(buckets), 1 / np.sqrt(len(buckets)), np.float32), label))
    weights = quality.follow_the_leader(rows)
    assert weights[1] > 1 and weights[0] < -1
    assert (weights == 0).mean() > 0.98


def test_shapes():
    assert quality.word_shape("Abc") == "Xx" and quality.word_shape("ABC!!") == "X!"
    assert quality.word_shape("a1-2") == "x9-9" and quality.word_shape("") == ""


def test_labelled_sample_is_bounded_and_whole_texts(spark):
    documents = spark.createDataFrame([(i, "t" * i) for i in range(50)], "doc_id int, text string")
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(50)] + [(7, 1), (8, 5), (None, 1)], "doc_id int, quality int"
    )
    got = labelled(documents, labels, "quality", F.col("doc_id") >= 10, 5).collect()
    assert len(got) == 10 and sum(r.label for r in got) == 5
    assert all(r.doc_id >= 10 and len(r.text) == r.doc_id for r in got)


def kernel_by_enumeration(a, b):
    def weights(word):
        word, out = f"\x01{word}\x02", {}
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, len(word)):
                    if k - i < toxicity.SPAN:
                        triple = word[i] + word[j] + word[k]
                        out.setdefault(triple, []).append(toxicity.DISCOUNT ** (k - i - 2))
        norm = np.sqrt(sum(w * w for ws in out.values() for w in ws))
        return {t: sum(ws) / norm for t, ws in out.items()}

    left, right = weights(a), weights(b)
    return sum(w * right.get(t, 0) for t, w in left.items())


@pytest.mark.parametrize("pair", [("idiot", "id-iot"), ("stupid", "stuupid"), ("a", "a"), ("clown", "loser")])
def test_kernel(pair):
    table = toxicity.kernel_table(pair[1])
    assert toxicity.weighed([pair[0]], table)[0] == pytest.approx(kernel_by_enumeration(*pair), rel=1e-4)


def test_words():
    assert toxicity.words_of('He said "I.D.I.O.T!" i d i o t, no') == ["he", "said", "i.d.i.o.t", "idio", "t", "no"]
    assert toxicity.words_of("a b") == ["a", "b"] and toxicity.words_of(None) == []
    assert all(len(w) <= toxicity.WORD for w in toxicity.words_of("y" * 1000))


def insults(spark, wrong=0.0):
    clean = "the river runs along green fields near old stone houses under quiet morning light"
    words, draw = clean.split(), random.Random(4)
    words += ["".join(draw.choice("aeilnorstdhm") for _ in range(draw.randrange(3, 9))) for _ in range(300)]
    rows, noise = [], random.Random(8)
    for i in range(300):
        text = [draw.choice(words) for _ in range(30)]
        if i % 3 == 0:
            text[draw.randrange(30)] = draw.choice(("gruntbag", "snorkface"))
        label = int(i % 3 == 0)
        rows.append((i, " ".join(text), 1 - label if noise.random() < wrong else label))
    return spark.createDataFrame(rows, "doc_id int, text string, label int")


def test_gapped_and_inserted_insults_are_caught(spark):
    model = toxicity.fit(insults(spark))
    highest = toxicity.Highest(model)
    texts = ["the river gruntbag runs", "the grunt-bag river", "gru.nt.bag", "snorkkface of fields", "GRUNTBAG!"]
    assert (model.probability(highest(texts)) > 0.7).all()
    fine = ["the river runs along", "quiet morning light near old houses", "", None, "12 %% 34"]
    assert (model.probability(highest(fine)) < 0.3).all()


@pytest.mark.parametrize("wrong", [0.02, 0.05])
def test_insults_are_learnt_from_labels_that_are_partly_wrong(spark, wrong):
    model = toxicity.fit(insults(spark, wrong))
    highest = toxicity.Highest(model)
    assert (model.probability(highest(["the gruntbag runs", "snork-face of fields", "GRUNT-BAG"])) > 0.7).all()
    assert (model.probability(highest(["the river runs along", "quiet morning light near old houses"])) < 0.7).all()


def test_labelled_rows_are_bounded_and_agreed(spark):
    documents = spark.createDataFrame(
        [*((1, f"copy {i}") for i in range(50)), (2, "two"), (3, "three"), (4, None), (None, "none"), (5, "five")],
        "doc_id int, text string",
    )
    labels = spark.createDataFrame(
        [(1, 1), (1, 1), (2, 0), (3, 0), (3, 1), (4, 1), (None, 1), (5, 2), (6, 0)], "doc_id int, toxic int"
    )
    rows = labelled(documents, labels, "toxic", F.lit(True), 10).collect()
    assert sorted((r.doc_id, r.label) for r in rows) == [(1, 1), (2, 0), (4, 1)]
    assert labelled(documents, labels, "toxic", F.lit(True), 1).count() <= 2
    again = labelled(documents.orderBy(F.desc("text")), labels, "toxic", F.lit(True), 10).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in rows}


def test_a_long_word_is_read_to_its_end():
    assert quality.word_shape("a" * 64 + "ABC123!!") == "xX9!"
    assert quality.word_shape("a" * 100) == "x"


def plain_ftrl(rows, epochs):
    """The recursion of one weight after the other."""
    z, n, w = {}, {}, {}
    for _ in range(epochs):
        for buckets, values, label in rows:
            x = dict(zip([*buckets.tolist(), quality.BUCKETS], [*values.tolist(), 1.0]))
            for i in x:
                zi, ni = z.get(i, 0.0), n.get(i, 0.0)
                shrunk = 0.0 if abs(zi) <= quality.L1 else zi - quality.L1 * (1 if zi > 0 else -1)
                w[i] = -shrunk / ((quality.BETA + ni**0.5) / quality.ALPHA + quality.L2)
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - label) * x[i]
                z[i] = z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / quality.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    out = {}
    for i in z:
        shrunk = 0.0 if abs(z[i]) <= quality.L1 else z[i] - quality.L1 * (1 if z[i] > 0 else -1)
        out[i] = -shrunk / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)
    return out


def test_ftrl_equals_the_plain_recursion():
    features, draw = quality.Features(), random.Random(2)
    rows = []
    for i in range(60):
        text = " ".join(draw.choice(["fine", "words", "BUY!!", "now", "x9", "river"]) for _ in range(12))
        rows.append((*features(text), i % 2))
    weights, plain = quality.follow_the_leader(rows, 3), plain_ftrl(rows, 3)
    assert len(plain) > 20 and np.flatnonzero(weights).size <= len(plain)
    for i, weight in plain.items():
        assert weights[i] == pytest.approx(weight, rel=1e-4, abs=1e-6)


def test_insults_late_in_a_run_of_letters(spark):
    highest = toxicity.Highest(toxicity.fit(insults(spark)))
    clean = " ".join("wearegladthattheriverrunspastthegarden")
    late = f"{clean} {' '.join('gruntbag')} {clean}"
    for text in (late, f"so {late} said", f"{clean} {clean} {' '.join('gruntbag')}"):
        assert "gruntbag" in toxicity.words_of(text)
        assert highest.model.probability(highest([text]))[0] > 0.7
    assert highest.model.probability(highest([clean]))[0] < 0.7


def test_toxicity_of_odd_rows(spark):
    model, frame = toxicity.fit(insults(spark)), odd_frame(spark)
    rows = toxicity.score(frame, model, 0.7, F.lit(False)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    assert toxicity.drop_toxic(frame, model, 0.7).columns == frame.columns
    assert toxicity.drop_toxic(frame, model, 0.7).count() == len(ODD)
    assert toxicity.fit(insults(spark).limit(0)) is None
    assert {r.score for r in toxicity.score(frame, None, 0.7, F.lit(False)).collect()} == {0.0}
