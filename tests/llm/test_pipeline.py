"""The pipeline stage by stage, and the guard of the entry module."""

import importlib.util
import subprocess
import sys
from pathlib import Path

import numpy as np
import tiktoken
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from shelfcast.llm import bpe, decontaminate
from shelfcast.llm.common import settled
from tests.llm.test_neardup import brute


def test_stages_on_documents(spark, sf01_dir):
    docs = spark.read.parquet(f"{sf01_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = settled(stage(spark, docs, sf01_dir), name)
        kept[name] = before, docs
        if name != "byte_bpe":
            assert docs.columns == columns
    labels = spark.read.parquet(f"{sf01_dir}/labels.parquet")
    before, after = kept["toxicity"]
    gone = before.join(after, "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.where("toxic = 0").count() == 0 and gone.count() >= 0.7 * labels.where("toxic = 1").count()

    before, after = kept["near_duplicates"]
    leaders = brute([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(leaders.values()))

    before, after = kept["decontamination"]
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{sf01_dir}/benchmark.parquet").collect()]
    clean = [
        r.doc_id for r in before.collect()
        if not any(f" {' '.join(i)} " in f" {' '.join(decontaminate.words_of(r.text))} " for i in items)
    ]
    assert sorted(r.doc_id for r in after.collect()) == sorted(clean)

    before, after = kept["pii"]
    texts = {r.doc_id: r for r in after.collect()}
    assert before.count() == len(texts) and all(r.n_chars == len(r.text) for r in texts.values())

    rows = kept["byte_bpe"][1].collect()
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert len(rows) == len(texts)
    for row in rows:
        assert row.lossless and np.frombuffer(bytes(row.ids), "<u4").tolist() == library.encode_ordinary(texts[row.doc_id].text)


def test_stages_on_odd_and_empty_rows(spark, sf01_dir):
    docs = spark.read.parquet(f"{sf01_dir}/documents.parquet")
    odd = docs.limit(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema))
    for frame in (docs.limit(0), odd, docs.limit(3).unionByName(docs.limit(3)).unionByName(odd)):
        n = frame.count()
        for name, stage in corpus_pipeline.STAGES:
            frame = settled(stage(spark, frame, sf01_dir), name)
        assert frame.count() <= n


def test_entry_without_the_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[2]
    for part in ("shelfcast", "__spark_entry__.py"):
        if (root / part).is_dir():
            import shutil

            shutil.copytree(root / part, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            (tmp_path / part).write_text((root / part).read_text())
    code = "import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']; print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert importlib.util.find_spec("shelfcast.llm") is not None
