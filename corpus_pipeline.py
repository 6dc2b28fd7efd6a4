"""A corpus pipeline: toxic documents go, one document of each group of near-copies stays,
documents with benchmark items go, personal data is replaced, and the rest is encoded.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Stages
that filter keep all columns; the last returns (doc_id, lang, source, n_tokens, ids,
lossless), where ids are little-endian unsigned 32-bit integers and ``lossless`` says that
decoding them gives the text. Empty tables and null texts pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfcast.llm import bpe, decontaminate, neardup, pii, toxicity
from shelfcast.llm.common import settled, table
from shelfcast.llm.queries import SURROGATE_KEY, TOXIC, byte_bpe, toxicity_model

#: Not expressible in SQL: trained scores, similarity components, keyed surrogates, merges.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model, TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    replaced = pii.replace_pii(docs, SURROGATE_KEY)
    return replaced.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, pattern = byte_bpe()
    encoded = bpe.encode_checked(docs, model, pattern, ["doc_id", "lang", "source"])
    n_tokens = F.expr("cast(octet_length(ids) div 4 as bigint)")
    return encoded.select("doc_id", "lang", "source", n_tokens.alias("n_tokens"), "ids", "lossless")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_pii),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name)
    return docs
