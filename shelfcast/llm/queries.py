"""The registered queries of the operators, with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import audit, bpe, decontaminate, jaccard, neardup, pii, quality, risk, runs, shards
from . import toxicity, urls, warc
from .common import id_remainder, labelled, slices, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_quality_ftrl(spark, sf_dir):
    documents, fold = table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 5)
    labels = table(spark, sf_dir, "labels")
    sample = labelled(documents, labels, "quality", fold != 0, quality.PER_CLASS)
    return quality.score(documents, quality.fit(sample), 0.3, fold == 0)


SURROGATE_KEY = "shelfcast"


@query
def op2_pii_surrogates(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_pii(documents, SURROGATE_KEY)


def byte_bpe() -> tuple[bytes, str]:
    """The model and the splitting pattern of the public byte-level vocabulary."""
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.sentencepiece_model(tokens), public_tokenizers.PATTERN


@query
def op3_byte_bpe(spark, sf_dir):
    model, pattern = byte_bpe()
    ids = bpe.encode(table(spark, sf_dir, "documents"), model, pattern)
    return bpe.decode(ids, model, pattern).select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op4_risk_controlled_rules(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return risk.judge(documents, labels)


URL_RULES = [
    ("com/", urls.ALLOW),
    ("example.com/en/", urls.BLOCK),
    ("www.example.com/en/", urls.ALLOW),
    ("net/es/", urls.BLOCK),
    ("net/fr/", urls.BLOCK),
]


@query
def op5_url_ngram_filter(spark, sf_dir):
    model = urls.fit(urls.labelled_urls(spark))
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES, model)


@query
def op6_decontaminate_wand(spark, sf_dir):
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    matched = decontaminate.matched_items(documents, benchmark)
    return matched.where(F.size("items") > 0)


def toxicity_model(documents: DataFrame, labels: DataFrame) -> toxicity.Model | None:
    fold = id_remainder(F.col("doc_id"), 3)
    return toxicity.fit(labelled(documents, labels, "toxic", fold != 1, toxicity.PER_CLASS))


TOXIC = 0.7


@query
def op7_toxicity_string_kernel(spark, sf_dir):
    documents, fold = table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 3)
    model = toxicity_model(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, model, TOXIC, fold == 1)


@query
def op8_warc_dictionary(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages"), min_bytes=0)


ORACLE["op8_warc_dictionary"] = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
last_ids AS (SELECT payload, max(page_id) AS last_id FROM payloads GROUP BY payload),
hashed AS (
    SELECT page_id, payload, last_id, sha1(payload) AS digest
    FROM payloads JOIN last_ids USING (payload)
)
SELECT
    page_id,
    CAST(strlen(payload) AS BIGINT) AS payload_bytes,
    list_aggregate(
        list_transform(
            range(32),
            lambda i: substr(
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((CAST('0x' || substr(digest, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT)
                    >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1,
                1
            )
        ),
        'string_agg', ''
    ) AS payload_digest,
    CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> last_id THEN last_id END AS refers_to
FROM hashed
"""


@query
def op9_stratified_shards(spark, sf_dir):
    return shards.assign_shards(table(spark, sf_dir, "documents"), 24)


@query
def op10_minhash_multi_index(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)


def looped_words(words: list[bytes], doc_id: int) -> list[bytes]:
    """The words, in one of ten documents with a tail that repeats its first words."""
    number = zlib.crc32(str(doc_id).encode())
    if number % 10 or not words:
        return words
    number //= 10
    first = number % len(words)
    period = 1 + (len(words) - first) // (3 + number % 8)
    return [*words[:first], *(words[first + at % period] for at in range(len(words) - first))]


def looped_tails(documents: DataFrame) -> DataFrame:
    """(doc_id, text): the words of each document as ``looped_words`` has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for at, (doc_id, text) in enumerate(zip(ids, texts)):
                if doc_id is not None and text is not None:
                    words = text.split()
                    looped = looped_words(words, doc_id)
                    texts[at] = text if looped is words else b" ".join(looped)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "text"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text binary")


@query
def op11_periodic_runs(spark, sf_dir):
    found = runs.periodic_runs(looped_tails(table(spark, sf_dir, "documents")), 6, 4)
    line = "concat_ws(',', r.start, r.length, r.period) || '\\n'"
    # Of the longest the first: runs are in order of start and period.
    longest = "try_element_at(filter(runs, r -> r.length = array_max(runs.length)), 1)"
    return found.withColumn("longest", F.expr(longest)).selectExpr(
        "doc_id",
        "cast(size(runs) AS bigint) AS n_runs",
        "longest.start AS start",
        "longest.length AS length",
        "longest.period AS period",
        "1000 * longest.length div longest.period AS exponent_milli",
        f"sha2(array_join(transform(runs, r -> {line}), ''), 256) AS runs_sha256",
        "sha2(collapsed, 256) AS collapsed_sha256",
    )


@query
def op12_ngram_jaccard_join(spark, sf_dir):
    return jaccard.ngram_join(table(spark, sf_dir, "documents"), n=4, percent=85)


@query
def op13_filter_interactions(spark, sf_dir):
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE["op13_filter_interactions"] = r"""
WITH texts AS (
    SELECT
        doc_id, coalesce(text, '') AS body, coalesce(source, '') AS part,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
),
firsts AS (SELECT body, min(doc_id) AS first FROM texts GROUP BY body),
marks AS (
    SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic
    FROM labels GROUP BY doc_id
),
masked AS (
    SELECT
        part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CAST(len(words) < 50 AS INT)
        + 2 * CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INT)
        + 4 * CAST(100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body) AS INT)
        + 8 * CAST(regexp_matches(body, '[#$%&*|]') AS INT)
        + 16 * CAST(coalesce(doc_id > first, false) AS INT) AS mask
    FROM texts JOIN firsts USING (body) LEFT JOIN marks USING (doc_id)
),
counted AS (
    SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
    FROM masked GROUP BY part, mask
),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(letter, bit)),
orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
      AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
),
steps AS (
    SELECT
        filter_order, step, bit,
        CAST(coalesce((
            SELECT sum(before.bit) FROM letters before
            WHERE instr(substr(filter_order, 1, CAST(step AS INT) - 1), before.letter) > 0
        ), 0) AS INT) AS earlier
    FROM orders, range(1, 6) s(step) JOIN letters ON letter = substr(filter_order, CAST(step AS INT), 1)
),
audited AS (
    SELECT
        part, filter_order, step, bit,
        sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & earlier > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM counted, steps GROUP BY part, filter_order, step, bit
)
SELECT
    part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept,
    CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM audited
"""
