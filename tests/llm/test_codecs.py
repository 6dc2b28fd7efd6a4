"""Encoding, archives and shards: exact round trips and brute force."""

import base64
import hashlib
import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from shelfcast.llm import bpe, shards, warc
from shelfcast.llm.queries import QUERIES, byte_bpe


@pytest.fixture(scope="module")
def reference():
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ranks = {token: rank for rank, token in enumerate(tokens)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None, "", " ", "Hello  world\n\n x", "naïve 日本語 \U0001f600 ẞ", "<|endoftext|> it's 12345", "\u2581a \u2581",
    "a" * 5000, "\t\r\n\x00\x7f", "é" * 300 + "!" * 300, "word " * 20000, "\u00a0\u2003x",
]


def test_bpe_equals_the_library(spark, reference):
    rows = [(i, text, i) for i, text in enumerate(TEXTS)] + [(0, None, 0)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, ids int")
    model, pattern = byte_bpe()
    decoded = bpe.decode(bpe.encode(frame, model, pattern), model, pattern).collect()
    assert len(decoded) == len(rows)
    for row in decoded:
        text = TEXTS[row.doc_id] or ""
        assert np.frombuffer(bytes(row.ids), "<u4").tolist() == reference.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()
    assert bpe.encode(frame.limit(0), model, pattern).count() == 0


def test_bpe_of_documents(spark, sf01_dir, reference):
    rows = {r.doc_id: r for r in QUERIES["op3_byte_bpe"](spark, sf01_dir).collect()}
    for r in spark.read.parquet(f"{sf01_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = reference.encode_ordinary(r.text or "")
        got = rows[r.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_bpe_forgets_but_stays_right(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    codec = bpe.Codec(*byte_bpe())
    for text in ["one two three four five", "one six seven", "one two"] * 2:
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_warc_of_odd_pages(spark):
    big = "x" * (1 << 20)
    rows = [
        (1, "http://a/\r\nWARC-Type: x", "same"), (2, None, "same"), (3, "http://é/ä b", None), (None, "u", ""),
        (4, "u", "once"), (4, "u", "once"), (5, "u", big), (6, "u", big), (7, "u", "tail\r\n\r\nWARC/1.1\r\n"),
    ]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    pages = pages.withColumns({c: F.lit(1) for c in ("digest", "last", "payload")})
    got = sorted((tuple(r) for r in warc.archived(pages).collect()), key=str)
    want = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        last = max((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        revisit = last is not None and last != page_id
        want.append((page_id, len(payload), digest(payload), "revisit" if revisit else "response", last if revisit else None))
    assert got == sorted(want, key=str)
    short = warc.archived(pages, min_bytes=5).collect()
    assert sorted(r.page_id for r in short if r.record_type == "revisit") == [5]
    assert warc.archived(pages.limit(0)).count() == 0


def test_archive_format_and_damage():
    records = [warc.record(i, f"http://h/{i}", f"<p>page {i} {'text ' * 40}</p>".encode(), None, "2024-01-01T00:00:00Z") for i in range(300)]
    out = io.BytesIO()
    size = warc.write_archive(out, records)
    data = out.getvalue()
    assert len(data) == size < sum(map(len, records)) / 3
    assert data[:4] == bytes.fromhex("5d2a4d18")
    blocks = [block for _, block in warc.read_archive(io.BytesIO(data))]
    assert blocks == [record.partition(b"\r\n\r\n")[2][:-4] for record in records]
    # each record is a frame of its own: one can be read alone
    length = int.from_bytes(data[4:8], "little")
    import zstandard

    shared = zstandard.ZstdCompressionDict(data[8 : 8 + length])
    assert zstandard.ZstdDecompressor(dict_data=shared).decompressobj().decompress(data[8 + length :]) == records[0]
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(b"\0" * 20)))
    one = io.BytesIO()
    warc.write_archive(one, records[:1])
    assert len(list(warc.read_archive(io.BytesIO(one.getvalue())))) == 1


def brute_shards(rows, count, seed="0"):
    """{doc_id: (shard, slot)} by sorting whole lists."""
    sources = {}
    for doc_id, text, source in rows:
        own = f"{seed}:{doc_id}"
        sources.setdefault(source, []).append((hashlib.md5(own.encode()).hexdigest(), doc_id))
    ranked = []
    for source, members in sources.items():
        for rank, (key, doc_id) in enumerate(sorted(members)):
            ranked.append(((rank + 0.5) / len(members), source or "", source is None, key, doc_id))
    out, slots = {}, {}
    for place, (*_, doc_id) in enumerate(sorted(ranked)):
        shard = place * count // len(ranked)
        out[doc_id] = shard, slots.setdefault(shard, 0)
        slots[shard] += 1
    return out


def test_shards_of_documents(spark, sf01_dir):
    documents = spark.read.parquet(f"{sf01_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    got = {r.doc_id: r for r in QUERIES["op9_stratified_shards"](spark, sf01_dir).collect()}
    want = brute_shards(rows, 24)
    texts = {doc_id: (text or "").encode() for doc_id, text, _ in rows}
    assert {i: (r.shard, r.slot) for i, r in got.items()} == want
    for doc_id, row in got.items():
        assert (row.size, row.text_crc32) == (len(texts[doc_id]) + 8, zlib.crc32(texts[doc_id]))
        assert row.law == "rows" and row.grown_shard is None


def test_shards_of_odd_rows(spark):
    rows = [(i, None if i % 3 else "é", None if i % 5 == 0 else "s") for i in range(50)]
    rows += [(None, "a", "s"), (None, "a", "s"), (7, "again", "s")]
    frame = spark.createDataFrame(rows, "doc_id int, text string, source string")
    frame = frame.withColumns({c: F.lit(1) for c in ("bucket", "hash", "n", "rows", "place")})
    got = shards.assign_shards(frame, 24).collect()
    counts = np.bincount([r.shard for r in got], minlength=24)
    assert len(got) == len(rows) and counts.max() - counts.min() <= 1
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(24) for k in range(counts[s])]
    assert shards.assign_shards(frame.limit(0), 24).count() == 0
    few = shards.assign_shards(frame.limit(3), 24).collect()
    assert len(few) == 3 and all(r.slot == 0 for r in few)


def test_shards_keep_the_mixture(spark):
    rows = [(i, "t", "big" if i % 4 else "small") for i in range(2400)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = shards.assign_shards(frame, 24).join(frame.select("doc_id", "source"), "doc_id")
    parts = {(r.shard, r.source): r["count"] for r in got.groupBy("shard", "source").count().collect()}
    assert all(74 <= parts[s, "big"] <= 76 and 24 <= parts[s, "small"] <= 26 for s in range(24))
