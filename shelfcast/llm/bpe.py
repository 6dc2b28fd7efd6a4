"""Byte-level BPE by a sentencepiece model that is written straight from the ranks.

A rank file (base64 bytes and rank per line) becomes a sentencepiece BPE model: each
token's bytes are mapped to one printable character a byte, its score is the negative
rank, and the normaliser is the identity. Sentencepiece then merges the pair with the
lowest rank first, leftmost first, as byte-level BPE does. Each match of the splitting
pattern is encoded separately; a match that is itself a token is that token. Decoding
maps ids back to pieces and characters back to bytes.

Defined results: a null or empty text has no ids and decodes to no bytes. Ids are packed
as little-endian unsigned 32-bit integers. Repeated rows are encoded alike; columns other
than the id and the text are neither read nor returned.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from .common import slices

NORMAL, UNKNOWN = 1, 2
BPE_MODEL = 2
UNKNOWN_PIECE = "<unk>"
CACHED = 100_000  # pre-tokens that a task remembers; more are encoded again
CACHED_CHARS = 64


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in the order of their ranks 0, 1, ..."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks are not 0 to {len(ranks) - 1}")
    return [ranks[rank] for rank in range(len(ranks))]


def byte_characters() -> list[str]:
    """A printable character for each byte: itself, or the next one from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(byte if byte in printable else next(others)) for byte in range(256)]


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks; then the unknown piece."""
    to_character = byte_characters()

    def piece(text: str, score: float, kind: int) -> bytes:
        score_field = _varint(2 << 3 | 5) + struct.pack("<f", score)
        return _block(1, _block(1, text.encode()) + score_field + _number(3, kind))

    pieces = [
        piece("".join(to_character[byte] for byte in token), -rank, NORMAL)
        for rank, token in enumerate(tokens)
    ]
    pieces.append(piece(UNKNOWN_PIECE, 0.0, UNKNOWN))
    none = (1 << 64) - 1  # -1: the model has no such piece
    trainer = _number(3, BPE_MODEL) + _number(4, len(pieces)) + _number(40, len(tokens))
    trainer += b"".join(_number(field, none) for field in (41, 42, 43))
    trainer += _block(45, UNKNOWN_PIECE.encode())
    normalizer = _block(1, b"identity") + b"".join(_number(field, 0) for field in (3, 4, 5))
    return b"".join(pieces) + _block(2, trainer) + _block(3, normalizer)


class Codec:
    """Encodes and decodes with one model; made anew in each task."""

    def __init__(self, model: bytes, pattern: str) -> None:
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        to_character = byte_characters()
        to_byte = {character: byte for byte, character in enumerate(to_character)}
        self.characters = "".join(to_character)
        names = self.pieces.id_to_piece(list(range(self.pieces.unk_id())))
        self.bytes = [bytes(map(to_byte.__getitem__, name)) for name in names]
        self.ids = {token: struct.pack("<I", i) for i, token in enumerate(self.bytes)}
        self.known: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        """The packed ids of a whole text."""
        parts = self.split(text or "")
        known = self.known
        missing = {part for part in parts if part not in known}
        own = known if len(known) + len(missing) <= CACHED else dict(known)
        rest = []
        for part in missing:
            token = self.ids.get(part.encode())
            if token is None:
                rest.append(part)
            else:
                own[part] = token
        mapped = [part.encode().decode("latin-1").translate(self.characters) for part in rest]
        for part, ids in zip(rest, self.pieces.encode(mapped, num_threads=1) if mapped else ()):
            own[part] = struct.pack(f"<{len(ids)}I", *ids)
        packed = b"".join([own[part] for part in parts])
        if own is not known:
            known.clear()
        for part in missing:
            if len(part) > CACHED_CHARS:
                known.pop(part, None)
        return packed

    def decode(self, packed: bytes | None) -> bytes:
        ids = np.frombuffer(packed or b"", "<u4").tolist()
        return b"".join(map(self.bytes.__getitem__, ids))


def _mapped(
    frame: DataFrame, column: str, made: str, model: bytes, pattern: str,
    of: Callable[[Codec], Callable], keep: list[str],
) -> DataFrame:
    shared = frame.sparkSession.sparkContext.broadcast(model)
    fields = [frame.schema[name] for name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = of(Codec(shared.value, pattern))
        for batch in slices(batches):
            values = [each(value.as_py()) for value in batch.column(column)]
            kept = [batch.column(name) for name in keep]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(values, pa.binary())], [*keep, made]
            )

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{made} binary"])
    return frame.select(*keep, *([] if column in keep else [column])).mapInArrow(run, schema)


def encode(
    documents: DataFrame, model: bytes, pattern: str, keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """The kept columns and ``ids``: the packed ids of each whole text."""
    return _mapped(documents, "text", "ids", model, pattern, lambda codec: codec.encode, [*keep])


def decode(
    encoded: DataFrame, model: bytes, pattern: str, keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """The kept columns, ``ids``, and ``decoded``: the bytes that the ids stand for."""
    return _mapped(
        encoded, "ids", "decoded", model, pattern, lambda codec: codec.decode, [*keep, "ids"]
    )


def encode_checked(
    documents: DataFrame, model: bytes, pattern: str, keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """The kept columns, ``ids``, and ``lossless``: whether decoding the ids gives the text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, pattern)
        for batch in slices(batches):
            ids, lossless = [], []
            for text in batch.column("text").to_pylist():
                ids.append(codec.encode(text))
                lossless.append(codec.decode(ids[-1]) == (text or "").encode())
            kept = [batch.column(name) for name in keep]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(ids, pa.binary()), pa.array(lossless)], [*keep, "ids", "lossless"]
            )

    kept = [f"`{name}` {documents.schema[name].dataType.simpleString()}" for name in keep]
    return documents.select(*keep, "text").mapInArrow(
        run, ", ".join([*kept, "ids binary", "lossless boolean"])
    )
