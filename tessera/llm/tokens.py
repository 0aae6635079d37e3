"""Encoding of texts with a public byte-level BPE (problem 8)."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
# Fixed value: the pre-splitting pattern of the 50k byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
# No match of the pattern goes on from a visible character into white space, so a text may be cut there.
SAFE_CUT = regex.compile(r"(?<=\S)(?=\s)")

_encodings: dict[int, object] = {}


def rank_file(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """The bytes of a rank file as a broadcast variable; such files have about 50,000 lines, under 1 MB.

    The file is read by the driver only, so the workers need no copy of it.
    """
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        data = f.read()
    if len(data) > 8 << 20:
        raise ValueError(f"rank file of {len(data)} bytes; the bound is 8 MB")
    return spark.sparkContext.broadcast(data)


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def encoding(data: bytes):
    """The tiktoken encoding of a rank file's bytes; made once per process."""
    key = hash(data)
    if key not in _encodings:
        import tiktoken

        _encodings[key] = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=parse_ranks(data), special_tokens={})
    return _encodings[key]


def pieces(text: str, limit: int) -> Iterator[str]:
    """The text in pieces of about ``limit`` characters, cut only where the token ids stay the same.

    Where no such place follows within the text, the rest is one piece.
    """
    at = 0
    while len(text) - at > limit:
        cut = SAFE_CUT.search(text, at + limit)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(enc, text: str | None, limit: int = 100_000) -> list[int]:
    """Token ids without special tokens; null and empty texts have no ids ([])."""
    if not text:
        return []
    if len(text) <= limit:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text, limit) for i in enc.encode_ordinary(p)]


def decode(enc, ids: list[int]) -> str:
    """The text of ids, by way of their raw bytes, so that a character split over tokens comes out whole."""
    return b"".join(enc.decode_single_token_bytes(i) for i in ids).decode("utf-8")


def encode_documents(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids): the token ids of each row's text; [] for null and empty texts.

    Every row of the input gives one row, repeated and null doc_ids too; other columns are ignored. Ids are those of
    the whole text, however long. One pass over the texts without a shuffle.
    """
    ranks = rank_file(documents.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value)
        for b in batches:
            ids = pa.array([encode(enc, t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], names=["doc_id", "ids"])

    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(
        run, "doc_id long, ids array<int>"
    )


def token_counts(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_tokens): like encode_documents(), with the number of ids only."""
    ranks = rank_file(documents.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value)
        for b in batches:
            n = pa.array([len(encode(enc, t)) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n], names=["doc_id", "n_tokens"])

    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(
        run, "doc_id long, n_tokens long"
    )


def decode_documents(encoded: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text): the texts of encode_documents()'s rows; [] and null ids give the empty text."""
    ranks = rank_file(encoded.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value)
        for b in batches:
            texts = pa.array([decode(enc, ids or []) for ids in b.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), texts], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
