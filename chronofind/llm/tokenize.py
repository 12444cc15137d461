"""Encoding of a whole corpus with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofind.llm.bpe import encoder

#: Texts are turned into ids by so many characters at once, so that long texts don't pile up.
_BLOCK_CHARS = 4_000_000


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size > _BLOCK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids ARRAY<INT>: one row for each document, in place, without a shuffle.

    path: a vocabulary file that every executor can open. Empty and null texts give an empty list; blank
    texts are encoded as they are; names of special tokens in a text are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(path).encode_all
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, end in _blocks(texts):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, end - start), encode_all(texts[start:end])], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of encoded documents; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode_ids = encoder(path).decode
        for batch in batches:
            texts = pa.array([decode_ids(ids or []) for ids in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def token_counts(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens."""
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"))
