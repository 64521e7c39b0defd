"""Packing by power-of-two decomposition: documents are cut into pieces of binary length, and equal lengths share a bucket.

Every sequence is one piece of one document whose length is a power of two, so nothing crosses documents and nothing is
padded. A document of n tokens gives n // longest pieces of the greatest length, then one piece for each set bit of the
rest, longest first. See "Dataset Decomposition" (Pouransari et al., 2024).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidewave.llm.store import small_batches
from tidewave.llm.tokens import Encoder, drop_encoders, encoder

#: A sequence's number is that of its task, times this, and its place there.
PLACES = 1 << 40


def lengths(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of n tokens."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(docs: DataFrame, tokenizer: str | None = None, longest: int = 2048, end_id: int = 1, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of length), and
    ids (array of int) if keep_ids.

    Each document's ids end with end_id, so that a null or empty text is one piece of length 1. sequence_id is unique, and the same in
    every run over the same files and splits: a task numbers its pieces as it reads them, so no row is moved or sorted. Documents
    with equal ids, or null ids, keep their own pieces and numbers. Columns other than doc_id and text are ignored. No documents: no rows.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    path = tokenizer or default_tokenizer()
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from cut_by(encoder(path), batches)
        finally:
            drop_encoders()

    def cut_by(code: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * PLACES
        for batch in batches:
            of, n_tokens, starts, sizes, sums, ids = [], [], [], [], [], []
            for k, tokens in enumerate(code.encode(batch.column("text"))):
                tokens = np.append(tokens, np.int32(end_id)).astype("<u4")
                data, at = memoryview(tokens).cast("B"), 0
                for size in lengths(len(tokens), longest):
                    of.append(k)
                    n_tokens.append(len(tokens))
                    starts.append(at)
                    sizes.append(size)
                    sums.append(zlib.crc32(data[4 * at : 4 * (at + size)]))
                    at += size
                if keep_ids:
                    ids.append(tokens.view("<i4"))
            numbers = np.arange(number, number + len(of))
            number += len(of)
            size = np.array(sizes, np.int64)
            columns = [batch.column("doc_id").take(pa.array(of, pa.int64())), pa.array(starts, pa.int64()), pa.array(size), pa.array(sums, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(numbers), pa.array(np.zeros(len(of), np.int64)), pa.array(np.log2(size).astype(np.int32))]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"] + ["ids"] * keep_ids
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)
