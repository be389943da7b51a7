"""Packing by power-of-two decomposition.

A document's ids (with an end id) are cut into pieces whose lengths are powers of
two: as many of ``longest`` as fit, then the binary digits of the rest, longest
first.  Every piece is a sequence of its own, so no sequence crosses documents
and none needs padding; equal lengths share a bucket, and a batch is drawn from
one bucket.  ``write_buckets`` stores the buckets as folders.

Defined results: null or empty text is one piece, the end id alone; repeated rows
are packed each; a null id stays null; other columns are not read.

``sequence_id`` numbers the rows of each partition from the partition's own
range.  It stays the same when a lost task is run again provided the input reads
the same rows in the same order again, as a Parquet table does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.bpe import encoder, text_chunks

_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


def cut_lengths(sizes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, length) of every piece, in the documents' order."""
    doc = [np.repeat(np.arange(len(sizes)), sizes // longest)]
    length = [np.full(len(doc[0]), longest)]
    bit = longest // 2
    while bit:
        has = np.flatnonzero(sizes & bit)
        doc.append(has)
        length.append(np.full(len(has), bit))
        bit //= 2
    doc, length = np.concatenate(doc), np.concatenate(length)
    order = np.argsort(doc, kind="stable")
    return doc[order], length[order]


def _cut(tokenizer: str, end_id: int, longest: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(tokenizer, library=True)
        for b, texts in text_chunks(batches):
            ids = [x + end for x in enc.encode(texts)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            doc, length = cut_lengths(sizes, longest)
            at = np.cumsum(length) - length  # among the batch's ids
            start = at - (np.cumsum(sizes) - sizes)[doc]
            borders = pa.py_buffer(np.append(at, sizes.sum()).astype(np.int64) * 4)
            pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, borders, pa.py_buffer(b"".join(ids))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pieces, pa.array(sizes[doc])],
                ["doc_id", "start", "length", "ids", "doc_tokens"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, longest: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    pieces = rows.mapInArrow(_cut(tokenizer, end_id, longest), _PIECES)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder for each length; a reader draws batches of equal sequences from one folder."""
    packed.write.partitionBy("length").parquet(path)
