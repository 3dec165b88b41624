"""Byte-pair encoding and decoding of whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .bpe import BatchBpe
from .common import slices, whole


def vocabulary(spark: SparkSession, path: str):
    """The content of a vocabulary file on the driver, sent to the executors: a few megabytes, whatever the corpus."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encode_text(content) -> callable:
    """Text -> its ids as little-endian unsigned 32-bit integers, in one binary value."""

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = BatchBpe(content.value)
        for texts in slices(batches):
            ids, starts = codec.encode(texts.fill_null(""))
            yield pa.Array.from_buffers(
                pa.binary(), len(texts), [None, pa.py_buffer((starts * 4).astype("<i4")), pa.py_buffer(ids.astype("<u4"))]
            )

    return encode


def decode_ids(content) -> callable:
    """The reverse of encode_text."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = BatchBpe(content.value)
        for packed in slices(batches):
            part = packed.fill_null(b"").to_pylist()
            starts = np.concatenate([[0], np.cumsum([len(p) // 4 for p in part], dtype=np.int64)])
            yield pa.array(codec.decode(np.frombuffer(b"".join(part), "<u4"), starts), pa.string())

    return decode


def encoded(docs: DataFrame, path: str, text_col: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of each whole text. A null text counts as empty and has no ids; other columns stay as they are."""
    return docs.withColumn(ids, encode_text(vocabulary(docs.sparkSession, path))(whole(text_col)))


def decoded(docs: DataFrame, path: str, ids_col: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of each row's ids; null ids give the empty text. Ids must belong to the vocabulary."""
    return docs.withColumn(text, decode_ids(vocabulary(docs.sparkSession, path))(F.col(ids_col)))


def n_ids(ids: Column) -> Column:
    return F.floor(F.octet_length(ids) / 4).cast("long")
