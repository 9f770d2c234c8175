"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LETTER = re.compile(r"[^\W\d_]")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Lowers the session's limit on the bytes of an Arrow batch, so that what a Python worker gets at once does not grow with the length of texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(key))
    if not now or not 0 < int(now[1]) <= most:
        spark.conf.set(key, str(most))


def release() -> None:
    """Gives memory that a worker has freed back to the system, at the end of a task that needed much: workers live on and are reused."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator works on, under the names doc_id and text; all others are left behind, so none can clash."""
    bound_batches(df.sparkSession)
    return df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"))


def integer_ids(rows: DataFrame) -> DataFrame:
    """rows with doc_id as a long. Ids of other types raise an error, since a cast would turn them to null, and so drop their documents, in silence."""
    kind = rows.schema["doc_id"].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"ids must be integers, not {kind.simpleString()}; number the documents first")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def id_crc32(id_col: str = "doc_id") -> Column:
    """crc32 of the id written as text, the hash by which rows are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def slices_by_bytes(texts: pa.Array, max_bytes: int, max_rows: int):
    """(start, stop) ranges over a string array, each of about max_bytes of text at most, one row at least."""
    offsets = text_offsets(texts)
    start, n = 0, len(texts)
    while start < n:
        stop = start + 1
        while stop < n and stop - start < max_rows and offsets[stop + 1] - offsets[start] <= max_bytes:
            stop += 1
        yield start, stop
        start = stop


def text_offsets(texts: pa.Array):
    """Byte offsets of the rows of a string array: n + 1 integers counted from the start of its data buffer."""
    import numpy as np

    large = pa.types.is_large_string(texts.type)
    kind, width = (np.int64, 8) if large else (np.int32, 4)
    if not len(texts):
        return np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * width).astype(np.int64)


def text_buffer(texts: pa.Array):
    """All bytes of a string array as uint8, for use with text_offsets; null rows have no bytes."""
    import numpy as np

    data = texts.buffers()[2] if len(texts) else None
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
