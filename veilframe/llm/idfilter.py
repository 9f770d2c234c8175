"""Keeping texts that a join does not need out of its shuffle.

Up to MOST ids a Bloom filter is broadcast whose size follows their count (two bytes an id, 16 MB at most); beyond
that a join on the ids takes its place. Either only spares work: what a filter lets through by chance is settled by
the join behind it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.shingles import mix64
from veilframe.llm.textio import bound_batches, release

#: Takes some rows out of a batch.
Keep = Callable[[pa.RecordBatch], pa.RecordBatch]
#: Ids up to which a filter is broadcast.
MOST = 1 << 23
#: Ids up to which the driver fills the filter itself, from the ids (8 bytes each, 1 MB in all).
FEW = 1 << 17


def filter_bits(n: int) -> int:
    """Logarithm of the bits of a filter for n ids."""
    return max(16, (8 * n).bit_length())


def _fill(table: np.ndarray, ids: np.ndarray, bits: int) -> np.ndarray:
    for spot in _spots(np.unique(ids), bits):
        np.bitwise_or.at(table, spot >> 6, np.int64(1) << (spot & 63))
    return table


def _spots(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix64(ids.astype(np.uint64) * np.uint64(2) + np.uint64(s)) >> np.uint64(64 - bits)).astype(np.int64) for s in (0, 1)]


def holds(ids: np.ndarray, words: np.ndarray) -> np.ndarray:
    a, b = _spots(ids, len(words).bit_length() + 5)
    return ((words[a >> 6] >> (a & 63)) & (words[b >> 6] >> (b & 63)) & 1) == 1


def _first_column(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).drop_null().to_numpy()


def id_filter(ids: DataFrame, bits: int, ids_of: Callable[[pa.RecordBatch], np.ndarray] = _first_column) -> np.ndarray:
    """The filter, as 64-bit words, of the ids that ids_of finds in the batches of a DataFrame, by default in its first column.

    Each task fills a filter of its own and sends the parts of it that are not empty, compressed; equal parts meet
    in one task, which joins them as they stream by, and the joined ones come to the driver.
    """
    parts = 1 << 6

    def fill(batches):
        table = np.zeros(1 << (bits - 6), np.int64)
        for batch in batches:
            _fill(table, ids_of(batch), bits)
        cut = table.reshape(parts, -1)
        full = np.flatnonzero(cut.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([zstandard.ZstdCompressor(level=1).compress(cut[k].tobytes()) for k in full], pa.binary())], ["part", "body"])

    def join(batches):
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_buffer()), np.int64)
                out[part] = out[part] | own if part in out else own
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([x.tobytes() for x in out.values()], pa.binary())], ["part", "body"])

    table = np.zeros((parts, (1 << (bits - 6)) // parts), np.int64)
    for row in ids.mapInArrow(fill, "part long, body binary").repartition(parts, "part").mapInArrow(join, "part long, body binary").collect():
        table[row["part"]] = np.frombuffer(row["body"], np.int64)
    return table.reshape(-1)


def _keeper(table, inside: bool, place: int) -> Keep:
    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(place)
        known = np.asarray(ids.is_valid()) & holds(ids.cast(pa.int64()).fill_null(0).to_numpy(), table.value)
        return batch.filter(pa.array(known == inside))

    return keep


def narrowed(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", most: int = MOST) -> tuple[tuple[DataFrame, Keep], tuple[DataFrame, Keep]]:
    """parted() for functions that see the rows in Arrow batches anyway: for each of the two parts a DataFrame, and what
    takes the part's rows out of one of its batches, so that no further worker is needed for that."""
    n = ids.count()
    if n > most:
        wanted = ids.select(F.col(ids.columns[0]).alias("__wanted")).distinct()
        same = docs[id_col] == wanted["__wanted"]
        return (docs.join(wanted, same, "left_semi"), lambda batch: batch), (docs.join(wanted, same, "left_anti"), lambda batch: batch)
    bits, place = filter_bits(n), docs.columns.index(id_col)
    own = _fill(np.zeros(1 << (bits - 6), np.int64), ids.select(F.col(ids.columns[0]).cast("long").alias("id")).filter("id is not null").toArrow().column(0).to_numpy(), bits) if n <= FEW else id_filter(ids, bits)
    table = docs.sparkSession.sparkContext.broadcast(own)
    return (docs, _keeper(table, True, place)), (docs, _keeper(table, False, place))


def parted(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", most: int = MOST, table: np.ndarray | None = None) -> tuple[DataFrame, DataFrame]:
    """docs, all columns kept, in two parts: the rows whose id is among `ids` (integers, first column), with a few
    others, and the rest. Rows without an id are in the rest. `ids` is computed twice, so it should be saved. Where the
    caller has a filter of the ids as `table`, ids are not looked at."""
    bound_batches(docs.sparkSession)
    kind = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])

    def part(rows: DataFrame, keep: Keep) -> DataFrame:
        def choose(batches):
            for batch in batches:
                yield keep(batch)
            release()

        return rows.mapInArrow(choose, kind) if rows is docs else rows

    if table is None:
        inside, outside = narrowed(docs, ids, id_col, most)
    else:
        shared, place = docs.sparkSession.sparkContext.broadcast(table), docs.columns.index(id_col)
        inside, outside = (docs, _keeper(shared, True, place)), (docs, _keeper(shared, False, place))
    return part(*inside), part(*outside)
