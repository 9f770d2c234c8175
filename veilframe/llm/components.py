"""Connected components of a graph of any size, as DataFrames."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir of the session; where it is unset, as in tests, a folder in the warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints-{uuid.uuid4().hex}"
        context.setCheckpointDir(folder)


def saved(df: DataFrame) -> DataFrame:
    """df, computed now, written to the shared checkpoint folder and cut off from what it was made of."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As saved(), as a compressed table that other queries read by columns: for what is large. The folder goes with the cluster's other checkpoints."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Edges up to which the driver joins them itself (16 bytes each, 2 MB in all).
FEW = 1 << 17


def _contract(batches):
    """Edges of one task replaced by a star in each of their components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1 << 20:  # what is held stays bounded: give out the stars so far and begin anew
            yield _stars(parent, root)
            parent.clear()
    yield _stars(parent, root)


def _stars(parent: dict[int, int], root) -> pa.RecordBatch:
    pairs = np.array([(x, r) for x in list(parent) if (r := root(x)) != x], np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """id, component (the smallest id in reach) of every id in the edges u, v (long; direction, repeats, loops and order don't matter).

    Each task first shrinks its own edges to stars. Where `few` edges or less are left the driver joins them, which
    spares the rounds; else large-star and small-star steps alternate until nothing changes, which takes about as
    many rounds as the logarithm of the largest component. A step is one aggregation by minimum, combined before the
    shuffle, and one join; each round is written to the shared checkpoint folder. Ids without edges don't appear.
    Nulls are left out. More than `few` edges are never collected.
    """
    kind = "u long, v long"
    now = written(edges.select(edges["u"].cast("long").alias("u"), edges["v"].cast("long").alias("v")).filter("u is not null and v is not null and u != v").mapInArrow(_contract, kind).distinct())
    if now.count() <= few:
        star = next(_contract(now.toArrow().combine_chunks().to_batches() or [pa.RecordBatch.from_pydict({"u": [], "v": []})]))
        ids, least = star.column(0), star.column(1)
        centres = pa.array(np.unique(least.to_numpy()), pa.int64())
        table = pa.table({"id": pa.concat_arrays([ids, centres]), "component": pa.concat_arrays([least, centres])})
        return edges.sparkSession.createDataFrame(table) if len(table) else now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    before = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        now = saved(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
