"""Masking a stream of documents, one micro-batch at a time, with a vault that grows from batch to batch."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilframe.operators.vault import MAPPINGS
from veilframe.plans.engine import detect, mask


def compacted(vault: DataFrame) -> DataFrame:
    """A vault with one row for each key: what was stored first, seen when it was seen last."""
    key = ["project_id", "entity_type", "original_text"]
    kept = [F.min_by(c, F.struct("created_at", "masked_text")).alias(c) for c in ("masked_text", "source", "confidence", "created_at")]
    return vault.groupBy(*key).agg(*kept, F.max("last_seen_at").alias("last_seen_at"))


def mask_stream(documents: DataFrame, project: Column, vault_path: str, output_path: str, checkpoint_path: str, engine: str = "hybrid") -> StreamingQuery:
    """Masks every micro-batch of a streaming DataFrame (doc_id, text) and appends it to output_path.

    The vault is a folder of parts, one for each batch: a batch reads the parts before its own and writes the rows
    that it has made or met, so that what it writes does not grow with the vault, and a batch that is run again after a
    failure gives the same masks.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        parts = spark.read.schema(f"{MAPPINGS}, v int").parquet(vault_path).filter(F.col("v") < number).drop("v") if number else spark.createDataFrame([], MAPPINGS)
        now = F.lit(datetime.datetime.now(datetime.timezone.utc)).cast("timestamp")
        out, after = mask(detect(batch, engine), project, compacted(parts), now)
        after.filter(F.col("last_seen_at") == now).write.mode("overwrite").parquet(f"{vault_path}/v={number}")
        out.select("doc_id", "masked_text").write.mode("overwrite").parquet(f"{output_path}/batch={number}")

    return documents.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()
