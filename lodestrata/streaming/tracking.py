"""Extensions on Structured Streaming: windowed counts with late data, and first and last sighting of every key.

The batch operators have no streaming counterpart elsewhere; these two are additions. State is
keyed by (window, type) or by key, so it is spread by hash; windows older than the watermark leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrata.storage import Workspace

SIGHTINGS = "key string, first_seen timestamp, last_seen timestamp, n long"


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, kind, n) per tumbling window; events later than the watermark are dropped in a stream."""
    stamped = events.select(F.col(at).cast("timestamp").alias("_at"), F.col(kind).alias("kind")).where("_at is not null")
    if events.isStreaming:
        stamped = stamped.withWatermark("_at", late)
    counted = stamped.groupBy(F.window("_at", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "kind", "n")


def _sighted(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    first, last, n = state.get if state.exists else (None, None, 0)
    for batch in batches:
        if len(batch):
            low, high = batch["at"].min(), batch["at"].max()
            first, last, n = low if first is None else min(first, low), high if last is None else max(last, high), n + len(batch)
    state.update((first, last, n))
    yield pd.DataFrame({"key": [key[0]], "first_seen": [first], "last_seen": [last], "n": [n]})


def sightings(events: DataFrame, key: str, at: str) -> DataFrame:
    """(key, first_seen, last_seen, n) as known after each micro-batch; the last row of a key holds."""
    slim = events.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at")).where("key is not null and at is not null")
    state = "first_seen timestamp, last_seen timestamp, n long"
    return slim.groupBy("key").applyInPandasWithState(_sighted, SIGHTINGS, state, "update", GroupStateTimeout.NoTimeout)


def drained(spark: SparkSession, stream: DataFrame, keys: list[str], newest: str, label: str) -> DataFrame:
    """Runs a stream over all that is there now and returns the last row of each key.

    Every micro-batch is written under its number, so a batch that is run again after a failure
    replaces its own rows (exactly once); updates of one key are resolved by the greatest `newest`.
    """
    work = Workspace(spark, label)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work.root}/rows/batch={number}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{work.root}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    names = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(stream.schema).parquet(f"{work.root}/rows/batch=*")
    ordered = [newest, *[c for c in names if c != newest]]
    return rows.groupBy(*keys).agg(F.max(F.struct(*ordered)).alias("_l")).select(*keys, *[F.col(f"_l.{c}").alias(c) for c in names])


def stream_of(spark: SparkSession, directory: str, name: str, files_per_batch: int = 8) -> DataFrame:
    """A table's files as a stream, whether it is one file or a folder of them (a glob takes both)."""
    path = f"{directory}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}*")
