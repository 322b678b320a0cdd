"""Streams in micro-batches: each batch is encoded as one chunk; differences across batches keep the last value a key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.plan import Plan, encode


def encode_stream(stream: DataFrame, plan: Plan, path: str, checkpoint: str):
    """Start a query that writes every micro-batch under path, column `batch`; a batch that is run again replaces its own.

    The plan's chunks are those of its `by`, batch among them; further columns there cut a large batch into many chunks.
    """

    def write(batch: DataFrame, number: int) -> None:
        encode(batch.withColumn("batch", F.lit(number).cast("long")), plan).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_delta(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, order, delta): differences along each key over all micro-batches; state is one value a key."""
    schema = f"`{key}` {stream.schema[key].dataType.simpleString()}, `{order}` {stream.schema[order].dataType.simpleString()}, delta long"

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order)
        last = state.get[0] if state.exists else 0
        values = rows[value].to_numpy("int64")
        state.update((int(values[-1]),))
        yield pd.DataFrame({key: k[0], order: rows[order].to_numpy(), "delta": values - [last, *values[:-1]]})

    return stream.groupBy(key).applyInPandasWithState(step, schema, "last long", "append", "NoTimeout")
