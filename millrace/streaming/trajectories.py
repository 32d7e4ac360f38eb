"""Trajectory logs as streams: metrics per micro-batch, running averages, resume."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.groups import transition_metrics


def read_log(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def running_metrics(log: DataFrame, *by: str) -> DataFrame:
    """Transition metrics as a streaming aggregate (complete or update mode); its state is one row per group."""
    return transition_metrics(log, *by)


def append_batches(log: DataFrame, out: str, checkpoint: str, key: list[str]):
    """Every key is written once, under the id of the micro-batch that brings it first: keys seen are kept as state, by
    key, in the stream's checkpoint. A restart overwrites the batch that was cut short."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    return log.dropDuplicates(key).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Values that the running average takes in at once.
_CHUNK = 1024


def running_average(log: DataFrame, key: str, order: str, value: str, rate: float = 0.05) -> DataFrame:
    """Per key and micro-batch: the exponential moving average over the values so far, in order within a batch; state is one number a key."""
    kinds = dict(log.dtypes)
    decay, chunk = 1 - rate, _CHUNK

    def step(k: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat([f[[order, value]] for f in frames])
        x = rows.sort_values(order, kind="stable")[value].to_numpy(float)
        ema, n = state.get if state.exists else (None, 0)
        if ema is None and len(x):
            ema, n, x = float(x[0]), 1, x[1:]
        for at in range(0, len(x), chunk):
            part = x[at : at + chunk]
            ema = ema * decay ** len(part) + rate * float(decay ** np.arange(len(part) - 1, -1, -1) @ part)
        state.update((ema, n + len(x)))
        yield pd.DataFrame({key: [k[0]], "ema": [ema], "n": [n + len(x)]})

    return log.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, ema double, n long", "ema double, n long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(log: DataFrame, ts: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts per tumbling window, late rows up to ``late`` included."""
    return log.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"))
