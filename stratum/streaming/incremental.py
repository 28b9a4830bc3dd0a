"""Micro-batch operators: windowed counts with late data, anchors learned batch by batch, stateful smoothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratum.sources.store import Store


def windowed(events: DataFrame, time: str, key: str, value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, key, n, total) of tumbling windows of a stream; rows later than ``late`` are left out."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def forward_level(events: DataFrame, key: str, time: str, value: str, r: float = 1.0, q: float = 0.1) -> DataFrame:
    """(key, n, level, variance): the forward Kalman level of each key, kept as state from batch to batch."""
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, x, p = state.get if state.exists else (0, 0.0, 0.0)
        for f in frames:
            for y in f.sort_values(time)[value].dropna():
                if n == 0:
                    x, p = float(y), r
                else:
                    p += q
                    g = p / (p + r)
                    x, p = x + g * (float(y) - x), (1 - g) * p
                n += 1
        state.update((n, x, p))
        yield pd.DataFrame({key: [k[0]], "n": [n], "level": [x], "variance": [p]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n bigint, level double, variance double", "n bigint, x double, p double", "update", GroupStateTimeout.NoTimeout)


def into_store(stream: DataFrame, store: Store, table: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d):
    """A query that commits each micro-batch once: a batch seen again after a failure is not added twice."""

    def save(df: DataFrame, epoch: int) -> None:
        store.commit(f"{table}-{epoch}", {table: prepare(df)})

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def replay(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
