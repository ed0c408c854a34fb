"""Sources and sinks of keyed tables and sequences."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyflow.operators.keyed import KeyedTable

#: Key columns of the driver's tables; lineitem has none.
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "events": ["event_id"], "documents": ["doc_id"], "labels": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"],
    "benchmark": ["item_id"], "conversations": ["conv_id", "turn"],
}


def load(spark: SparkSession, folder: str, name: str) -> KeyedTable:
    """A table with its key; an empty one where it has none."""
    return KeyedTable(rows(spark, folder, name), KEYS.get(name, []), name)


def rows(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table without a key."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def interval(spark: SparkSession, start: str, every: timedelta, n: int) -> DataFrame:
    """(tick, ts, elapsed seconds): n ticks from start."""
    us = every // timedelta(microseconds=1)
    ts = F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + F.col("id") * us)
    return spark.range(n).select(F.col("id").alias("tick"), ts.alias("ts"), (F.col("id") * us / 1e6).alias("elapsed"))


def from_iter(spark: SparkSession, values: Sequence, schema: str, every: timedelta = timedelta(seconds=1), start: str = "1970-01-01") -> DataFrame:
    """The values as events (seq, ts, value), one for each period."""
    us = every // timedelta(microseconds=1)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"seq long, value {schema}")
    return df.withColumn("ts", F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + F.col("seq") * us))


def live_interval(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """A stream of ticks (tick, ts, elapsed seconds by the tick's number)."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return ticks.select(F.col("value").alias("tick"), F.col("timestamp").alias("ts"), (F.col("value") / rows_per_second).alias("elapsed"))


def live_files(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream of a folder's Parquet files, so many at a time: admission is bounded by the source."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
