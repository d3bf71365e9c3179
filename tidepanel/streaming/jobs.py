"""Structured Streaming forms of the panel operators: bars, flows, upserts, state.

Every builder takes a streaming DataFrame and returns one; sinks are separate. State is
kept by Spark's state store with watermarks, so a lost executor only replays its batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import latest_per_key
from ..session import checkpoint_dir
from . import levels, ordered


def table_stream(spark: SparkSession, folder: str, file_glob: str, per_trigger: int = 1) -> DataFrame:
    """Files of a folder as a stream; the schema comes from the files already there."""
    schema = spark.read.parquet(f"{folder}/{file_glob}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", file_glob).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    plain = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return stream.withColumns({c: utc_instant(F.col(c)) for c in plain}) if plain else stream


def utc_instant(c: Column) -> Column:
    """Zone-less time read as UTC (event time needs an instant), in any session zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), c).cast("timestamp")


def utc_wall(c: Column) -> Column:
    """Back from an instant to zone-less UTC time."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))


def daily_bars(events: DataFrame, key: str, ts: str, value: str, late: str = "1 hour") -> DataFrame:
    """Tumbling one-day bars per key, emitted when the watermark passes the day."""
    w = F.window(ts, "1 day")
    return events.withWatermark(ts, late).groupBy(key, w.alias("w")).agg(
        F.min_by(value, ts).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"),
        F.max_by(value, ts).alias("close"), F.count(F.lit(1)).alias("vol"), F.sum(value).alias("amount"),
    ).select(key, utc_wall(F.col("w.start")).cast("date").alias("trade_date"), "open", "high", "low", "close", "vol", "amount")


def sliding_sums(events: DataFrame, key: str, ts: str, value: str, length: str = "5 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    w = F.window(ts, length, step)
    return events.withWatermark(ts, late).groupBy(key, w.alias("w")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n")).select(
        key, utc_wall(F.col("w.end")).alias("window_end"), "total", "n")


def sector_flow(events: DataFrame, sectors: DataFrame, key: str, ts: str, value: str, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Stream-static join with the sector dimension, net flow per sector and window."""
    joined = events.withWatermark(ts, late).join(sectors, key)
    return joined.groupBy("sector_name", F.window(ts, length).alias("w")).agg(F.sum(value).alias("main_force_net"), F.count(F.lit(1)).alias("n")).select(
        "sector_name", utc_wall(F.col("w.start")).cast("date").alias("date"), "main_force_net", "n")


def without_duplicates(rows: DataFrame, keys: Sequence[str], ts: str, late: str = "1 day") -> DataFrame:
    """First row per key within the watermark; state is dropped behind it."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def trailing_peaks(prices: DataFrame, drop: float = 0.12, rise: float = 1.05, late: str = "0 seconds", idle_days: int = 365) -> DataFrame:
    """Per position: running peak since entry and the trailing-stop signal.

    Input columns: code, ts, close (the first close is the entry price); rows with a null in them are left out.
    Rows count in the order of ``ts`` however they arrive, if no later than ``late``; a position without rows for
    ``idle_days`` is forgotten, and its next close is an entry price again.
    """
    processor = ordered.TrailingPeaks(idle_days * 86_400_000, drop, rise)
    return ordered.run(prices, "code", "close", "ts", processor, "code string, at long, close double, peak double, drawdown double, signal boolean", late)


def ic_monitor(ics: DataFrame, keep: int = 20, alarm: float = 0.02, late: str = "0 seconds", idle_days: int = 365) -> DataFrame:
    """Last ``keep`` ICs per factor in state: rolling mean, IR and the low-IC alarm; order and expiry as for
    :func:`trailing_peaks`."""
    processor = ordered.IcMonitor(idle_days * 86_400_000, keep, alarm)
    return ordered.run(ics, "factor", "ic", "ts", processor, "factor string, at long, ic double, ic_mean double, ir double, low_ic boolean", late)


def upsert_log(stream: DataFrame, path: str, keys: Sequence[str], order: str, checkpoint: str, compact_every: int | None = None):
    """Append each batch, reduced to one row per key, to a log partitioned by batch.

    A replayed batch overwrites its own partition only, so the sink is idempotent. With ``compact_every``, so many
    batches are merged into key-ranged runs (:mod:`levels`). ``read_upserts`` resolves the newest version per key.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in keys and c != order]
        latest_per_key(batch, list(keys), order, rest).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        if compact_every:
            levels.compact(batch.sparkSession, path, keys, order, fan=compact_every)

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_upserts(spark: SparkSession, path: str, keys: Sequence[str], order: str, low=None, high=None) -> DataFrame:
    """Newest row per key, of the keys whose first column lies in the bounds, where given."""
    return levels.read(spark, path, keys, order, low, high)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all available input into a table of the shared folder and read it."""
    spark = stream.sparkSession
    root = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ckpt").outputMode("append").trigger(
        availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
