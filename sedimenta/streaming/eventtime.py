"""Event-time windows, sessions and deduplication; the same code serves batch and streaming DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _watermarked(df: DataFrame, time: str, late: str | None) -> DataFrame:
    """A stream with a watermark; it needs times with a zone, so others are taken in the session's."""
    if not late or not df.isStreaming:
        return df
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], aggregates: list[Column], late: str | None = None) -> DataFrame:
    return sliding(df, time, width, width, keys, aggregates, late)


def sliding(df: DataFrame, time: str, width: str, step: str, keys: list[str], aggregates: list[Column], late: str | None = None) -> DataFrame:
    """(window_start, window_end, keys, aggregates); rows later than `late` are dropped in streams."""
    grouped = _watermarked(df, time, late).groupBy(F.window(time, width, step).alias("__w"), *keys).agg(*aggregates)
    kind = df.schema[time].dataType
    return grouped.select(F.col("__w.start").cast(kind).alias("window_start"), F.col("__w.end").cast(kind).alias("window_end"), *[c for c in grouped.columns if c != "__w"])


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], aggregates: list[Column], late: str | None = None) -> DataFrame:
    """Sessions per key that end after a gap; times without zone are taken as UTC."""
    source = _watermarked(df.withColumn(time, F.col(time).cast("timestamp")), time, late)
    grouped = source.groupBy(F.session_window(time, gap).alias("__w"), *keys).agg(*aggregates)
    return grouped.select(F.col("__w.start").cast("timestamp_ntz").alias("session_start"), F.col("__w.end").cast("timestamp_ntz").alias("session_end"), *[c for c in grouped.columns if c != "__w"])


def first_per_key(df: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """One row per key: the earliest in batch, the first to arrive within `late` in streams."""
    if df.isStreaming:
        return _watermarked(df, time, late).dropDuplicatesWithinWatermark(keys)
    rest = [c for c in df.columns if c not in (*keys, time)]
    return df.groupBy(*keys).agg(F.min(F.struct(time, *rest)).alias("__r")).select(*[F.col(k) if k in keys else F.col(f"__r.{k}").alias(k) for k in df.columns])


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything there is, once each, and stop; sink gets each micro-batch with its number."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
