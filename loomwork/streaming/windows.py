"""Aggregates over event time that run on a stream or a batch alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, time: str, lateness: str | None) -> DataFrame:
    """events with time as a timestamp (the session's zone for times without one) and, on a stream, a watermark."""
    out = events.withColumn(time, F.col(time).cast("timestamp"))
    return out.withWatermark(time, lateness) if lateness and events.isStreaming else out


def tumbling(events: DataFrame, time: str, width: str, group: list[str], value: str, lateness: str | None = "1 hour") -> DataFrame:
    """n and total of value for each group and window of this width."""
    w = F.window(time, width)
    return timed(events, time, lateness).groupBy(w.alias("_w"), *group).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(*group, F.col("_w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, time: str, gap: str, group: list[str], lateness: str | None = "1 hour") -> DataFrame:
    """First time, end and n of runs of events that lie less than gap apart."""
    w = F.session_window(time, gap)
    return timed(events, time, lateness).groupBy(w.alias("_w"), *group).agg(F.count("*").alias("n")).select(*group, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def observations(events: DataFrame, group: list[str], value: str, weight: str) -> DataFrame:
    """Sums that make a mergeable sketch (see operators.statistics), kept up over a stream: n, w, wx and wxx."""
    x, w = F.col(value), F.col(weight)
    return events.filter(x.isNotNull() & (w > 0)).groupBy(*group).agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"))


def compare_snapshots(stream: DataFrame, known: str, compare: Callable[[DataFrame, DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that compares each batch of a snapshot stream with the table at known, hands the result to sink, and makes the batch the new table."""

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        fresh = f"{known}/batch={n}"
        batch.write.mode("overwrite").parquet(fresh)  # the same batch again writes the same folder
        old = spark.read.schema(batch.schema).parquet(f"{known}/batch={n - 1}") if n else batch.limit(0)
        sink(compare(old, spark.read.parquet(fresh)), n)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
