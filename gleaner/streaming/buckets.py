"""Bucketed aggregates of a stream: tumbling calendar periods with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.functions.temporal import STEPS


def bucketed(events: DataFrame, time: str, value: str, grain: str = "hour", late: str = "1 hour", keys: list[str] | None = None) -> DataFrame:
    """(bucket, keys, rows, total, mean) of each period and key.

    Rows later than ``late`` behind the newest are left out and a period is
    final once the watermark passes its end. Weeks start on Monday. Months and
    longer have no fixed length: those come from daily buckets by ``rolled_up``.
    """
    if grain not in ("hour", "day", "week"):
        raise ValueError("stream by hour, day or week and roll up from there")
    ts = F.col(time).cast("timestamp")
    start = "4 days" if grain == "week" else "0 seconds"  # the epoch is a Thursday
    window = F.window("__ts", STEPS[grain], startTime=start)
    by = [F.col(k) for k in keys or []]
    out = events.withColumn("__ts", ts).withWatermark("__ts", late).groupBy(window.alias("w"), *by)
    out = out.agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("bucket"), *(keys or []), "rows", "total", "mean")


def rolled_up(buckets: DataFrame, grain: str, keys: list[str] | None = None) -> DataFrame:
    """Coarser periods from finer final buckets."""
    by = [F.date_trunc(grain, "bucket").alias("bucket"), *[F.col(k) for k in keys or []]]
    return buckets.groupBy(*by).agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"), (F.sum(F.col("mean") * F.col("rows")) / F.sum("rows")).alias("mean"))


def write(out: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append final periods to Parquet; ``once`` takes what is there and stops."""
    w = out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
