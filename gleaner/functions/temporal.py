"""Calendar buckets in UTC: truncation, labels, steps, and the grain of an axis."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.quantiles import quantiles

#: Median gap in hours below which an axis has the grain.
GAP_HOURS = (("hour", 2), ("day", 48), ("week", 240), ("month", 1080), ("quarter", 3120), ("year", 12000))
COARSER = {"hour": "day", "day": "week", "week": "month", "month": "quarter", "quarter": "year"}
FORMATS = {"hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd", "week": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy", "irregular": "yyyy-MM-dd"}
STEPS = {"hour": "1 hour", "day": "1 day", "week": "7 days", "month": "1 month", "quarter": "3 months", "year": "1 year"}


def bucket(ts: Column, grain: str) -> Column:
    """Start of the period, weeks from Monday; irregular keeps the moment."""
    return ts.cast("timestamp") if grain == "irregular" else F.date_trunc(grain, ts).cast("timestamp")


def label(start: Column, grain: str) -> Column:
    if grain == "quarter":
        return F.concat(F.date_format(start, "yyyy"), F.lit("-Q"), F.quarter(start).cast("string"))
    return F.date_format(start, FORMATS[grain])


def truncate(t: datetime, grain: str) -> datetime:
    """Driver form of ``bucket``."""
    day = t.replace(hour=0, minute=0, second=0, microsecond=0)
    match grain:
        case "hour":
            return t.replace(minute=0, second=0, microsecond=0)
        case "day":
            return day
        case "week":
            return day - timedelta(days=day.weekday())
        case "month":
            return day.replace(day=1)
        case "quarter":
            return day.replace(month=(t.month - 1) // 3 * 3 + 1, day=1)
        case "year":
            return day.replace(month=1, day=1)
    return t


def format_label(t: datetime, grain: str) -> str:
    """Driver form of ``label``."""
    if grain == "quarter":
        return f"{t.year:04d}-Q{(t.month - 1) // 3 + 1}"
    return {"hour": f"{t:%Y-%m-%d %H}:00", "month": f"{t:%Y-%m}", "year": f"{t:%Y}"}.get(grain, f"{t:%Y-%m-%d}")


def following(t: datetime, grain: str) -> datetime:
    """The next bucket after a bucket's start."""
    months = {"month": 1, "quarter": 3, "year": 12}.get(grain)
    if months:
        k = t.year * 12 + t.month - 1 + months
        return t.replace(year=k // 12, month=k % 12 + 1)
    return t + {"hour": timedelta(hours=1), "day": timedelta(days=1), "week": timedelta(days=7)}[grain]


def spine(df: DataFrame, start: str, end: str, grain: str) -> DataFrame:
    """(bucket): every period from column ``start`` to ``end`` of one row."""
    step = F.expr(f"interval {STEPS[grain]}")
    return df.select(F.explode(F.sequence(F.col(start), F.col(end), step)).alias("bucket"))


def expected_periods(low: datetime, high: datetime, grain: str) -> int:
    """Periods from the raw ends of an axis, both included; 0 if irregular."""
    span = (high - low).total_seconds()
    match grain:
        case "hour":
            return int(span // 3600) + 1
        case "day":
            return int(span // 86400) + 1
        case "week":
            return int(span // 604800) + 1
        case "month":
            return (high.year - low.year) * 12 + high.month - low.month + 1
        case "quarter":
            return ((high.year - low.year) * 12 + high.month - low.month) // 3 + 1
        case "year":
            return high.year - low.year + 1
    return 0


def grain_of_gap(hours: float | None) -> str:
    if hours is None:
        return "day"
    return next((g for g, most in GAP_HOURS if hours < most), "irregular")


def grain_frame(df: DataFrame, ts: Column) -> DataFrame:
    """One row (n, median_gap_us): distinct moments and their median gap.

    Gaps are taken day by day and joined at the days' ends, so no task orders
    more moments than one day has; the window over days has a row for each day.
    """
    moments = df.select(F.unix_micros(ts.cast("timestamp")).alias("us")).where(F.col("us").isNotNull()).distinct()
    moments = moments.withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    inside = moments.select((F.col("us") - F.lag("us").over(W.partitionBy("day").orderBy("us"))).alias("gap"))
    days = moments.groupBy("day").agg(F.min("us").alias("a"), F.max("us").alias("z"))
    across = days.select((F.col("a") - F.lag("z").over(W.orderBy("day"))).alias("gap"))
    gaps = inside.unionAll(across).where(F.col("gap").isNotNull())
    median = quantiles(gaps.select(F.lit(0).alias("c"), F.col("gap").alias("x")), [0.5]).select(F.col("q0").alias("median_gap_us"))
    return gaps.agg((F.count("gap") + 1).alias("n")).join(F.broadcast(median), F.lit(True), "left")  # one row each


def detect_grain(df: DataFrame, ts: Column) -> str:
    row = grain_frame(df, ts).first()
    return grain_of_gap(None if row["median_gap_us"] is None else row["median_gap_us"] / 3.6e9)
