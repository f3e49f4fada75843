"""Time series of measures: bucketed aggregates, calendar spine, edge trim."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions import stats, temporal
from gleaner.model import Measure, TimeAxis
from gleaner.operators.dataset import Dataset
from gleaner.plans.query import aggregate

MAX_STEPS = 20_000
TRIM_POINTS, TRIM_INTERIOR, TRIM_SHARE = 5, 3, 0.5


@dataclass
class Series:
    buckets: list[datetime]
    labels: list[str]
    values: list[float]
    counts: list[int]
    trimmed_first: bool = False
    trimmed_last: bool = False


def buckets(ds: Dataset, measures: list[Measure], time: TimeAxis, grain: str) -> DataFrame:
    """(bucket, rows, v0, v1, ...): one aggregate for all measures of an axis."""
    start = temporal.bucket(ds.moment(time.column), grain)
    values = [aggregate(ds, m.column, m.aggregation).alias(f"v{k}") for k, m in enumerate(measures)]
    return ds.df.withColumn("__bucket", start).where(F.col("__bucket").isNotNull()).groupBy(F.col("__bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), *values)


def filled(points: DataFrame, grain: str, additive: list[bool]) -> DataFrame:
    """``points`` on every period between the first and the last: additive
    values are 0 where nothing happened, others stay null."""
    ends = points.agg(F.min("bucket").alias("a"), F.max("bucket").alias("z")).where(F.col("a").isNotNull())
    spine = temporal.spine(ends, "a", "z", grain)
    out = spine.join(points, "bucket", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return out.withColumns({f"v{k}": F.coalesce(f"v{k}", F.lit(0.0)) for k, a in enumerate(additive) if a})


def trimmed(points: DataFrame) -> DataFrame:
    """``points`` (bucket, rows, ...) without a first or last period that has
    less than half the rows of the typical one between them. Works on bucketed
    rows, so the unpartitioned window has a row for each period."""
    order = W.orderBy("bucket")
    numbered = points.withColumns({"i": F.row_number().over(order), "n": F.count(F.lit(1)).over(W.partitionBy())})
    inner = numbered.where((F.col("i") > 1) & (F.col("i") < F.col("n")) & (F.col("rows") > 0))
    typical = inner.agg(F.count(F.lit(1)).alias("inner"), F.percentile("rows", F.lit(0.5)).alias("typical"))
    low = (F.col("n") >= TRIM_POINTS) & (F.col("inner") >= TRIM_INTERIOR) & (F.col("rows") > 0) & (F.col("rows") < TRIM_SHARE * F.col("typical"))
    edge = (F.col("i") == 1) | (F.col("i") == F.col("n"))
    return numbered.join(F.broadcast(typical)).where(~F.coalesce(edge & low, F.lit(False))).select(*points.columns)


def collect(ds: Dataset, measures: list[Measure], time: TimeAxis, grain: str) -> dict[str, Series]:
    """One job for all measures of an axis and grain; a row for each period
    reaches the driver, at most ``MAX_STEPS`` of them are filled in."""
    rows = buckets(ds, measures, time, grain).orderBy("bucket").collect()
    return {m.name: build([(r["bucket"], r["rows"], r[f"v{k}"]) for r in rows], grain, m.additive) for k, m in enumerate(measures)}


def build(points: list[tuple[datetime, int, float | None]], grain: str, additive: bool) -> Series:
    """Fill the gaps of an additive series, leave out periods without a value,
    then trim the edges."""
    if additive and grain != "irregular" and points:
        known = {b: (n, v) for b, n, v in points}
        out, b = [], points[0][0]
        while b <= points[-1][0] and len(out) < MAX_STEPS:  # beyond, gaps stay gaps
            n, v = known.get(b, (0, 0.0))
            out.append((b, n, 0.0 if v is None else v))
            b = temporal.following(b, grain)
        points = out + [(t, n, 0.0 if v is None else v) for t, n, v in points if t >= b]
    points = [(b, n, v) for b, n, v in points if v is not None]
    s = Series([b for b, _, _ in points], [temporal.format_label(b, grain) for b, _, _ in points], [float(v) for _, _, v in points], [n for _, n, _ in points])
    return trim(s)


def trim(s: Series) -> Series:
    """Driver form of ``trimmed``."""
    inner = [n for n in s.counts[1:-1] if n > 0]
    if len(s.counts) < TRIM_POINTS or len(inner) < TRIM_INTERIOR:
        return s
    typical = stats.median(inner)
    low = [0 < n < TRIM_SHARE * typical for n in (s.counts[0], s.counts[-1])]
    a, z = int(low[0]), len(s.counts) - int(low[1])
    return Series(s.buckets[a:z], s.labels[a:z], s.values[a:z], s.counts[a:z], low[0], low[1])


def trend_frame(points: DataFrame, value: str = "v0") -> DataFrame:
    """One row: n, slope, intercept, r2 and the averages of the first and last
    third of a bucketed series."""
    order = W.orderBy("bucket")
    indexed = points.where(F.col(value).isNotNull()).select((F.row_number().over(order) - 1).cast("double").alias("i"), F.count(F.lit(1)).over(W.partitionBy()).alias("n"), F.col(value).alias("y"))
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    return indexed.agg(
        F.count("y").alias("n"), F.regr_slope("y", "i").alias("slope"), F.regr_intercept("y", "i").alias("intercept"),
        F.when(F.var_pop("y") > 0, F.regr_r2("y", "i")).otherwise(F.lit(0.0)).alias("r2"),
        F.avg(F.when(F.col("i") < third, F.col("y"))).alias("first_third"), F.avg(F.when(F.col("i") >= F.col("n") - third, F.col("y"))).alias("last_third"),
    )


def changepoint_frame(points: DataFrame, value: str = "v0") -> DataFrame:
    """(idx, mean_before, mean_after, t) of the split with the largest |t|, from
    prefix sums of the centred series."""
    y = F.col(value).cast("double")
    order = W.orderBy("bucket")
    s = points.where(F.col(value).isNotNull()).select("bucket", y.alias("y"), F.avg(y).over(W.partitionBy()).alias("m"))
    s = s.withColumn("c", F.col("y") - F.col("m"))
    run = order.rowsBetween(W.unboundedPreceding, -1)
    s = s.select(
        (F.row_number().over(order) - 1).alias("idx"), "m", F.count(F.lit(1)).over(W.partitionBy()).alias("n"), F.sum("c").over(W.partitionBy()).alias("s"), F.sum(F.col("c") * F.col("c")).over(W.partitionBy()).alias("q"),
        F.sum("c").over(run).alias("s1"), F.sum(F.col("c") * F.col("c")).over(run).alias("q1"),
    )
    least = F.greatest(F.lit(4), F.floor(F.col("n") * 0.15))
    s = s.where((F.col("n") >= 2 * least) & (F.col("idx") >= least) & (F.col("idx") <= F.col("n") - least))
    n1, n2 = F.col("idx"), F.col("n") - F.col("idx")
    m1, m2 = F.col("s1") / n1, (F.col("s") - F.col("s1")) / n2
    v1 = F.greatest(F.lit(0.0), (F.col("q1") - n1 * m1 * m1) / (n1 - 1))
    v2 = F.greatest(F.lit(0.0), (F.col("q") - F.col("q1") - n2 * m2 * m2) / (n2 - 1))
    t = (m1 - m2) / F.sqrt(v1 / n1 + v2 / n2)
    return s.select("idx", (F.col("m") + m1).alias("mean_before"), (F.col("m") + m2).alias("mean_after"), t.alias("t")).orderBy(F.abs("t").desc_nulls_last(), "idx").limit(1)


def anomaly_frame(points: DataFrame, value: str = "v0") -> DataFrame:
    """(bucket, value, z): deviations from the median in MADs, or in standard
    deviations where the MAD is 0."""
    known = points.where(F.col(value).isNotNull()).select("bucket", F.col(value).cast("double").alias("value"))
    centre = known.agg(F.percentile("value", F.lit(0.5)).alias("med"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))
    spread = known.join(F.broadcast(centre)).agg((F.percentile(F.abs(F.col("value") - F.col("med")), F.lit(0.5)) * stats.MAD_SCALE).alias("mad"), F.first("med").alias("med"), F.first("sd").alias("sd"))
    scale = F.when(F.col("mad") >= 1e-12, F.col("mad")).when(F.col("sd") >= 1e-12, F.col("sd"))
    return known.join(F.broadcast(spread)).select("bucket", "value", F.coalesce((F.col("value") - F.col("med")) / scale, F.lit(0.0)).alias("z"))
