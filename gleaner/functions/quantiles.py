"""Exact interpolated quantiles of columns of any size.

The built-in exact percentile holds a column's distinct values in one reducer.
Here values are counted, ordered by a range exchange, and found by prefix counts:
a task sees one range of values, and a row for each partition is ordered in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def quantiles(long: DataFrame, qs: list[float]) -> DataFrame:
    """(c, q0, q1, ...) of ``long`` (c, x): linear interpolation at (n - 1) * q.

    Missing x are left out; a c without values has no row.
    """
    counts = long.where(F.col("x").isNotNull()).groupBy("c", "x").agg(F.count(F.lit(1)).alias("n"))
    parts = counts.repartitionByRange("c", "x").withColumn("part", F.spark_partition_id()).persist()
    per_part = parts.groupBy("c", "part").agg(F.sum("n").alias("s"))
    order = W.partitionBy("c").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    earlier = per_part.select("c", "part", F.coalesce(F.sum("s").over(order), F.lit(0)).alias("earlier"), F.sum("s").over(W.partitionBy("c")).alias("total"))
    inside = W.partitionBy("part", "c").orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    placed = parts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(earlier, ["c", "part"])  # a row for each group and partition
    first = F.col("earlier") + F.col("inside")  # rank of the value's first row
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(q)).alias("q"), side.alias("at")) for k, q in enumerate(qs) for side in (F.floor((F.col("total") - 1) * q), F.ceil((F.col("total") - 1) * q))])
    hits = placed.select("c", "x", "n", "total", first.alias("first"), F.explode(wanted).alias("w"))
    hits = hits.where((F.col("w.at") >= F.col("first")) & (F.col("w.at") < F.col("first") + F.col("n")))
    at = (F.col("total") - 1) * F.col("w.q")
    ends = hits.groupBy("c", F.col("w.k").alias("k")).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.max(at - F.floor(at)).alias("part"))
    value = F.col("low") + (F.col("high") - F.col("low")) * F.col("part")
    return ends.groupBy("c").agg(*[F.max(F.when(F.col("k") == k, value)).alias(f"q{k}") for k in range(len(qs))])
