"""Statistics as column expressions, for results that stay in Spark."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.stats import ERF


def let(value: Column, body) -> Column:
    """``body(value)`` with the value taken once, not written out at every use: long
    expressions stay short in plans and in generated code."""
    return F.element_at(F.transform(F.array(value), body), 1)


def erf(x: Column) -> Column:
    """Within 1.5e-7."""
    p, *a = ERF
    t = 1 / (1 + p * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + c) * t
    return F.when(x < 0, -1.0).otherwise(1.0) * (1 - poly * F.exp(-x * x))


def normal_two_sided(z: Column) -> Column:
    p = 2 * (1 - 0.5 * (1 + erf(F.abs(z) / math.sqrt(2))))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))


def clamp01(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def benjamini_hochberg(df: DataFrame, p: str) -> DataFrame:
    """``df`` with q: a window over test results, of which there are few."""
    k = F.row_number().over(W.orderBy(p))
    ranked = df.withColumns({"__k": k, "__n": F.count(F.lit(1)).over(W.partitionBy())})
    low = F.min(F.col(p) * F.col("__n") / F.col("__k")).over(W.orderBy(F.col("__k").desc()).rowsBetween(W.unboundedPreceding, 0))
    return ranked.withColumn("q", F.least(F.lit(1.0), low)).drop("__k", "__n")
