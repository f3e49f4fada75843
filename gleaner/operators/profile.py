"""Type inference and column profiles in a few wide aggregates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import coerce, temporal
from gleaner.functions.stats import MAD_SCALE
from gleaner.model import NUMERIC, TEMPORAL, ColumnProfile, NumericStats, TemporalStats
from gleaner.operators.dataset import Dataset
from gleaner.functions.quantiles import quantiles

THRESHOLD, INTEGRAL = 0.9, 0.99
TOP_VALUES, SAMPLES = 12, 5
#: First rows that sample values come from.
HEAD = 200


def _count(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def infer(df: DataFrame) -> dict[str, tuple[str, int, bool]]:
    """column -> (logical type, values that do not fit it, day first).

    A type needs nine tenths of the known values; dates come before booleans,
    those before numbers.
    """
    return _infer(value_counts(df), df.columns)


def _infer(counts: DataFrame, columns: list[str]) -> dict[str, tuple[str, int, bool]]:
    """From (c, value, n): every distinct value is read once, whatever its
    frequency, by expressions that are compiled once for all columns. Both
    readings of slashed dates are counted in the same pass, and values without a
    digit are neither dates nor numbers."""
    raw, n = F.col("value"), F.col("n")
    counts = counts.select("c", coerce.trimmed(raw).alias("value"), "n")
    digit = raw.rlike(r"\d")
    read = counts.select("c", raw, n, F.when(digit, coerce.number_of(raw, True)).alias("number"), coerce.is_date(raw, False).alias("m"), coerce.is_date(raw, True).alias("d"))
    clock = coerce.has_clock(raw)
    tests = {
        "bool": coerce.boolean_of(raw).isNotNull(), "num": F.col("number").isNotNull(), "int": F.col("number") == F.floor("number"), "m": F.col("m"), "d": F.col("d"),
        "mc": F.col("m") & clock, "dc": F.col("d") & clock, "a": coerce.over_twelve(raw, 1), "b": coerce.over_twelve(raw, 2),
    }
    rated = read.select("c", "n", *[F.coalesce(t, F.lit(False)).alias(k) for k, t in tests.items()])
    sums = [F.sum(F.when(F.col(k), n).otherwise(0)).alias(k) for k in tests]
    found = {r["c"]: r.asDict() for r in rated.groupBy("c").agg(F.sum(n).alias("n"), F.count(F.lit(1)).alias("distinct"), *sums).collect()}
    return {c: _decide(c, found.get(i)) for i, c in enumerate(columns)}


def _decide(name: str, x: dict | None) -> tuple[str, int, bool]:
    if x is None:
        return "unknown", 0, False
    n, distinct = x["n"], x["distinct"]
    day_first = x["a"] > 0 and x["b"] == 0
    dates, clock = (x["d"], x["dc"]) if day_first else (x["m"], x["mc"])
    unique = distinct == n and n >= 3 and coerce.looks_like_id(name)
    if dates >= max(2, THRESHOLD * n):
        return ("datetime" if clock else "date"), n - dates, day_first
    if x["bool"] >= THRESHOLD * n:
        return "boolean", n - x["bool"], day_first
    if x["num"] >= THRESHOLD * n:
        whole = x["int"] >= INTEGRAL * max(1, x["num"])
        kind = "identifier" if whole and unique else "integer" if whole else "number"
        return kind, n - x["num"], day_first
    if unique:
        return "identifier", 0, day_first
    return ("category" if distinct <= max(50, 0.5 * n) else "text"), 0, day_first


def distinct_counts(df: DataFrame) -> dict[str, int]:
    """Exact distinct non-null values of every column, by hash aggregation with
    partial sums over stacked cells, so that no column expands the others."""
    found = {r["c"]: r["d"] for r in value_counts(df).groupBy("c").agg(F.count(F.lit(1)).alias("d")).collect()}
    return {c: found.get(i, 0) for i, c in enumerate(df.columns)}


def stacked(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(c, value): a row for each cell, values as text."""
    names = columns or df.columns
    cells = F.array(*[F.struct(F.lit(df.columns.index(c)).alias("c"), df["`" + c.replace("`", "``") + "`"].cast("string").alias("value")) for c in names])
    return df.select(F.inline(cells))


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(c, value, n): frequencies of the non-null values of each column."""
    return stacked(df, columns).where(F.col("value").isNotNull()).groupBy("c", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(counts: DataFrame, columns: list[str], most: int = TOP_VALUES) -> dict[str, list[tuple[str, int]]]:
    """The most frequent values of (c, value, n), ties by value. Top lists of
    hashed parts come first, so ranks never need a column's values in one task."""
    out: dict[str, list[tuple[str, int]]] = {c: [] for c in columns}
    for r in _top(counts, most).collect():
        out[columns[r["c"]]].append((r["value"], r["n"]))
    return {c: sorted(v, key=lambda x: (-x[1], x[0])) for c, v in out.items()}


def _top(counts: DataFrame, most: int) -> DataFrame:
    from pyspark.sql import Window as W

    order = [F.col("n").desc(), F.col("value").asc()]
    parts = 64
    salted = counts.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(parts)))
    local = salted.withColumn("r", F.row_number().over(W.partitionBy("c", "salt").orderBy(*order))).where(F.col("r") <= most)
    return local.withColumn("r", F.row_number().over(W.partitionBy("c").orderBy(*order))).where(F.col("r") <= most).select("c", "value", "n")


def numeric_frame(ds: Dataset, columns: list[str]) -> DataFrame:
    """(c, count, min, ..., negative_count): a row for each numeric column.

    One aggregate for the moments, and exact quantiles of the values and then of
    their distance from the median; stdev is 0 for a single value.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("c"), ds.number(c).alias("x")) for i, c in enumerate(columns)])
    long = ds.df.select(F.inline(cells)).where(F.col("x").isNotNull())
    moments = long.groupBy("c").agg(
        F.count("x").alias("count"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"),
        F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("stdev"), F.sum("x").alias("sum"),
        _count(F.col("x") == 0).alias("zero_count"), _count(F.col("x") < 0).alias("negative_count"),
    )
    names = ("p05", "p25", "median", "p75", "p95")
    q = quantiles(long, [0.05, 0.25, 0.5, 0.75, 0.95]).select("c", *[F.col(f"q{k}").alias(n) for k, n in enumerate(names)])
    away = long.join(F.broadcast(q.select("c", "median")), "c").select("c", F.abs(F.col("x") - F.col("median")).alias("x"))
    mad = quantiles(away, [0.5]).select("c", (F.col("q0") * MAD_SCALE).alias("mad"))
    out = moments.join(F.broadcast(q), "c").join(F.broadcast(mad), "c")  # a row for each column
    return out.select("c", "count", "min", "max", "mean", "stdev", "mad", "sum", *names, "zero_count", "negative_count")


def temporal_stats(ds: Dataset, column: str) -> TemporalStats | None:
    ts = ds.moment(column)
    r = ds.df.agg(F.min(ts).alias("a"), F.max(ts).alias("z")).first()
    if r["a"] is None:
        return None
    grain = temporal.detect_grain(ds.df, ts)
    periods = ds.df.select(temporal.bucket(ts, grain).alias("b")).where(F.col("b").isNotNull()).distinct().count()
    expected = temporal.expected_periods(r["a"], r["z"], grain)
    return TemporalStats(_iso(r["a"]), _iso(r["z"]), grain, periods, max(0, expected - periods))


def _iso(t: datetime) -> str:
    return t.isoformat(timespec="seconds")


def profile(ds: Dataset, columns: list[str] | None = None) -> list[ColumnProfile]:
    """Profiles of all or some columns. One exchange counts the values of all
    columns; types, distinct counts and top values come from it."""
    names = columns or ds.columns
    frame = ds.df.select(*[ds.raw(c).alias(c) for c in names])
    counts = value_counts(frame).persist()
    ds.rows = frame.count()
    per_column = {r["c"]: (r["known"], r["distinct"]) for r in counts.groupBy("c").agg(F.sum("n").alias("known"), F.count(F.lit(1)).alias("distinct")).collect()}
    known = {c: per_column.get(i, (0, 0))[0] for i, c in enumerate(names)}
    distinct = {c: per_column.get(i, (0, 0))[1] for i, c in enumerate(names)}
    invalid: dict[str, int] = {}
    text = [i for i, c in enumerate(names) if ds.is_text(c) and c not in ds.kinds]
    if text:
        found = _infer(counts.where(F.col("c").isin(text)), names)
        for i in text:
            ds.kinds[names[i]], invalid[names[i]], ds.day_first[names[i]] = found[names[i]]
    for c in names:  # native integers that are keys
        if not ds.is_text(c) and ds.kind(c) == "integer" and ds.rows >= 3 and distinct[c] == ds.rows and coerce.looks_like_id(c):
            ds.kinds[c] = "identifier"
    top = top_values(counts, names)
    counts.unpersist()
    numbers = [c for c in names if ds.kind(c) in NUMERIC]
    stats: dict[str, NumericStats] = {}
    if numbers:
        for r in numeric_frame(ds, numbers).collect():
            d = r.asDict()
            column = numbers[d.pop("c")]
            stats[column] = NumericStats(**d)
    head = frame.limit(HEAD).collect()
    out = []
    for c in names:
        kind = ds.kind(c)
        first = list(dict.fromkeys(r[c] for r in head if r[c] is not None))[:SAMPLES] or [v for v, _ in top[c][:SAMPLES]]
        out.append(ColumnProfile(
            c, kind, ds.rows, ds.rows - known[c], distinct[c], invalid.get(c, 0), ds.day_first.get(c, False), top[c], first,
            stats.get(c), temporal_stats(ds, c) if kind in TEMPORAL else None,
        ))
    return out


def type_histogram(profiles: list[ColumnProfile]) -> dict[str, int]:
    out: dict[str, int] = {}
    for p in profiles:
        out[p.logical_type] = out.get(p.logical_type, 0) + 1
    return out


def profile_frame(spark, profiles: list[ColumnProfile]) -> DataFrame:
    """Profiles as a DataFrame, a row for each column."""
    rows = [(p.name, p.logical_type, p.rows, p.null_count, p.distinct_count, p.invalid_count, float(p.null_rate), float(p.cardinality_ratio)) for p in profiles]
    return spark.createDataFrame(rows, "column string, logical_type string, rows long, nulls long, distinct_values long, invalid long, null_rate double, cardinality_ratio double")
