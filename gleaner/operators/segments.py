"""Segments of dimensions: grouped moments for every measure in one pass,
ranks, concentration and pairwise correlation."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.stats import Moments
from gleaner.model import EMPTY, Dimension, Measure
from gleaner.operators.dataset import Dataset


@dataclass
class Segment:
    value: str
    rows: int
    total: dict[str, Moments] = field(default_factory=dict)
    prior: dict[str, Moments] = field(default_factory=dict)
    recent: dict[str, Moments] = field(default_factory=dict)
    rows_prior: int = 0
    rows_recent: int = 0
    #: Rows in the two halves of the calendar.
    rows_first: int = 0
    rows_second: int = 0


def _number(ds: Dataset, m: Measure) -> Column:
    return F.lit(1.0) if m.column == "*" else ds.number(m.column)


def moments_frame(ds: Dataset, dimensions: list[Dimension], measures: list[Measure], time: str | None = None, split: datetime | None = None) -> DataFrame:
    """(d, value, rows, ...): count, mean and variance of every measure for each
    value of each dimension, overall and before and from ``split``.

    Dimensions are grouping sets of one aggregate with partial sums; missing
    values are a segment of their own and apart from those of other sets.
    """
    keys = [F.coalesce(ds.raw(d.column), F.lit(EMPTY)).alias(f"k{i}") for i, d in enumerate(dimensions)]
    xs = [_number(ds, m).alias(f"x{i}") for i, m in enumerate(measures)]
    after = F.lit(None).cast("boolean") if time is None or split is None else ds.moment(time) >= F.lit(split)
    base = ds.df.select(*keys, *xs, after.alias("after"))
    # The side of the split is one more key, so each measure has three aggregates and not nine.
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i in range(len(measures)):
        x = F.col(f"x{i}")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.var_samp(x).alias(f"v{i}")]
    names = [f"k{i}" for i in range(len(dimensions))]
    out = base.groupingSets([[F.col(n), F.col("after")] for n in names], *[F.col(n) for n in names], F.col("after")).agg(*aggs, F.grouping_id().alias("gid"))
    # Of the bits, the last is the side's; that of a set's own dimension is 0.
    full = (1 << (len(names) + 1)) - 2
    d = F.lit(None).cast("int")
    value = F.lit(None).cast("string")
    for i, n in enumerate(names):
        own = F.col("gid") == full ^ (1 << (len(names) - i))
        d, value = F.when(own, F.lit(i)).otherwise(d), F.when(own, F.col(n)).otherwise(value)
    sides = out.withColumns({"d": d, "value": value})
    prior, recent = ~F.col("after"), F.col("after")
    merged = [F.sum("rows").alias("rows"), F.sum(F.when(prior, F.col("rows")).otherwise(0)).alias("rows_prior"), F.sum(F.when(recent, F.col("rows")).otherwise(0)).alias("rows_recent")]
    for i in range(len(measures)):
        for name, side in (("p", prior), ("r", recent)):
            merged += [F.coalesce(F.max(F.when(side, F.col(f"n{i}"))), F.lit(0)).alias(f"{name}n{i}"), F.max(F.when(side, F.col(f"a{i}"))).alias(f"{name}a{i}"), F.max(F.when(side, F.col(f"v{i}"))).alias(f"{name}v{i}")]
        merged.append(F.collect_list(F.struct(F.col(f"n{i}").cast("double").alias("n"), F.coalesce(f"a{i}", F.lit(0.0)).alias("m"), (F.coalesce(f"v{i}", F.lit(0.0)) * (F.col(f"n{i}") - 1)).alias("s"))).alias(f"t{i}"))
    grouped = sides.groupBy("d", "value").agg(*merged)  # at most three rows for each segment
    for i in range(len(measures)):
        t = F.aggregate(f"t{i}", F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s")), _merge)
        grouped = grouped.withColumn(f"t{i}", t)
        n = F.col(f"t{i}.n")
        grouped = grouped.withColumns({f"tn{i}": n.cast("long"), f"ta{i}": F.when(n > 0, F.col(f"t{i}.m")), f"tv{i}": F.when(n > 1, F.col(f"t{i}.s") / (n - 1))})
    return grouped.drop(*[f"t{i}" for i in range(len(measures))])


def _merge(a: Column, b: Column) -> Column:
    """Count, mean and sum of squared deviations of two groups together."""
    n, gap = a["n"] + b["n"], b["m"] - a["m"]
    both = F.struct(n.alias("n"), (a["m"] + gap * b["n"] / n).alias("m"), (a["s"] + b["s"] + gap * gap * a["n"] * b["n"] / n).alias("s"))
    return F.when(b["n"] == 0, a).when(a["n"] == 0, F.struct(b["n"].alias("n"), b["m"].alias("m"), b["s"].alias("s"))).otherwise(both)


def collect_segments(ds: Dataset, dimensions: list[Dimension], measures: list[Measure], time: str | None = None, split: datetime | None = None, most: int = 5000, middle: datetime | None = None) -> dict[str, list[Segment]]:
    """Segments of each dimension on the driver: those among the first ``most`` by rows
    or by the absolute sum of some measure, so none that weighs much is left out.
    With ``middle`` rows before and from that moment are counted, too."""
    if not dimensions:
        return {}
    frame = moments_frame(ds, dimensions, measures, time, split)
    weights = [F.col("rows").cast("double"), *(F.coalesce(F.abs(F.col(f"tn{i}") * F.col(f"ta{i}")), F.lit(0.0)) for i in range(len(measures)))]
    place = lambda w: F.row_number().over(W.partitionBy("d").orderBy(w.desc(), "value"))
    places = frame.withColumns({f"w{k}": w for k, w in enumerate(weights)})
    places = places.withColumns({f"place{k}": place(F.col(f"w{k}")) for k in range(len(weights))})
    top = places.where(F.least(*[F.col(f"place{k}") for k in range(len(weights))], F.lit(1 << 30)) <= most)
    out: dict[str, list[Segment]] = {d.name: [] for d in dimensions}
    for r in top.collect():
        s = Segment(r["value"], r["rows"], rows_prior=r["rows_prior"], rows_recent=r["rows_recent"])
        for i, m in enumerate(measures):
            for part, to in (("t", s.total), ("p", s.prior), ("r", s.recent)):
                to[m.name] = Moments.of(r[f"{part}n{i}"], r[f"{part}a{i}"], r[f"{part}v{i}"])
        out[dimensions[r["d"]].name].append(s)
    if middle is not None:
        known = {(dimensions[i].name, s.value): s for i, d in enumerate(dimensions) for s in out[d.name]}
        halves = moments_frame(ds, dimensions, [], time, middle).select("d", "value", "rows", "rows_prior", "rows_recent")
        order = W.partitionBy("d").orderBy(F.col("rows").desc(), "value")
        for r in halves.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).collect():
            if s := known.get((dimensions[r["d"]].name, r["value"])):
                s.rows_first, s.rows_second = r["rows_prior"], r["rows_recent"]
    return {k: sorted(v, key=lambda s: s.value) for k, v in out.items()}


def middle_moment(ds: Dataset, time: str) -> datetime | None:
    """The moment half way between the first and the last."""
    t = ds.moment(time)
    r = ds.df.agg(F.min(t).alias("a"), F.max(t).alias("z")).first()
    return None if r["a"] is None else r["a"] + (r["z"] - r["a"]) / 2


def split_moment(ds: Dataset, time: str) -> tuple[datetime | None, int]:
    """(the exact element n // 2 of the ordered known moments, n).

    Counts by day narrow the search to one day, then to an hour, a minute and a
    second of it: no task orders more than the moments of one second.
    """
    ts = ds.df.select(ds.moment(time).alias("t")).where(F.col("t").isNotNull())
    at = total = None
    for unit in ("day", "hour", "minute", "second", None):
        counts = ts.groupBy((F.col("t") if unit is None else F.date_trunc(unit, "t")).alias("u")).agg(F.count(F.lit(1)).alias("n"))
        if total is None:
            total = counts.agg(F.sum("n")).first()[0] or 0
            if not total:
                return None, 0
            at = total // 2
        upto = counts.withColumn("upto", F.sum("n").over(W.orderBy("u").rowsBetween(W.unboundedPreceding, 0)))
        hit = upto.where(F.col("upto") > at).orderBy("u").first()
        at -= hit["upto"] - hit["n"]
        if unit is None:
            return hit["u"], total
        ts = ts.where(F.date_trunc(unit, "t") == F.lit(hit["u"]))


def contributions(ds: Dataset, measure: Measure, dimension: Dimension, time: str, split: datetime) -> DataFrame:
    """(segment, n_prior, n_recent, mix, rate, delta) of an additive measure:
    what volume and what level add to its change, in one aggregate."""
    x = _number(ds, measure)
    after = ds.moment(time) >= F.lit(split)
    base = ds.df.select(F.coalesce(ds.raw(dimension.column), F.lit(EMPTY)).alias("segment"), x.alias("x"), after.alias("after")).where(F.col("after").isNotNull() & F.col("x").isNotNull())
    g = base.groupBy("segment").agg(F.count_if(~F.col("after")).alias("n_prior"), F.count_if("after").alias("n_recent"), F.coalesce(F.sum(F.when(~F.col("after"), F.col("x"))), F.lit(0.0)).alias("s0"), F.coalesce(F.sum(F.when(F.col("after"), F.col("x"))), F.lit(0.0)).alias("s1"))
    m0 = F.coalesce(F.try_divide("s0", "n_prior"), F.lit(0.0))
    m1 = F.coalesce(F.try_divide("s1", "n_recent"), F.lit(0.0))
    return g.select("segment", "n_prior", "n_recent", ((F.col("n_recent") - F.col("n_prior")) * m0).alias("mix"), (F.col("n_recent") * (m1 - m0)).alias("rate"), (F.col("s1") - F.col("s0")).alias("delta"))


def welch_frame(groups: DataFrame) -> DataFrame:
    """``groups`` (segment, n, mean, var) with t, df and d against the merged
    rest. The rest is the sum of the other segments' moments, taken as a window
    over segments, of which there are few."""
    every = W.partitionBy()
    n, m, v = F.col("n"), F.col("mean"), F.col("var")
    g = groups.withColumns({"total_n": F.sum("n").over(every), "grand": F.sum(n * m).over(every) / F.sum("n").over(every)})
    g = g.withColumn("all_m2", F.sum((n - 1) * v + n * (m - F.col("grand")) * (m - F.col("grand"))).over(every))
    rn = F.col("total_n") - n
    rm = (F.col("total_n") * F.col("grand") - n * m) / rn
    within = F.col("all_m2") - (n - 1) * v - n * (m - F.col("grand")) * (m - F.col("grand")) - rn * (rm - F.col("grand")) * (rm - F.col("grand"))
    rv = F.greatest(F.lit(0.0), within) / (rn - 1)
    se = v / n + rv / rn
    pooled = F.sqrt(((n - 1) * v + (rn - 1) * rv) / (n + rn - 2))
    df = se * se / ((v / n) * (v / n) / (n - 1) + (rv / rn) * (rv / rn) / (rn - 1))
    return g.where((n >= 2) & (rn >= 2)).select("segment", "n", "mean", rm.alias("rest_mean"), ((m - rm) / F.sqrt(se)).alias("t"), df.alias("df"), ((m - rm) / pooled).alias("d"))


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): the mean rank of every distinct value.

    Values are ordered by a range exchange after they are counted; prefix counts
    over partitions and inside each give ranks, and no task sees all values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("c"))
    parts = counts.repartitionByRange(column).withColumn("part", F.spark_partition_id())
    # The partitions of values are fixed by this copy, so that both uses agree.
    parts = parts.persist()
    before = parts.groupBy("part").agg(F.sum("c").alias("s")).select("part", F.coalesce(F.sum("s").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("c").over(W.partitionBy("part").orderBy(column).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = parts.withColumn("inside", inside).join(F.broadcast(before), "part")
    return ranked.select(column, (F.col("before") + F.col("inside") + (F.col("c") + 1) / 2.0).cast("double").alias(name))


def with_ranks(df: DataFrame, a: str, b: str) -> DataFrame:
    """(ra, rb): average ranks of the pairs in which both are known."""
    pairs = df.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return pairs.join(average_ranks(pairs, "a", "ra"), "a").join(average_ranks(pairs, "b", "rb"), "b").select("ra", "rb")


def spearman_frame(df: DataFrame, a: str, b: str) -> DataFrame:
    return with_ranks(df, a, b).agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("rho"))


def pearson_frame(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the correlation r_i_j and pair count n_i_j of all pairs."""
    aggs = []
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            aggs += [F.corr(a, columns[j]).alias(f"r_{i}_{j}"), F.count(F.when(F.col(a).isNotNull() & F.col(columns[j]).isNotNull(), 1)).alias(f"n_{i}_{j}")]
    return df.agg(*aggs)


def concentration_frame(values: DataFrame) -> DataFrame:
    """One row (segments, total, top_share, hhi, gini, to_80) of ``values``
    (segment, v) with v > 0: a row for each segment, of which there may be very many.

    Equal values are counted, ordered by a range exchange, and placed by prefix
    counts and sums over partitions and inside each; no task sees all segments.
    """
    v, c = F.col("v"), F.col("c")
    counts = values.where(v > 0).groupBy(v.cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    parts = counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()).persist()
    per_part = parts.groupBy("part").agg(F.sum("c").alias("pc"), F.sum(v * c).alias("ps"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    every = W.partitionBy()
    before = per_part.select("part", F.coalesce(F.sum("pc").over(earlier), F.lit(0)).alias("bc"), F.coalesce(F.sum("ps").over(earlier), F.lit(0.0)).alias("bs"), F.sum("pc").over(every).alias("n"), F.sum("ps").over(every).alias("total"))
    inside = W.partitionBy("part").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    placed = parts.withColumns({"ic": F.coalesce(F.sum("c").over(inside), F.lit(0)), "is": F.coalesce(F.sum(v * c).over(inside), F.lit(0.0))}).join(F.broadcast(before), "part")
    n, total = F.col("n"), F.col("total")
    smaller, less = F.col("bc") + F.col("ic"), F.col("bs") + F.col("is")
    share = v / total
    top = F.greatest(F.lit(0), F.least(c, smaller + c - (n - F.ceil(n * 0.1))))  # how many of these are among the top tenth
    larger = (total - less - v * c) / total  # share of all larger values
    reached = F.when((larger < 0.8) & (larger + share * c >= 0.8), n - smaller - c + F.ceil((0.8 - larger) / share))
    s = placed.agg(
        F.max("n").alias("segments"), F.max("total").alias("total"), F.sum(top * share).alias("top_share"), F.sum(c * share * share).alias("hhi"),
        (2 * F.sum(v * c * (smaller + (c + 1) / 2)) / (F.max("n") * F.max("total")) - (F.max("n") + 1) / F.max("n")).alias("gini"),
        F.min(reached).cast("long").alias("to_80"),
    )
    return s.select(F.coalesce("segments", F.lit(0)).alias("segments"), "total", "top_share", "hhi", "gini", "to_80")


def sums_by_segment(ds: Dataset, dimension: Dimension, measure: Measure) -> DataFrame:
    """(segment, v): rows or sums of a measure, for all values of a dimension."""
    v = F.count(F.lit(1)).cast("double") if measure.column == "*" else F.sum(ds.number(measure.column))
    return ds.df.groupBy(F.coalesce(ds.raw(dimension.column), F.lit(EMPTY)).alias("segment")).agg(v.alias("v"))


def stride_sample(df: DataFrame, order: str, most: int = 400) -> DataFrame:
    """Every k-th row in ``order`` so that ``most`` remain, from prefix counts."""
    n = df.count()
    parts = df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()).persist()
    before = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("c")).select("__part", F.coalesce(F.sum("c").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    i = F.col("__before") + F.row_number().over(W.partitionBy("__part").orderBy(order)) - 1
    out = parts.join(F.broadcast(before), "__part").withColumn("__i", i)
    if n > most:
        k = F.ceil(F.col("__i") * F.lit(most) / F.lit(n))
        out = out.where(F.floor(k * F.lit(n) / F.lit(most)) == F.col("__i")).where(k < most)
    return out.drop("__part", "__before", "__i")
