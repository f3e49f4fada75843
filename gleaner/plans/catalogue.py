"""Named queries over the test tables, with the same in SQL.

Models are explicit, so that nothing depends on guesses from column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import coerce, stats, temporal
from gleaner.functions import columns as C
from gleaner.model import EMPTY, Dimension, Filter, Measure, Metric, Query, SemanticModel, TimeAxis
from gleaner.operators import profile, quality, segments, series
from gleaner.operators.dataset import Dataset
from gleaner.plans import agent
from gleaner.plans.query import Plan

Run = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Models

ORDERS = SemanticModel(
    [Measure("row_count", "*", "count"), Measure("revenue", "o_totalprice", "sum", True, "higher_is_better"), Measure("customers", "o_custkey", "count_distinct", False)],
    [Dimension("priority", "o_orderpriority", 5), Dimension("status", "o_orderstatus", 3), Dimension("customer", "o_custkey", 1500, False)],
    [TimeAxis("order_date", "o_orderdate", "day")], ["o_orderkey"],
)
LINES = SemanticModel(
    [Measure("row_count", "*", "count"), Measure("quantity", "l_quantity", "sum"), Measure("price", "l_extendedprice", "sum"), Measure("discount", "l_discount", "avg", False, "neutral", "%"), Measure("tax", "l_tax", "avg", False, "neutral", "%")],
    [Dimension("return_flag", "l_returnflag", 3), Dimension("line_status", "l_linestatus", 2), Dimension("supplier", "l_suppkey", 100)],
    [TimeAxis("ship_date", "l_shipdate", "day")],
)
EVENTS = SemanticModel(
    [Measure("row_count", "*", "count"), Measure("value", "value", "sum"), Measure("level", "value", "avg", False)],
    [Dimension("type", "event_type", 5), Dimension("user", "user_id", 150)], [TimeAxis("ts", "ts", "day")],
)
PARTS = SemanticModel([Measure("row_count", "*", "count"), Measure("retail", "p_retailprice", "avg", False)], [Dimension("brand", "p_brand", 25), Dimension("type", "p_type", 6), Dimension("part", "p_partkey", 2000, False)])
CUSTOMERS = SemanticModel([Measure("row_count", "*", "count"), Measure("balance", "c_acctbal", "avg", False)], [Dimension("segment", "c_mktsegment", 5), Dimension("nation", "c_nationkey", 25)])


def dataset(spark: SparkSession, sf_dir: str, name: str) -> Dataset:
    models = {"orders": ORDERS, "lineitem": LINES, "events": EVENTS, "part": PARTS, "customer": CUSTOMERS}
    return Dataset(name, table(spark, sf_dir, name), model=models[name])


def semantic_query(name: str, **parts) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Plan(dataset(spark, sf_dir, name), Query(**parts)).limited()

    return run


def with_nulls(spark: SparkSession, sf_dir: str, name: str, column: str, value: str) -> Dataset:
    """A dataset in which one value of a column is missing instead."""
    ds = dataset(spark, sf_dir, name)
    ds.df = ds.df.withColumn(column, F.nullif(F.col(column), F.lit(value)))
    return ds


def r6(c: Column) -> Column:
    return F.floor(c * 1e6 + 0.5) / 1e6


R6 = "floor(({}) * 1e6 + 0.5) / 1e6".format
QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, run: Run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def query(name: str, sql: str | None = None):
    def add(f: Run) -> Run:
        register(name, f, sql)
        return f

    return add


# Aggregation

register(
    "sem_sum_by_month_priority", semantic_query("orders", metrics=[Metric("revenue")], group_by=["order_date", "priority"], time_grain="month", filters=[Filter("status", "in", ["F", "O"])], limit=5000),
    f"""SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS order_date, o_orderpriority AS priority, {R6('sum(o_totalprice)')} AS "sum(revenue)"
    FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 5000""",
)
_AGG = {"sum": "sum(l_extendedprice)", "avg": "avg(l_extendedprice)", "min": "min(l_extendedprice)", "max": "max(l_extendedprice)", "count": "count(l_extendedprice)", "count_distinct": "count(DISTINCT CAST(l_extendedprice AS VARCHAR))", "median": "quantile_cont(l_extendedprice, 0.5)"}
for _how, _sql in _AGG.items():
    register(
        f"agg_{_how}", semantic_query("lineitem", metrics=[Metric("price", _how)], group_by=["return_flag", "line_status"], limit=5000),
        f'SELECT l_returnflag AS return_flag, l_linestatus AS line_status, {R6(f"CAST({_sql} AS DOUBLE)")} AS "{_how}(price)" FROM lineitem GROUP BY 1, 2',
    )
_LABELS = {"hour": "'%Y-%m-%d %H:00'", "day": "'%Y-%m-%d'", "week": "'%Y-%m-%d'", "month": "'%Y-%m'", "year": "'%Y'"}
for _grain in ("hour", "day", "week", "month", "quarter", "year"):
    _name, _col, _table, _m, _x = ("ts", "ts", "events", "value", "value") if _grain in ("hour", "day", "week") else ("order_date", "o_orderdate", "orders", "revenue", "o_totalprice")
    _label = f"concat(year({_col}), '-Q', quarter({_col}))" if _grain == "quarter" else f"strftime(date_trunc('{_grain}', {_col}), {_LABELS[_grain]})"
    register(
        f"grain_{_grain}", semantic_query(_table, metrics=[Metric("row_count"), Metric(_m)], group_by=[_name], time_grain=_grain, limit=5000),
        f'SELECT {_label} AS {_name}, CAST(count(*) AS DOUBLE) AS "count(row_count)", {R6(f"sum({_x})")} AS "sum({_m})" FROM {_table} GROUP BY 1 ORDER BY 1 LIMIT 5000',
    )


# Filters

_COUNTED = dict(metrics=[Metric("row_count"), Metric("balance")], group_by=["segment"])
_SEG = f"""SELECT coalesce(c_mktsegment, '{EMPTY}') AS segment, CAST(count(*) AS DOUBLE) AS "count(row_count)", {R6('avg(c_acctbal)')} AS "avg(balance)" FROM customer"""
_FILTERS = {
    "eq": (Filter("nation", "eq", 7), "CAST(c_nationkey AS VARCHAR) = '7'"),
    "neq": (Filter("segment", "neq", "BUILDING"), "c_mktsegment IS DISTINCT FROM 'BUILDING'"),
    "in": (Filter("nation", "in", [1, 2, 3]), "CAST(c_nationkey AS VARCHAR) IN ('1', '2', '3')"),
    "gt": (Filter("balance", "gt", 5000), "c_acctbal > 5000"),
    "gte": (Filter("c_acctbal", "gte", "5000.5"), "c_acctbal >= 5000.5"),
    "lt": (Filter("balance", "lt", 0), "c_acctbal < 0"),
    "lte": (Filter("c_nationkey", "lte", 4), "c_nationkey <= 4"),
    "between": (Filter("balance", "between", [3000, 1000]), "c_acctbal BETWEEN 1000 AND 3000"),
    "contains": (Filter("c_name", "contains", "CUSTOMER#00000001"), "contains(lower(c_name), 'customer#00000001')"),
}
for _op, (_f, _where) in _FILTERS.items():
    register(f"filter_{_op}", semantic_query("customer", **_COUNTED, filters=[_f]), f"{_SEG} WHERE {_where} GROUP BY 1")
_MISSING = _SEG.replace("FROM customer", "FROM (SELECT * REPLACE (nullif(c_mktsegment, 'BUILDING') AS c_mktsegment) FROM customer)")
for _op, _where in (("is_null", "c_mktsegment IS NULL"), ("not_null", "c_mktsegment IS NOT NULL")):
    def _run(spark, sf_dir, op=_op):
        return Plan(with_nulls(spark, sf_dir, "customer", "c_mktsegment", "BUILDING"), Query(**_COUNTED, filters=[Filter("segment", op)])).limited()

    register(f"filter_{_op}", _run, f"{_MISSING} WHERE {_where} GROUP BY 1")
register(
    "filter_between_dates", semantic_query("orders", metrics=[Metric("row_count")], group_by=["status"], filters=[Filter("order_date", "between", ["1996-01-01", "1996-12-31"])]),
    """SELECT o_orderstatus AS status, CAST(count(*) AS DOUBLE) AS "count(row_count)" FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' GROUP BY 1""",
)
register(
    "guard_sum_ratio_becomes_avg", semantic_query("lineitem", metrics=[Metric("discount", "sum"), Metric("tax", "sum")], group_by=["return_flag"]),
    f'SELECT l_returnflag AS return_flag, {R6("avg(l_discount)")} AS "avg(discount)", {R6("avg(l_tax)")} AS "avg(tax)" FROM lineitem GROUP BY 1',
)


@query("group_null_label", f"""SELECT coalesce(nullif(event_type, 'click'), '{EMPTY}') AS type, CAST(count(*) AS DOUBLE) AS "count(row_count)", {R6('sum(value)')} AS "sum(value)" FROM events GROUP BY 1""")
def group_null_label(spark, sf_dir):
    return Plan(with_nulls(spark, sf_dir, "events", "event_type", "click"), Query([Metric("row_count"), Metric("value")], ["type"])).limited()


register(
    "global_agg_empty", semantic_query("orders", metrics=[Metric("row_count"), Metric("revenue")], filters=[Filter("revenue", "lt", -1)]),
    f'SELECT CAST(count(*) AS DOUBLE) AS "count(row_count)", {R6("sum(o_totalprice)")} AS "sum(revenue)" FROM orders WHERE o_totalprice < -1 HAVING count(*) > 0',
)
register(
    "global_agg", semantic_query("orders", metrics=[Metric("row_count"), Metric("revenue", "median"), Metric("customers")]),
    f'SELECT CAST(count(*) AS DOUBLE) AS "count(row_count)", {R6("quantile_cont(o_totalprice, 0.5)")} AS "median(revenue)", CAST(count(DISTINCT o_custkey) AS DOUBLE) AS "count_distinct(customers)" FROM orders',
)
register(
    "order_limit_topk", semantic_query("part", metrics=[Metric("retail", "max")], group_by=["part"], order_by=[("max(retail)", "desc"), ("part", "asc")], limit=25),
    f'SELECT CAST(p_partkey AS VARCHAR) AS part, {R6("max(p_retailprice)")} AS "max(retail)" FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25',
)


# Profiles

_STACK = "UNION ALL".join(f" SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM customer " for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


@query("profile_nulls_distinct", f"SELECT col AS \"column\", count(*) AS rows, count(*) - count(v) AS nulls, count(DISTINCT v) AS distinct_values FROM ({_STACK}) GROUP BY 1")
def profile_nulls_distinct(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    names = F.array(*[F.lit(c) for c in df.columns])
    cells = profile.stacked(df)
    counts = cells.groupBy("c").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value").isNull()).alias("nulls"))
    distinct = profile.value_counts(df).groupBy("c").agg(F.count(F.lit(1)).alias("distinct_values"))
    return counts.join(distinct, "c").select(F.element_at(names, F.col("c") + 1).alias("column"), "rows", "nulls", "distinct_values")


_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount")
_NUMERIC_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(x) AS "count", {R6('min(x)')} AS "min", {R6('max(x)')} AS "max", {R6('avg(x)')} AS mean, {R6('stddev_samp(x)')} AS stdev, {R6('1.4826 * quantile_cont(abs(x - m), 0.5)')} AS mad,
    {R6('quantile_cont(x, 0.05)')} AS p05, {R6('quantile_cont(x, 0.25)')} AS p25, {R6('quantile_cont(x, 0.5)')} AS median, {R6('quantile_cont(x, 0.75)')} AS p75, {R6('quantile_cont(x, 0.95)')} AS p95,
    count_if(x = 0) AS zero_count, count_if(x < 0) AS negative_count FROM (SELECT {c} AS x, (SELECT quantile_cont({c}, 0.5) FROM lineitem) AS m FROM lineitem)"""
    for c in _NUMERIC
)


@query("profile_numeric", f"SELECT \"column\", \"count\", \"min\", \"max\", mean, stdev, mad, p05, p25, median, p75, p95, CAST(zero_count AS BIGINT) AS zero_count, CAST(negative_count AS BIGINT) AS negative_count FROM ({_NUMERIC_SQL})")
def profile_numeric(spark, sf_dir):
    out = profile.numeric_frame(dataset(spark, sf_dir, "lineitem"), list(_NUMERIC))
    reals = ("min", "max", "mean", "stdev", "mad", "p05", "p25", "median", "p75", "p95")
    names = F.array(*[F.lit(c) for c in _NUMERIC])
    return out.select(F.element_at(names, F.col("c") + 1).alias("column"), "count", *[r6(F.col(c)).alias(c) for c in reals], "zero_count", "negative_count")


@query("profile_top_values", """SELECT CAST(user_id AS VARCHAR) AS value, n, n / (SELECT count(*) FROM events)::DOUBLE AS share FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, value LIMIT 12""")
def profile_top_values(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("user_id")
    top = profile._top(profile.value_counts(df), profile.TOP_VALUES)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return top.join(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"))


@query(
    "profile_temporal_grain",
    """WITH d AS (SELECT DISTINCT epoch_us(ts) AS us FROM events), g AS (SELECT us - lag(us) OVER (ORDER BY us) AS gap FROM d)
    SELECT (SELECT count(*) FROM d) AS n, floor((SELECT quantile_cont(gap, 0.5) FROM g)) AS median_gap_us,
    CASE WHEN (SELECT quantile_cont(gap, 0.5) FROM g) < 7.2e9 THEN 'hour' ELSE 'day' END AS grain""",
)
def profile_temporal_grain(spark, sf_dir):
    ds = dataset(spark, sf_dir, "events")
    out = temporal.grain_frame(ds.df, ds.moment("ts"))
    grain = F.lit("irregular")
    for g, most in reversed(temporal.GAP_HOURS):
        grain = F.when(F.col("median_gap_us") < most * 3.6e9, g).otherwise(grain)
    return out.select("n", F.floor("median_gap_us").cast("double").alias("median_gap_us"), grain.alias("grain"))


def _infer_sql(name: str, columns: list[str]) -> str:
    """The rules for plain texts: ISO dates, booleans, then numbers with a point."""
    one = """SELECT '{c}' AS "column", CASE WHEN dates >= greatest(2, 0.9 * n) THEN 'date' WHEN bools >= 0.9 * n THEN 'boolean' WHEN nums >= 0.9 * n AND ints >= 0.99 * greatest(1, nums) THEN 'integer' WHEN nums >= 0.9 * n THEN 'number' WHEN d <= greatest(50, 0.5 * n) THEN 'category' ELSE 'text' END AS logical_type,
    rows, rows - n AS nulls, d AS distinct_values, CASE WHEN dates >= greatest(2, 0.9 * n) THEN n - dates WHEN bools >= 0.9 * n THEN n - bools WHEN nums >= 0.9 * n THEN n - nums ELSE 0 END AS invalid, CAST((rows - n) / rows AS DOUBLE) AS null_rate, d / n::DOUBLE AS cardinality_ratio
    FROM (SELECT count(*) AS rows, count(v) AS n, count(DISTINCT v) AS d, count_if(lower(v) IN ('true', 'yes', 'y', '1', 't', 'false', 'no', 'n', '0', 'f')) AS bools, count_if(regexp_full_match(v, '-?[0-9]*[.]?[0-9]+')) AS nums,
    count_if(regexp_full_match(v, '-?[0-9]+([.]0+)?')) AS ints, count_if(regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) AS dates FROM (SELECT CAST({c} AS VARCHAR) AS v FROM {t}))"""
    return " UNION ALL ".join(one.format(c=c, t=name) for c in columns)


@query("infer_types", _infer_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]))
def infer_types(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    ds = Dataset("customer", df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]))
    return profile.profile_frame(spark, profile.profile(ds))


#: Texts and what they must be read as.
_NUMBERS = ["1 234,56", "1,234.56", "1.234,56", "$1,200", "(500)", "12,5%", "1,234", "1,23", "text", "", "-7", "+7", "1e3", "0,125", "1.234.567", "5.", ".5", "(-3)", "NaN", "1d"]
_NUMBER_VALUES = [1234.56, 1234.56, 1234.56, 1200, -500, 0.125, 1234, 1.23, None, None, -7, 7, 1000, 125, None, None, 0.5, 3, None, None]


def _values_sql(rows, names: str) -> str:
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return f"(VALUES {', '.join('(' + ', '.join(lit(v) for v in r) + ')' for r in rows)}) AS t({names})"


@query("coerce_number_suite", f"SELECT raw, CAST(v AS DOUBLE) AS value FROM {_values_sql(list(zip(_NUMBERS, _NUMBER_VALUES, strict=True)), 'raw, v')}")
def coerce_number_suite(spark, sf_dir):
    df = spark.createDataFrame([(x,) for x in _NUMBERS], "raw string")
    return df.select("raw", r6(coerce.number_of(F.col("raw"))).alias("value"))


_DATES = ["2025-03-15", "2025-03-15T10:30:00Z", "2025-03-15 10:30", "2025-03-15T10:30:00+03:00", "25/03/2025", "31.02.2025", "2025/3/5", "2025-7", "1700000000", "1700000000000", "20250315", "no date", "13/13/2025"]
_DATE_VALUES = ["2025-03-15 00:00:00", "2025-03-15 10:30:00", "2025-03-15 10:30:00", "2025-03-15 07:30:00", "2025-03-25 00:00:00", "2025-03-03 00:00:00", "2025-03-05 00:00:00", "2025-07-01 00:00:00", "2023-11-14 22:13:20", "2023-11-14 22:13:20", None, None, None]


@query("coerce_date_suite", f"SELECT raw, v AS value FROM {_values_sql(list(zip(_DATES, _DATE_VALUES, strict=True)), 'raw, v')}")
def coerce_date_suite(spark, sf_dir):
    df = spark.createDataFrame([(x,) for x in _DATES], "raw string")
    return df.select("raw", F.date_format(coerce.date_of(F.col("raw"), True), "yyyy-MM-dd HH:mm:ss").alias("value"))


@query(
    "semantic_model_df",
    """WITH s AS (SELECT 'o_orderkey' AS c, 'n' AS k, count(DISTINCT o_orderkey) AS d, count(*) AS n FROM orders UNION ALL SELECT 'o_custkey', 'n', count(DISTINCT o_custkey), count(*) FROM orders UNION ALL SELECT 'o_totalprice', 'n', count(DISTINCT o_totalprice), count(*) FROM orders
    UNION ALL SELECT 'o_orderstatus', 't', count(DISTINCT o_orderstatus), count(*) FROM orders UNION ALL SELECT 'o_orderpriority', 't', count(DISTINCT o_orderpriority), count(*) FROM orders),
    g AS (SELECT quantile_cont(gap, 0.5) / 3.6e9 AS hours FROM (SELECT us - lag(us) OVER (ORDER BY us) AS gap FROM (SELECT DISTINCT epoch_us(o_orderdate) AS us FROM orders)))
    SELECT 'measure' AS role, 'row_count' AS name, '*' AS "column", 'count' AS detail, true AS additive UNION ALL SELECT 'measure', c, c, 'sum', true FROM s WHERE k = 'n' AND d > 12
    UNION ALL SELECT 'dimension', c, c, NULL, NULL FROM s WHERE k = 't' AND d <= greatest(50, 0.5 * n) UNION ALL SELECT 'time', 'o_orderdate', 'o_orderdate', CASE WHEN hours < 2 THEN 'hour' WHEN hours < 48 THEN 'day' WHEN hours < 240 THEN 'week' WHEN hours < 1080 THEN 'month' WHEN hours < 3120 THEN 'quarter' WHEN hours < 12000 THEN 'year' ELSE 'irregular' END, NULL FROM g""",
)
def semantic_model_df(spark, sf_dir):
    from gleaner.plans.semantic import build_model

    ds = Dataset("orders", table(spark, sf_dir, "orders"))
    model = build_model(profile.profile(ds), ds.count())
    rows = [("measure", m.name, m.column, m.aggregation, m.additive) for m in model.measures] + [("dimension", d.name, d.column, None, None) for d in model.dimensions]
    rows += [("time", t.name, t.column, t.grain, None) for t in model.times] + [("identifier", c, c, None, None) for c in model.identifiers] + [("ignored", c, c, why, None) for c, why in model.ignored]
    return spark.createDataFrame(rows, "role string, name string, column string, detail string, additive boolean")


# Series

_DAILY = "SELECT date_trunc('day', ts) AS bucket, count(*) AS n, sum(value) AS v FROM events GROUP BY 1"


def _daily(spark, sf_dir) -> DataFrame:
    ds = dataset(spark, sf_dir, "events")
    return series.buckets(ds, [ds.model.measures[1]], ds.model.times[0], "day")


@query(
    "ts_gap_fill_additive",
    f"""WITH p AS (SELECT date_trunc('hour', ts) AS bucket, count(*) AS n, sum(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1),
    s AS (SELECT unnest(generate_series((SELECT min(bucket) FROM p), (SELECT max(bucket) FROM p), INTERVAL 1 HOUR)) AS bucket)
    SELECT strftime(s.bucket, '%Y-%m-%d %H:00') AS label, coalesce(n, 0) AS rows, {R6('coalesce(v, 0)')} AS value FROM s LEFT JOIN p ON s.bucket = p.bucket""",
)
def ts_gap_fill_additive(spark, sf_dir):
    ds = dataset(spark, sf_dir, "events")
    ds.df = ds.df.where("event_type = 'purchase'")
    out = series.filled(series.buckets(ds, [ds.model.measures[1]], ds.model.times[0], "hour"), "hour", [True])
    return out.select(temporal.label(F.col("bucket"), "hour").alias("label"), "rows", r6(F.col("v0")).alias("value"))


@query(
    "ts_trim_partial",
    f"""WITH p AS (SELECT date_trunc('month', o_orderdate) AS bucket, count(*) AS n, sum(o_totalprice) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-25' AND o_orderdate < TIMESTAMP '2001-07-05' GROUP BY 1),
    q AS (SELECT *, row_number() OVER (ORDER BY bucket) AS i, count(*) OVER () AS k FROM p), m AS (SELECT quantile_cont(n, 0.5) AS typical FROM q WHERE i > 1 AND i < k)
    SELECT strftime(bucket, '%Y-%m') AS label, n AS rows, {R6('v')} AS value FROM q, m WHERE NOT ((i = 1 OR i = k) AND n < 0.5 * typical)""",
)
def ts_trim_partial(spark, sf_dir):
    ds = dataset(spark, sf_dir, "orders")
    ds.df = ds.df.where("o_orderdate >= timestamp_ntz'1995-01-25' and o_orderdate < timestamp_ntz'2001-07-05'")
    out = series.trimmed(series.buckets(ds, [ds.model.measures[1]], ds.model.times[0], "month"))
    return out.select(temporal.label(F.col("bucket"), "month").alias("label"), "rows", r6(F.col("v0")).alias("value"))


@query(
    "trend_ols",
    f"""WITH d AS ({_DAILY}), i AS (SELECT row_number() OVER (ORDER BY bucket) - 1 AS i, count(*) OVER () AS k, v FROM d)
    SELECT count(*) AS n, {R6('regr_slope(v, i)')} AS slope, {R6('regr_intercept(v, i)')} AS intercept, {R6('regr_r2(v, i)')} AS r2,
    {R6('avg(v) FILTER (i < greatest(1, k // 3))')} AS first_third, {R6('avg(v) FILTER (i >= k - greatest(1, k // 3))')} AS last_third FROM i""",
)
def trend_ols(spark, sf_dir):
    out = series.trend_frame(_daily(spark, sf_dir))
    return out.select("n", *[r6(F.col(c)).alias(c) for c in ("slope", "intercept", "r2", "first_third", "last_third")])


@query(
    "changepoint_scan",
    f"""WITH d AS ({_DAILY}), i AS (SELECT row_number() OVER (ORDER BY bucket) - 1 AS i, count(*) OVER () AS k, v FROM d),
    s AS (SELECT a.i AS idx, avg(b.v) FILTER (b.i < a.i) AS m1, avg(b.v) FILTER (b.i >= a.i) AS m2, var_samp(b.v) FILTER (b.i < a.i) AS v1, var_samp(b.v) FILTER (b.i >= a.i) AS v2, a.i AS n1, a.k - a.i AS n2
      FROM i a, i b WHERE a.i >= greatest(4, floor(a.k * 0.15)) AND a.i <= a.k - greatest(4, floor(a.k * 0.15)) GROUP BY a.i, a.k)
    SELECT CAST(idx AS BIGINT) AS idx, {R6('m1')} AS mean_before, {R6('m2')} AS mean_after, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 4) AS t FROM s ORDER BY abs((m1 - m2) / sqrt(v1 / n1 + v2 / n2)) DESC, idx LIMIT 1""",
)
def changepoint_scan(spark, sf_dir):
    out = series.changepoint_frame(_daily(spark, sf_dir))
    return out.select(F.col("idx").cast("long").alias("idx"), r6(F.col("mean_before")).alias("mean_before"), r6(F.col("mean_after")).alias("mean_after"), F.round("t", 4).alias("t"))


_Z = f"WITH d AS ({_DAILY}), m AS (SELECT quantile_cont(v, 0.5) AS med FROM d), s AS (SELECT 1.4826 * quantile_cont(abs(v - med), 0.5) AS mad FROM d, m)"


@query("anomaly_robust_z", f"{_Z} SELECT strftime(bucket, '%Y-%m-%d') AS label, {R6('v')} AS value, round((v - med) / mad, 6) AS z FROM d, m, s")
def anomaly_robust_z(spark, sf_dir):
    out = series.anomaly_frame(_daily(spark, sf_dir))
    return out.select(temporal.label(F.col("bucket"), "day").alias("label"), r6(F.col("value")).alias("value"), F.round("z", 6).alias("z"))


def _erf_sql(x: str) -> str:
    p, *a = stats.ERF
    t = f"(1 / (1 + {p} * abs({x})))"
    poly = "0.0"
    for c in reversed(a):
        poly = f"(({poly} + {c}) * {t})"
    return f"(CASE WHEN {x} < 0 THEN -1.0 ELSE 1.0 END * (1 - {poly} * exp(-({x}) * ({x}))))"


@query("normal_pvalue_as_erf", f"""{_Z}, z AS (SELECT bucket, round((v - med) / mad, 6) AS z FROM d, m, s) SELECT strftime(bucket, '%Y-%m-%d') AS label, z, round(least(1.0, greatest(0.0, 2 * (1 - 0.5 * (1 + {_erf_sql('(abs(z) / sqrt(2.0))')})))), 9) AS p FROM z""")
def normal_pvalue_as_erf(spark, sf_dir):
    out = anomaly_robust_z(spark, sf_dir)
    return out.select("label", "z", F.round(C.normal_two_sided(F.col("z")), 9).alias("p"))


# Segments

_SPLIT = "(SELECT o_orderdate FROM orders ORDER BY o_orderdate LIMIT 1 OFFSET (SELECT count(*) // 2 FROM orders))"


@query(
    "driver_contributions",
    f"""WITH g AS (SELECT o_orderpriority AS segment, count_if(o_orderdate < {_SPLIT}) AS n0, count_if(o_orderdate >= {_SPLIT}) AS n1, coalesce(sum(o_totalprice) FILTER (o_orderdate < {_SPLIT}), 0) AS s0, coalesce(sum(o_totalprice) FILTER (o_orderdate >= {_SPLIT}), 0) AS s1 FROM orders GROUP BY 1)
    SELECT segment, CAST(n0 AS BIGINT) AS n_prior, CAST(n1 AS BIGINT) AS n_recent, round((n1 - n0) * (s0 / n0), 3) AS mix, round(n1 * (s1 / n1 - s0 / n0), 3) AS rate, round(s1 - s0, 3) AS delta FROM g""",
)
def driver_contributions(spark, sf_dir):
    ds = dataset(spark, sf_dir, "orders")
    split, _ = segments.split_moment(ds, "o_orderdate")
    out = segments.contributions(ds, ds.model.measures[1], ds.model.dimensions[0], "o_orderdate", split)
    return out.select("segment", "n_prior", "n_recent", *[F.round(c, 3).alias(c) for c in ("mix", "rate", "delta")])


@query(
    "segment_moments",
    f"""SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'return_flag' ELSE 'line_status' END AS dimension, coalesce(l_returnflag, l_linestatus) AS value, count(*) AS rows, count(l_quantity) AS n_quantity, {R6('avg(l_quantity)')} AS mean_quantity, round(var_samp(l_quantity), 4) AS var_quantity, {R6('avg(l_discount)')} AS mean_discount
    FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))""",
)
def segment_moments(spark, sf_dir):
    ds = dataset(spark, sf_dir, "lineitem")
    dims, ms = ds.model.dimensions[:2], [ds.model.measures[1], ds.model.measures[3]]
    out = segments.moments_frame(ds, dims, ms)
    name = F.element_at(F.array(*[F.lit(d.name) for d in dims]), F.col("d") + 1)
    return out.select(name.alias("dimension"), "value", "rows", F.col("tn0").alias("n_quantity"), r6(F.col("ta0")).alias("mean_quantity"), F.round("tv0", 4).alias("var_quantity"), r6(F.col("ta1")).alias("mean_discount"))


@query(
    "comparison_welch",
    """WITH g AS (SELECT DISTINCT l_suppkey AS k FROM lineitem), s AS (SELECT CAST(g.k AS VARCHAR) AS segment, count(l_quantity) FILTER (l_suppkey = g.k) AS n, avg(l_quantity) FILTER (l_suppkey = g.k) AS m, var_samp(l_quantity) FILTER (l_suppkey = g.k) AS v,
      count(l_quantity) FILTER (l_suppkey <> g.k) AS rn, avg(l_quantity) FILTER (l_suppkey <> g.k) AS rm, var_samp(l_quantity) FILTER (l_suppkey <> g.k) AS rv FROM lineitem, g GROUP BY g.k)
    SELECT segment, n, round(m, 6) AS mean, round(rm, 6) AS rest_mean, round((m - rm) / sqrt(v / n + rv / rn), 5) AS t,
    round(pow(v / n + rv / rn, 2) / (pow(v / n, 2) / (n - 1) + pow(rv / rn, 2) / (rn - 1)), 3) AS df, round((m - rm) / sqrt(((n - 1) * v + (rn - 1) * rv) / (n + rn - 2)), 6) AS d FROM s""",
)
def comparison_welch(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    g = df.groupBy(F.col("l_suppkey").cast("string").alias("segment")).agg(F.count("l_quantity").alias("n"), F.avg("l_quantity").alias("mean"), F.var_samp("l_quantity").alias("var"))
    out = segments.welch_frame(g)
    return out.select("segment", "n", F.round("mean", 6).alias("mean"), F.round("rest_mean", 6).alias("rest_mean"), F.round("t", 5).alias("t"), F.round("df", 3).alias("df"), F.round("d", 6).alias("d"))


_PS = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205]


@query("bh_adjust", f"""WITH p AS (SELECT CAST(p AS DOUBLE) AS p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM {_values_sql([(p,) for p in _PS], 'p')}) SELECT p, round(least(1.0, min(p * n / k) OVER (ORDER BY k DESC)), 9) AS q FROM p""")
def bh_adjust(spark, sf_dir):
    return C.benjamini_hochberg(spark.createDataFrame([(p,) for p in _PS], "p double"), "p").select("p", F.round("q", 9).alias("q"))


@query(
    "concentration_shares",
    """WITH g AS (SELECT c_nationkey AS segment, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
    s AS (SELECT v / sum(v) OVER () AS share, row_number() OVER (ORDER BY v DESC) AS place, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n, sum(v) OVER (ORDER BY v DESC) / sum(v) OVER () AS run, v, sum(v) OVER () AS total FROM g WHERE v > 0)
    SELECT count(*) AS segments, round(max(total), 2) AS total, round(sum(share) FILTER (place <= ceil(n * 0.1)), 9) AS top_share, round(sum(share * share), 9) AS hhi, round(2 * sum(i * v) / (max(n) * max(total)) - (max(n) + 1) / max(n), 9) AS gini, CAST(count_if(run < 0.8) + 1 AS BIGINT) AS to_80 FROM s""",
)
def concentration_shares(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    out = segments.concentration_frame(rows.groupBy(F.col("c_nationkey").alias("segment")).agg(F.sum("o_totalprice").alias("v")))
    return out.select("segments", F.round("total", 2).alias("total"), *[F.round(c, 9).alias(c) for c in ("top_share", "hhi", "gini")], "to_80")


_CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("corr_pearson_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 8) AS r FROM lineitem" for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]))
def corr_pearson_matrix(spark, sf_dir):
    row = segments.pearson_frame(table(spark, sf_dir, "lineitem").select(*_CORR), list(_CORR))
    pairs = [(i, j) for i in range(len(_CORR)) for j in range(i + 1, len(_CORR))]
    cells = F.array(*[F.struct(F.lit(_CORR[i]).alias("a"), F.lit(_CORR[j]).alias("b"), F.col(f"n_{i}_{j}").alias("n"), F.round(f"r_{i}_{j}", 8).alias("r")) for i, j in pairs])
    return row.select(F.inline(cells))


@query(
    "corr_spearman",
    """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS ra, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS rb FROM lineitem)
    SELECT count(*) AS n, round(corr(CAST(ra AS DOUBLE), CAST(rb AS DOUBLE)), 8) AS rho FROM r""",
)
def corr_spearman(spark, sf_dir):
    out = segments.spearman_frame(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select("n", F.round("rho", 8).alias("rho"))


@query("pair_sample_stride", """WITH o AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS i, (SELECT count(*) FROM part) AS n FROM part), k AS (SELECT DISTINCT CASE WHEN n <= 400 THEN i ELSE floor(x * n / 400.0) END AS pick FROM o, range(400) r(x) WHERE i < 400 OR n <= 400) SELECT p_partkey, p_size FROM o WHERE i IN (SELECT pick FROM k)""")
def pair_sample_stride(spark, sf_dir):
    return segments.stride_sample(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")


# Distributions

_TS = [(2.228, 10.0), (1.96, 1e6), (0.0, 5.0), (-3.5, 30.0), (12.0, 3.0)]


#: Integrals of the densities by Simpson's rule, from the value to infinity.
_SIMPSON = "sum(y * CASE WHEN i % 2 = 1 THEN 4 ELSE 2 END) / 3 / 20000"


@query(
    "student_t_pvalue",
    f"""WITH v AS (SELECT CAST(t AS DOUBLE) AS t, CAST(df AS DOUBLE) AS df FROM {_values_sql(_TS, 't, df')}), g AS (SELECT t, df, i, abs(t) + u / (1 - u) AS x, u, exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) AS c FROM (SELECT t, df, i, i / 20000::DOUBLE AS u FROM v, range(1, 20000) r(i))),
    f AS (SELECT t, df, i, c * exp(-(df + 1) / 2 * ln(1 + x * x / df)) / ((1 - u) * (1 - u)) AS y, c FROM g)
    SELECT t, df, round(2 * ({_SIMPSON} + max(c) * exp(-(df + 1) / 2 * ln(1 + t * t / df)) / 3 / 20000), 6) AS p FROM f GROUP BY t, df""",
)
def student_t_pvalue(spark, sf_dir):
    return spark.createDataFrame([(t, df, round(stats.t_two_sided(t, df), 6)) for t, df in _TS], "t double, df double, p double")


_CHI = [(3.841, 1.0), (5.991, 2.0), (0.0, 3.0), (30.0, 10.0)]


@query(
    "chi_square_pvalue",
    f"""WITH v AS (SELECT CAST(x AS DOUBLE) AS x0, CAST(df AS DOUBLE) AS df FROM {_values_sql(_CHI, 'x, df')}), g AS (SELECT x0, df, i, x0 + u / (1 - u) AS x, u, -lgamma(df / 2) - df / 2 * ln(2) AS c FROM (SELECT x0, df, i, i / 20000::DOUBLE AS u FROM v, range(1, 20000) r(i))),
    f AS (SELECT x0, df, i, exp(c + (df / 2 - 1) * ln(x) - x / 2) / ((1 - u) * (1 - u)) AS y, c FROM g)
    SELECT x0 AS x, df, round({_SIMPSON} + CASE WHEN x0 > 0 THEN exp(max(c) + (df / 2 - 1) * ln(greatest(x0, 1e-300)) - x0 / 2) / 3 / 20000 ELSE 0 END, 6) AS p FROM f GROUP BY x0, df""",
)
def chi_square_pvalue(spark, sf_dir):
    rows = [(x, df, round(stats.chi_square_p(x, df), 6)) for x, df in _CHI]
    return spark.createDataFrame(rows, "x double, df double, p double")


# Quality and text

_DIRTY = "SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END AS status, CAST(o_orderkey AS VARCHAR) AS k FROM orders UNION ALL SELECT o_orderstatus, CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 10 = 1"


@query("quality_nulls_dups", f"WITH d AS ({_DIRTY}) SELECT count(*) AS rows, count(*) - count(status) AS nulls, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicate_rows FROM d")
def quality_nulls_dups(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey")
    key = F.col("o_orderkey").cast("string").alias("k")
    dirty = o.select(F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus")).alias("status"), key).unionAll(o.where("o_orderkey % 10 = 1").select(F.col("o_orderstatus").alias("status"), key))
    counts = dirty.agg(F.count_if(F.col("status").isNull()).alias("nulls"))
    return quality.duplicates(dirty).join(F.broadcast(counts)).select("rows", "nulls", "duplicate_rows")


_SETS = [["revenue", "region"], ["revenue", "region", "EMEA"], ["seats"], ["revenue"], []]


@query(
    "jaccard_dedupe",
    f"""WITH m AS (SELECT i, w FROM {_values_sql([(i, w) for i, s in enumerate(_SETS) for w in s], 'i, w')}), n AS (SELECT i, (SELECT count(*) FROM m WHERE m.i = r.i) AS k FROM range({len(_SETS)}) r(i))
    SELECT CAST(x.i AS INTEGER) AS a, CAST(y.i AS INTEGER) AS b, round(CASE WHEN x.k = 0 OR y.k = 0 THEN 0.0 ELSE c / (x.k + y.k - c)::DOUBLE END, 6) AS similarity
    FROM (SELECT x.i, x.k, y.i AS j, y.k AS l, (SELECT count(*) FROM m p JOIN m q ON p.w = q.w WHERE p.i = x.i AND q.i = y.i) AS c FROM n x JOIN n y ON x.i < y.i) z JOIN n x ON x.i = z.i JOIN n y ON y.i = z.j""",
)
def jaccard_dedupe(spark, sf_dir):
    sets = _SETS
    rows = [(i, j, round(agent.jaccard(set(a), set(b)), 6)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j]
    return spark.createDataFrame(rows, "a int, b int, similarity double")


@query("json_flatten_props", "SELECT event_id, " + ", ".join(f"json_extract_string(props, '$.{k}') AS \"props.{k}\"" for k in ("k",)) + " FROM events")
def json_flatten_props(spark, sf_dir):
    from gleaner.sources.text import flatten_json

    return flatten_json(table(spark, sf_dir, "events").select("event_id", "props"), "props", "k string")


# Runs


_ORDERS_SQL = """m AS (SELECT * FROM (VALUES (1, 'row_count', false, true, 0.65), (2, 'revenue', true, false, 0.8), (3, 'customers', false, false, 0.5)) AS t(i, name, additive, counts, p)),
    d AS (SELECT * FROM (VALUES (1, 'priority', 5, true), (2, 'status', 3, true), (3, 'customer', 1500, false)) AS t(j, name, n, groupable)), g AS (SELECT * FROM (VALUES (1, 'day'), (2, 'week')) AS t(k, grain))"""


@query(
    "hypotheses",
    f"""WITH {_ORDERS_SQL}, h AS (SELECT 1 AS s, i, k, 0 AS b, 'trend' AS kind, concat('Does ''', name, ''' change steadily along ''order_date'' by ', grain, '?') AS question, p * 0.9 AS priority FROM m, g
    UNION ALL SELECT 1, i, k, 1, 'anomaly', concat('Are there odd periods of ''', name, ''' by ', grain, ' of ''order_date''?'), p * 0.9 * 0.85 FROM m, g
    UNION ALL SELECT 2, i, j, 0, 'driver', concat('Which values of ''', d.name, ''' move ''', m.name, '''?'), p FROM m, d WHERE groupable AND n BETWEEN 2 AND 20
    UNION ALL SELECT 3, i, j, 0, 'comparison', concat('Does ''', m.name, ''' differ between values of ''', d.name, '''?'), p * 0.8 FROM m, d WHERE NOT counts AND groupable AND n BETWEEN 2 AND 20
    UNION ALL SELECT 4, i, j, 0, 'concentration', concat('Does ''', m.name, ''' rest on few values of ''', d.name, '''?'), p * 0.7 FROM m, d WHERE (additive OR counts) AND n >= 5
    UNION ALL SELECT 5, a.i, b.i, 0, 'correlation', concat('Do ''', a.name, ''' and ''', b.name, ''' vary together?'), (a.p + b.p) / 2 * 0.55 FROM m a, m b WHERE a.i < b.i AND NOT a.counts AND NOT b.counts)
    SELECT concat(kind, '-', row_number() OVER (ORDER BY s, i, k, b)) AS id, kind, question, round(priority, 9) AS priority FROM h""",
)
def hypotheses(spark, sf_dir):
    found = agent.hypotheses(dataset(spark, sf_dir, "orders"))
    return spark.createDataFrame([(h.id, h.kind, h.question, round(float(h.priority), 9)) for h in found], "id string, kind string, question string, priority double")


@query("insights_run")
def insights_run(spark, sf_dir):
    ds = Dataset("orders", table(spark, sf_dir, "orders"))
    return agent.insight_frame(spark, agent.run_all(ds).insights)


@query(
    "star_revenue_by_segment",
    f"SELECT c_mktsegment, n_name, count(*) AS orders, {R6('sum(o_totalprice)')} AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
)
def star_revenue_by_segment(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return joined.groupBy("c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("orders"), r6(F.sum("o_totalprice")).alias("revenue"))
