"""Semantic queries compiled to one DataFrame plan: resolve names, filter,
bucket, aggregate, round, order and limit. Catalyst does the rest."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import temporal
from gleaner.functions.quantiles import quantiles
from gleaner.model import AGGREGATIONS, EMPTY, FILTERS, GRAINS, NUMERIC, TEMPORAL, Filter, Query, QueryResult, TimeAxis
from gleaner.operators.dataset import Dataset
from gleaner.plans import semantic

DEFAULT_LIMIT, MAX_LIMIT = 500, 5000  # of rendered answers
BROADCAST_IN = 1000


def rounded(value: Column) -> Column:
    """Six decimals, halves upwards; what is not finite becomes 0."""
    v = value.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(F.when(F.abs(v) < 9e12, F.floor(v * 1e6 + 0.5) / 1e6).otherwise(v))


def aggregate(ds: Dataset, column: str, how: str) -> Column:
    """One of the seven aggregations; ``*`` always counts rows."""
    if column == "*":
        return F.count(F.lit(1)).cast("double")
    if how == "count_distinct":
        return F.countDistinct(ds.raw(column)).cast("double")
    x = ds.number(column)
    match how:
        case "sum":
            return F.sum(x)
        case "avg":
            return F.avg(x)
        case "min":
            return F.min(x)
        case "max":
            return F.max(x)
        case "count":
            return F.count(x).cast("double")
        case "median":
            return F.percentile(x, F.lit(0.5))
    raise semantic.QueryError(f"There is no aggregation '{how}'.", semantic.suggest(how, list(AGGREGATIONS)))


# Filters


def _column_of(ds: Dataset, field: str) -> str:
    if field in ds.columns:
        return field
    for items in (ds.model.measures, ds.model.dimensions, ds.model.times):
        if (x := semantic.find(items, field)) and x.column != "*":
            return x.column
    raise semantic.QueryError(f"There is no field '{field}'.", semantic.suggest(field, ds.columns))


def parse_moment(v: Any) -> datetime | None:
    """ISO dates and datetimes; without zone they are UTC."""
    if isinstance(v, datetime):
        return v if v.tzinfo else v.replace(tzinfo=timezone.utc)
    try:
        t = datetime.fromisoformat(str(v).strip())
    except ValueError:
        return None
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


def _bound(ds: Dataset, column: str, v: Any) -> Column | None:
    if ds.kind(column) in TEMPORAL:
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return F.timestamp_millis(F.lit(int(v)))
        t = parse_moment(v)
        return None if t is None else F.timestamp_micros(F.lit(round(t.timestamp() * 1_000_000)))
    if isinstance(v, bool):
        return F.lit(float(v))
    text = str(v).strip() if v is not None else ""
    try:
        return F.lit(float(text) if text else 0.0)
    except ValueError:
        return None


def _left(ds: Dataset, column: str) -> Column:
    if ds.kind(column) in TEMPORAL:
        return ds.moment(column)
    if ds.kind(column) in NUMERIC and not ds.is_text(column):
        return ds.native(column)  # unwrapped, so that the test reaches the scan
    return ds.number(column)


def predicate(ds: Dataset, f: Filter) -> Column:
    """A condition that is never null. Equality is on text; a missing value
    equals nothing, so ``neq`` holds for it and everything else does not."""
    if f.op not in FILTERS:
        raise semantic.QueryError(f"There is no filter '{f.op}'.", semantic.suggest(f.op, list(FILTERS)))
    column = _column_of(ds, f.field)
    raw = ds.raw(column)
    match f.op:
        case "is_null":
            return ds.native(column).isNull()
        case "not_null":
            return ds.native(column).isNotNull()
        case "eq":
            return _implied(ds, column, [f.value]) & (raw == F.lit(str(f.value)))
        case "neq":
            return ~raw.eqNullSafe(F.lit(str(f.value)))
        case "in":
            values = f.value if isinstance(f.value, (list, tuple, set)) else [f.value]
            return _implied(ds, column, values) & raw.isin([str(v) for v in values])
        case "contains":
            return F.contains(F.lower(raw), F.lower(F.lit(str(f.value))))
        case "between":
            if not isinstance(f.value, (list, tuple)) or len(f.value) != 2:
                return F.lit(False)
            a, b = (_bound(ds, column, v) for v in f.value)
            return F.lit(False) if a is None or b is None else _left(ds, column).between(F.least(a, b), F.greatest(a, b))
    bound = _bound(ds, column, f.value)
    if bound is None:
        return F.lit(False)
    x = _left(ds, column)
    return {"gt": x > bound, "gte": x >= bound, "lt": x < bound, "lte": x <= bound}[f.op]


def _implied(ds: Dataset, column: str, values) -> Column:
    """A test on the native column that equality of texts implies, for the scan: a number
    whose text is ``v`` equals the number that ``v`` reads as."""
    if ds.is_text(column) or ds.kind(column) not in NUMERIC:
        return F.lit(True)
    try:
        numbers = [float(str(v)) for v in values]
    except ValueError:
        return F.lit(True)
    if not numbers or any(not abs(x) < 2**53 for x in numbers):
        return F.lit(True)
    whole = all(x == int(x) for x in numbers)
    if ds.kind(column) == "integer" and not whole:
        return F.lit(False)
    return ds.native(column).isin([int(x) for x in numbers] if ds.kind(column) == "integer" else numbers)


def apply_filters(ds: Dataset, filters: list[Filter]) -> DataFrame:
    df = ds.df
    for f in filters:
        df = df.where(predicate(ds, f))
    return df


# Compilation


class Plan:
    """The compiled query: ``frame`` is the ordered result before the limit."""

    def __init__(self, ds: Dataset, query: Query, lenient: bool = False):
        self.ds, self.query, self.notes = ds, query, []
        if not query.metrics:
            raise semantic.QueryError("A query needs a metric.", [m.name for m in ds.model.measures][:5])
        if query.time_grain and query.time_grain not in GRAINS:
            raise semantic.QueryError(f"There is no grain '{query.time_grain}'.", list(GRAINS))
        self.metrics: list[tuple[str, Column]] = []
        medians: dict[int, str] = {}
        for m in query.metrics:
            found = semantic.measure(ds.model, m.measure)
            how, note = semantic.guarded(found, m.aggregation)
            if note:
                self.notes.append(note)
            label = f"{m.aggregation or found.aggregation if found.column == '*' else how}({found.name})"
            if how == "median" and found.column != "*":  # by prefix counts, below
                medians[len(self.metrics)] = found.column
                self.metrics.append((label, F.first(F.lit(None).cast("double"))))
            else:
                self.metrics.append((label, rounded(aggregate(ds, found.column, how))))
        self.groups: list[tuple[str, Column, bool]] = []
        for g in query.group_by:
            found = semantic.grouping(ds.model, g)
            if isinstance(found, TimeAxis):
                grain = query.time_grain or found.grain
                ts = ds.moment(found.column)
                self.groups.append((g, temporal.label(temporal.bucket(ts, grain), grain), True))
            else:
                if not found.groupable:
                    self.notes.append(f"'{found.name}' has {found.cardinality} values: only the first rows are shown.")
                self.groups.append((g, F.coalesce(ds.raw(found.column), F.lit(EMPTY)), False))
        labels = [n for n, _, _ in self.groups] + [n for n, _ in self.metrics]
        if len(set(labels)) != len(labels):
            raise semantic.QueryError("A metric or group is named twice.", [])
        self.columns = labels
        self.filtered = apply_filters(ds, query.filters)
        out = self.filtered
        times = [k for k, (_, _, is_time) in enumerate(self.groups) if is_time]
        keys = [c.alias(f"g{k}") for k, (_, c, _) in enumerate(self.groups)]
        values = [v.alias(f"m{k}") for k, (_, v) in enumerate(self.metrics)]
        if keys:
            for k in times:  # rows without a moment are in no period
                found = semantic.grouping(ds.model, self.groups[k][0])
                out = out.where(ds.moment(found.column).isNotNull())
            rows, out = out, out.groupBy(*keys).agg(*values)
        else:
            rows, out = out, out.agg(F.count(F.lit(1)).alias("n"), *values).where("n > 0").drop("n")
        for k, column in medians.items():
            # The built-in median holds a group's values in one reducer.
            group = F.struct(*keys) if keys else F.lit(0)
            found = quantiles(rows.select(group.alias("c"), ds.number(column).alias("x")), [0.5]).select(F.col("c").alias("__c"), rounded(F.col("q0")).alias("__median"))
            own = F.struct(*[F.col(f"g{i}") for i in range(len(keys))]) if keys else F.lit(0)
            out = out.join(found, own == F.col("__c"), "left").withColumn(f"m{k}", F.col("__median")).drop("__c", "__median")
        self.frame = self._ordered(out, lenient).toDF(*labels)

    def _ordered(self, df: DataFrame, lenient: bool) -> DataFrame:
        names = [f"g{k}" for k in range(len(self.groups))] + [f"m{k}" for k in range(len(self.metrics))]
        by_label = dict(zip(self.columns, names, strict=True))
        order = []
        for label, direction in self.query.order_by:
            if label in by_label:
                c = F.col(by_label[label])
                c = F.collate(c, "ru") if by_label[label].startswith("g") else c
                order.append(c.desc_nulls_first() if direction == "desc" else c.asc_nulls_last())
            elif not lenient:
                raise semantic.QueryError(f"There is no output column '{label}'.", semantic.suggest(label, self.columns))
        if not order:
            order = [F.col("g0").asc_nulls_last()] if self.groups and self.groups[0][2] else [F.col("m0").desc_nulls_first()]
        rest = [F.col(f"g{k}").asc_nulls_last() for k in range(len(self.groups))]  # ties have one order
        return df.select(*names).orderBy(*order, *rest)

    @property
    def limit(self) -> int:
        return max(1, min(self.query.limit or DEFAULT_LIMIT, MAX_LIMIT))

    def limited(self) -> DataFrame:
        return self.frame.limit(self.limit)

    def whole(self) -> DataFrame:
        """All rows, or as many as the query asks for itself."""
        return self.frame.limit(self.query.limit) if self.query.limit else self.frame

    def explain(self, scanned: int, total: int) -> str:
        q = self.query
        parts = [", ".join(n for n, _ in self.metrics)]
        if self.groups:
            parts.append("by " + ", ".join(n for n, _, _ in self.groups) + (f" ({q.time_grain})" if q.time_grain else ""))
        if q.filters:
            parts.append("where " + " and ".join(f"{f.field} {f.op}" + (f" {f.value!r}" if f.value is not None else "") for f in q.filters))
        return f"{' '.join(parts)}. {scanned} of {total} rows used." + "".join(f" {n}" for n in self.notes)


def run(ds: Dataset, query: Query, lenient: bool = False) -> QueryResult:
    """Compile, count what is scanned, and fetch the rows of the limit."""
    plan = Plan(ds, query, lenient)
    total = ds.count()
    scanned = plan.filtered.count() if query.filters else total
    rows = [tuple(r) for r in plan.frame.limit(plan.limit + 1).collect()]
    return QueryResult(plan.columns, rows[: plan.limit], scanned, total, len(rows) > plan.limit, plan.notes, plan.explain(scanned, total))


def from_plan(metrics: list[dict], group_by: list[str], grain: str | None, filters: list[dict], top: int | None, ds: Dataset) -> Query:
    """A query from a planner's answer: at most three metrics, ``in`` lists split
    at commas, and a top-N ordered by the first metric."""
    from gleaner.model import Metric

    built = [Metric(m["measure"], m.get("aggregation")) for m in metrics[:3]]
    tests = []
    for f in filters:
        v = f.get("value")
        if f["op"] == "in" and isinstance(v, str):
            v = [x.strip() for x in v.split(",")]
        if f["op"] == "between" and isinstance(v, str):
            v = [x.strip() for x in v.split(",")]
        tests.append(Filter(f["field"], f["op"], v))
    order = []
    if top and built:
        m = semantic.measure(ds.model, built[0].measure)
        how = built[0].aggregation or m.aggregation if m.column == "*" else semantic.guarded(m, built[0].aggregation)[0]
        order = [(f"{how}({m.name})", "desc")]
    return Query(built, group_by, grain, tests, order, top)
