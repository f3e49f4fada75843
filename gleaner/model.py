"""Domain objects: profiles, the semantic model, queries, findings."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, is_dataclass
from types import UnionType
from typing import Any, Union, get_args, get_origin, get_type_hints

NUMERIC = ("number", "integer", "boolean")
TEMPORAL = ("date", "datetime")
AGGREGATIONS = ("sum", "avg", "min", "max", "count", "count_distinct", "median")
GRAINS = ("hour", "day", "week", "month", "quarter", "year", "irregular")
FILTERS = ("eq", "neq", "in", "contains", "gt", "gte", "lt", "lte", "between", "is_null", "not_null")

#: Names of what has no column of its own.
ROW_COUNT = "row_count"
EMPTY = "(empty)"
TRUE_RATE = "(true rate)"


@dataclass
class NumericStats:
    count: int
    min: float
    max: float
    mean: float
    median: float
    stdev: float
    mad: float
    p05: float
    p25: float
    p75: float
    p95: float
    sum: float
    zero_count: int
    negative_count: int


@dataclass
class TemporalStats:
    min: str
    max: str
    grain: str
    periods: int
    gaps: int


@dataclass
class ColumnProfile:
    name: str
    logical_type: str
    rows: int
    null_count: int
    distinct_count: int
    invalid_count: int = 0
    day_first: bool = False
    top_values: list[tuple[str, int]] = field(default_factory=list)
    samples: list[str] = field(default_factory=list)
    numeric: NumericStats | None = None
    temporal: TemporalStats | None = None

    @property
    def null_rate(self) -> float:
        return self.null_count / self.rows if self.rows else 0.0

    @property
    def cardinality_ratio(self) -> float:
        known = self.rows - self.null_count
        return self.distinct_count / known if known else 0.0


@dataclass
class Measure:
    name: str
    column: str
    aggregation: str = "sum"
    additive: bool = True
    polarity: str = "neutral"
    unit: str | None = None
    description: str = ""


@dataclass
class Dimension:
    name: str
    column: str
    cardinality: int = 0
    groupable: bool = True


@dataclass
class TimeAxis:
    name: str
    column: str
    grain: str = "day"
    min: str = ""
    max: str = ""


@dataclass
class SemanticModel:
    measures: list[Measure] = field(default_factory=list)
    dimensions: list[Dimension] = field(default_factory=list)
    times: list[TimeAxis] = field(default_factory=list)
    identifiers: list[str] = field(default_factory=list)
    ignored: list[tuple[str, str]] = field(default_factory=list)
    grain_description: str = ""
    reviewed: bool = False

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> SemanticModel:
        return cls(
            [Measure(**m) for m in d.get("measures", [])], [Dimension(**m) for m in d.get("dimensions", [])], [TimeAxis(**m) for m in d.get("times", [])],
            list(d.get("identifiers", [])), [tuple(x) for x in d.get("ignored", [])], d.get("grain_description", ""), bool(d.get("reviewed", False)),
        )


@dataclass
class Filter:
    field: str
    op: str
    value: Any = None


@dataclass
class Metric:
    measure: str
    aggregation: str | None = None


@dataclass
class Query:
    metrics: list[Metric]
    group_by: list[str] = field(default_factory=list)
    time_grain: str | None = None
    filters: list[Filter] = field(default_factory=list)
    order_by: list[tuple[str, str]] = field(default_factory=list)  # (output label, asc|desc)
    limit: int | None = None


@dataclass
class QueryResult:
    columns: list[str]
    rows: list[tuple]
    rows_scanned: int
    rows_total: int
    truncated: bool
    notes: list[str]
    explanation: str


@dataclass
class Step:
    type: str  # investigate | monitor | act | fix_data
    action: str
    rationale: str
    query: Query | None = None


@dataclass
class Evidence:
    statistic: float | None = None
    statistic_label: str = ""
    p_value: float | None = None
    q_value: float | None = None
    effect_size: float | None = None
    effect_label: str = ""
    sample_size: int = 0
    facts: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Chart:
    type: str  # line | bar | scatter | hbar
    x_label: str
    y_label: str
    series: list[tuple[str, list[tuple[Any, float]]]] = field(default_factory=list)


@dataclass
class Insight:
    id: str
    kind: str
    title: str
    narrative: str
    impact: float
    confidence: float
    score: float
    subjects: list[str]
    evidence: Evidence
    trace: list[str]
    caveats: list[str]
    next_steps: list[Step]
    chart: Chart | None = None


@dataclass
class Hypothesis:
    id: str
    kind: str
    question: str
    priority: float
    params: dict[str, str]


@dataclass
class Issue:
    kind: str
    severity: str  # low | medium | high
    column: str | None
    message: str
    rate: float


@dataclass
class QualityReport:
    score: float
    issues: list[Issue]
    insights: list[Insight]


@dataclass
class Event:
    phase: str
    message: str
    progress: float
    payload: Any = None


def revive(kind, data):
    """A value of a dataclass, or of a type made of such, from what ``asdict`` and JSON left."""
    if data is None:
        return None
    if is_dataclass(kind):
        hints = get_type_hints(kind)
        return kind(**{f.name: revive(hints[f.name], data[f.name]) for f in fields(kind) if f.name in data})
    args = get_args(kind)
    if isinstance(kind, UnionType) or get_origin(kind) is Union:
        return revive(next(a for a in args if a is not type(None)), data)
    if get_origin(kind) is list:
        return [revive(args[0], x) for x in data]
    if get_origin(kind) is tuple:
        return tuple(revive(a, x) for a, x in zip(args, data, strict=True))
    return data
