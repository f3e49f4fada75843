"""The semantic model: what columns mean, derived from profiles; look-ups by
name, and the guard that never sums a rate."""

from __future__ import annotations

import difflib

from gleaner.model import ROW_COUNT, TEMPORAL, TRUE_RATE, ColumnProfile, Dimension, Measure, SemanticModel, TimeAxis

MAX_GROUPABLE = 200
DISCRETE_VALUES, DISCRETE_ROWS = 12, 50

#: Substrings of column names, in either language.
ADDITIVE = (
    "amount", "revenue", "sales", "cost", "price", "total", "sum", "qty", "quantity", "count", "volume", "spend", "profit", "margin", "value", "gmv", "units",
    "orders", "сумма", "выручка", "продажи", "стоимость", "цена", "итог", "количество", "объем", "объём", "прибыль", "маржа", "заказы", "расход", "доход",
)
RATIO = (
    "rate", "ratio", "percent", "pct", "share", "avg", "average", "mean", "score", "index", "conversion", "ctr", "cpc", "cpm", "roi", "roas", "nps", "churn",
    "utilization", "utilisation", "temperature", "age", "balance", "level", "days", "duration", "latency", "elapsed", "lead_time", "age_days", "доля", "процент",
    "средн", "коэффициент", "индекс", "конверсия", "рейтинг", "возраст", "баланс", "уровень", "дней", "длительность", "срок",
)
LOWER_IS_BETTER = (
    "cost", "churn", "error", "defect", "latency", "delay", "complaint", "refund", "cancel", "bounce", "downtime", "incident", "loss", "debt",
    "wait", "failure", "расход", "затрат", "отток", "ошибк", "дефект", "задержк", "жалоб", "возврат", "отмен", "простой", "инцидент", "убыт", "потер", "ожидан", "сбо",
)
HIGHER_IS_BETTER = (
    "revenue", "profit", "sales", "margin", "conversion", "retention", "satisfaction", "nps", "growth", "roi", "roas", "uptime", "score",
    "rating", "engagement", "выручка", "прибыль", "продажи", "маржа", "конверсия", "удержан", "удовлетвор", "рост", "рейтинг", "вовлеч",
)
UNITS = (
    ("USD", ("usd", "$", "dollar")), ("EUR", ("eur", "€")), ("RUB", ("rub", "₽", "руб")),
    ("%", ("percent", "pct", "%", "rate", "ratio", "доля", "процент")), ("s", ("sec", "second", "секунд")),
    ("ms", ("ms", "millisecond")), ("days", ("day", "дн")),
)


class QueryError(ValueError):
    """A name that the model does not have, with what comes close."""

    def __init__(self, message: str, suggestions: list[str]):
        super().__init__(message + (f" Did you mean: {', '.join(suggestions)}?" if suggestions else ""))
        self.suggestions = suggestions


def _hinted(name: str, hints: tuple[str, ...]) -> bool:
    return any(h in name for h in hints)


def measure_of(p: ColumnProfile) -> Measure:
    name = p.name.lower()
    additive = not _hinted(name, RATIO) and (_hinted(name, ADDITIVE) or looks_additive(p))
    polarity = "lower_is_better" if _hinted(name, LOWER_IS_BETTER) else "higher_is_better" if _hinted(name, HIGHER_IS_BETTER) else "neutral"
    unit = next((u for u, marks in UNITS if any(m in name for m in marks)), None)
    about = "Additive: sums over any split." if additive else "A rate or level: averaged, never summed."
    return Measure(p.name, p.name, "sum" if additive else "avg", additive, polarity, unit, about)


def looks_additive(p: ColumnProfile) -> bool:
    """Without a hint: amounts have no negatives and are not bound to 0..1."""
    n = p.numeric
    if n is None or n.min < 0 or n.negative_count > 0.05 * n.count:
        return False
    return not (n.max <= 1 and p.logical_type == "number")


def build_model(profiles: list[ColumnProfile], rows: int) -> SemanticModel:
    model = SemanticModel(measures=[Measure(ROW_COUNT, "*", "count", True, "neutral", None, "Number of rows.")])
    for p in profiles:
        kind = p.logical_type
        if p.null_rate >= 0.98:
            model.ignored.append((p.name, f"{p.null_rate:.0%} of values are missing"))
        elif p.distinct_count <= 1 and rows > 1:
            model.ignored.append((p.name, "one value only"))
        elif kind in TEMPORAL:
            t = p.temporal
            model.times.append(TimeAxis(p.name, p.name, t.grain if t else "day", t.min if t else "", t.max if t else ""))
        elif kind == "identifier":
            model.identifiers.append(p.name)
        elif kind in ("number", "integer"):
            if kind == "integer" and p.distinct_count <= DISCRETE_VALUES and rows > DISCRETE_ROWS and not _hinted(p.name.lower(), ADDITIVE):
                model.dimensions.append(Dimension(p.name, p.name, p.distinct_count, True))
            model.measures.append(measure_of(p))
        elif kind == "boolean":
            model.dimensions.append(Dimension(p.name, p.name, p.distinct_count, True))
            rate = measure_of(p)
            model.measures.append(Measure(f"{p.name} {TRUE_RATE}", p.name, "avg", False, rate.polarity, "%", "Share of true values."))
        elif kind == "text" and p.cardinality_ratio > 0.9:
            model.ignored.append((p.name, "free text"))
        elif kind in ("category", "text"):
            model.dimensions.append(Dimension(p.name, p.name, p.distinct_count, p.distinct_count <= MAX_GROUPABLE))
        else:
            model.ignored.append((p.name, "no values"))
    model.grain_description = describe_grain(profiles, model, rows)
    return model


def describe_grain(profiles: list[ColumnProfile], model: SemanticModel, rows: int) -> str:
    parts = []
    if model.identifiers:
        p = next(p for p in profiles if p.name == model.identifiers[0])
        parts.append(f"one row is one '{p.name}'" if p.cardinality_ratio > 0.95 else f"'{p.name}' repeats ({p.distinct_count} values)")
    if model.times and model.times[0].grain != "irregular":
        parts.append(f"time step: {model.times[0].grain}")
    return f"{rows} rows: {'; '.join(parts)}." if parts else f"{rows} rows of unknown grain."


def describe_model(model: SemanticModel) -> str:
    out = [f"Grain: {model.grain_description}", f"Reviewed: {'yes' if model.reviewed else 'no'}", "", "MEASURES"]
    for m in model.measures:
        flags = ["additive" if m.additive else "not additive", f"default {m.aggregation}", *([f"unit {m.unit}"] if m.unit else []), *([m.polarity.replace("_", " ")] if m.polarity != "neutral" else [])]
        out.append(f"  {m.name} [{', '.join(flags)}]")
    out += ["", "DIMENSIONS", *(f"  {d.name} [{d.cardinality} values{'' if d.groupable else ', too many to group'}]" for d in model.dimensions)]
    if model.times:
        out += ["", "TIME AXES", *(f"  {t.name} [{t.grain}, {t.min[:10]} .. {t.max[:10]}]" for t in model.times)]
    if model.identifiers:
        out += ["", f"IDENTIFIERS: {', '.join(model.identifiers)}"]
    if model.ignored:
        out += ["", "IGNORED", *(f"  {c}: {why}" for c, why in model.ignored)]
    return "\n".join(out)


def find(items: list, name: str):
    """By name, then by column, whatever the case."""
    low = name.lower()
    return next((x for x in items if x.name.lower() == low), None) or next((x for x in items if x.column.lower() == low), None)


def suggest(name: str, known: list[str]) -> list[str]:
    low = {k.lower(): k for k in known}
    near = [k for k in known if name.lower() in k.lower()] + [low[x] for x in difflib.get_close_matches(name.lower(), low, 5, 0.5)]
    return list(dict.fromkeys(near))[:5] or known[:5]


def measure(model: SemanticModel, name: str) -> Measure:
    m = find(model.measures, name)
    if m is None:
        raise QueryError(f"There is no measure '{name}'.", suggest(name, [m.name for m in model.measures]))
    return m


def grouping(model: SemanticModel, name: str) -> TimeAxis | Dimension:
    """A time axis first, then a dimension."""
    g = find(model.times, name) or find(model.dimensions, name)
    if g is None:
        raise QueryError(f"There is no dimension '{name}'.", suggest(name, [g.name for g in (*model.times, *model.dimensions)]))
    return g


def guarded(m: Measure, wanted: str | None) -> tuple[str, str | None]:
    """(aggregation, note): the sum of a measure that is not additive is its average."""
    if wanted == "sum" and not m.additive:
        return "avg", f"'{m.name}' is not additive: the average is given instead of the sum."
    return wanted or m.aggregation, None


def update(model: SemanticModel, measures: dict[str, dict], reviewed: bool | None = None, grain_description: str | None = None) -> list[str]:
    """Patch the meaning of measures; returns the names that matched none."""
    from gleaner.model import AGGREGATIONS

    missed = []
    for name, patch in measures.items():
        m = find(model.measures, name)
        if m is None:
            missed.append(name)
            continue
        if (a := patch.get("aggregation")) is not None and a not in AGGREGATIONS:
            raise ValueError(f"unknown aggregation {a!r}")
        if (p := patch.get("polarity")) is not None and p not in ("neutral", "higher_is_better", "lower_is_better"):
            raise ValueError(f"unknown polarity {p!r}")
        for k in ("aggregation", "additive", "polarity", "unit"):
            if k in patch:
                setattr(m, k, patch[k])
    if reviewed is not None:
        model.reviewed = reviewed
    if grain_description is not None:
        model.grain_description = grain_description
    return missed

