"""Data quality of a table: missing and invalid values, repeated rows and
identifiers, gaps on time axes. Thresholds are this engine's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.model import ColumnProfile, Evidence, Insight, Issue, QualityReport, Step
from gleaner.operators.dataset import Dataset

NULLS = INVALID = (0.01, 0.05, 0.30)
DUPLICATES = (0.0, 0.01, 0.05)
GAPS = 0.05
WEIGHTS = {"nulls": 0.5, "invalid": 0.5, "duplicates": 1.0, "gaps": 0.3}


def duplicates(df: DataFrame) -> DataFrame:
    """One row (rows, duplicate_rows): rows beyond the first of equal ones.

    Rows are compared by two independent hashes of all their columns, so that
    the exchange moves sixteen bytes for each row instead of the row.
    """
    cells = [df["`" + c.replace("`", "``") + "`"].cast("string") for c in df.columns]
    marked = [F.coalesce(F.concat(F.lit("v"), c), F.lit("n")) for c in cells]
    keys = df.select(F.xxhash64(*marked).alias("a"), F.xxhash64(F.lit(1), *reversed(marked)).alias("b"))
    groups = keys.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def _severity(rate: float, steps: tuple[float, float, float]) -> str | None:
    low, medium, high = steps
    return "high" if rate >= high else "medium" if rate >= medium else "low" if rate > 0 and rate >= low else None


def assess(ds: Dataset, profiles: list[ColumnProfile]) -> QualityReport:
    issues: list[Issue] = []
    rows = ds.count()
    for p in profiles:
        if s := _severity(p.null_rate, NULLS):
            issues.append(Issue("nulls", s, p.name, f"'{p.name}': {p.null_rate:.1%} of values are missing.", p.null_rate))
        bad = p.invalid_count / max(1, p.rows)
        if s := _severity(bad, INVALID):
            issues.append(Issue("invalid", s, p.name, f"'{p.name}': {bad:.1%} of values are no {p.logical_type}.", bad))
        if p.logical_type == "identifier" and p.cardinality_ratio < 1:
            issues.append(Issue("duplicates", "high", p.name, f"Identifier '{p.name}' repeats.", 1 - p.cardinality_ratio))
        if p.temporal and p.temporal.grain != "irregular":
            gaps = p.temporal.gaps / max(1, p.temporal.gaps + p.temporal.periods)
            if gaps > GAPS:
                issues.append(Issue("gaps", "medium", p.name, f"'{p.name}': {p.temporal.gaps} periods have no rows.", gaps))
    again = duplicates(ds.df).first()["duplicate_rows"] / max(1, rows)
    if s := _severity(again, DUPLICATES):
        issues.append(Issue("duplicates", s, None, f"{again:.1%} of rows repeat another row.", again))
    rates = {
        "nulls": sum(p.null_rate for p in profiles) / max(1, len(profiles)),
        "invalid": sum(p.invalid_count / max(1, p.rows) for p in profiles) / max(1, len(profiles)),
        "duplicates": again,
        "gaps": max([0.0, *(i.rate for i in issues if i.kind == "gaps")]),
    }
    score = 1.0
    for k, r in rates.items():
        score *= 1 - WEIGHTS[k] * min(1.0, r)
    issues.sort(key=lambda i: (("high", "medium", "low").index(i.severity), -i.rate))
    return QualityReport(max(0.0, min(1.0, score)), issues, [_insight(k, [i for i in issues if i.kind == k], rows, len(profiles)) for k in dict.fromkeys(i.kind for i in issues)])


def _insight(kind: str, issues: list[Issue], rows: int, columns: int) -> Insight:
    names = {"nulls": "Missing values", "invalid": "Values of the wrong type", "duplicates": "Repeated rows or identifiers", "gaps": "Periods without rows"}
    worst = issues[0]
    impact = {"low": 0.2, "medium": 0.5, "high": 0.8}[worst.severity]
    return Insight(
        f"quality-{kind}", "quality", f"{names[kind]}: {worst.message}", f"{names[kind]} limit what can be concluded from this table. " + " ".join(i.message for i in issues[:4]),
        impact, 1.0, impact, [i.column or "*" for i in issues],
        Evidence(worst.rate, "Share affected", None, None, None, "", rows, [(i.column or "rows", f"{i.rate:.2%} ({i.severity})") for i in issues[:8]]),
        [f"{columns} columns and {rows} rows were checked."], ["Thresholds are conventions, not tests."],
        [Step("fix_data", f"Repair {names[kind].lower()} at the source", worst.message)],
    )
