"""The insight run: enumerate hypotheses, collect their statistics in a few
batched passes, test, correct for the number of tests, rank and sum up."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

from gleaner.functions import stats
from gleaner.functions.temporal import COARSER
from gleaner.model import Event, Hypothesis, Insight, Measure, QualityReport, Step
from gleaner.operators import analyzers, profile, segments, series
from gleaner.operators.dataset import Dataset
from gleaner.operators.quality import assess
from gleaner.plans import semantic
from gleaner.plans.semantic import build_model

log = logging.getLogger(__name__)

#: Limits and weights of a run.
MAX_HYPOTHESES, MAX_INSIGHTS = 220, 14
LEAST_CONFIDENCE, LEAST_SCORE = 0.25, 0.04
SAME, FAMILIAR, FADE = 0.65, 0.3, 0.8
EVENT_EVERY = 15
KIND_WEIGHT = {"trend": 0.9, "anomaly": 0.9 * 0.85, "driver": 1.0, "comparison": 0.8, "concentration": 0.7, "correlation": 0.55}
#: Words in a question that point to a kind of finding, by their stems.
FOCUS = {
    "trend": ("trend", "dynamic", "тренд", "динамика"), "anomaly": ("anomal", "outlier", "аномал", "выброс"),
    "driver": ("why", "driver", "reason", "почему", "драйвер", "причин"), "comparison": ("compar", "differ", "сравн", "различ"),
    "concentration": ("concentr", "risk", "depend", "концентр", "риск", "зависим"), "correlation": ("correl", "relat", "influence", "связ", "влия", "корреля"),
}


def jaccard(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def candidate_grains(grain: str) -> list[str]:
    return ["day"] if grain == "irregular" else [grain, *([COARSER[grain]] if grain in COARSER else [])]


def measure_priority(m: Measure) -> float:
    return min(1.0, 0.5 + 0.2 * (m.polarity != "neutral") + 0.1 * m.additive + 0.05 * (m.column == "*"))


def dimension_priority(n: int) -> float:
    return 0.0 if n < 2 else next((w for most, w in ((20, 1.0), (60, 0.7), (200, 0.4)) if n <= most), 0.15)


def hypotheses(ds: Dataset, focus: str = "") -> list[Hypothesis]:
    """All questions that the model allows, the most promising first. A column
    is not compared with itself, which boolean and discrete ones would be."""
    model, out = ds.model, []
    terms = [t for t in re.split(r"[\s,;]+", focus.lower()) if len(t) > 2]
    groupable = [d for d in model.dimensions if d.groupable and d.cardinality >= 2]

    def add(kind: str, question: str, base: float, names: list[str], **params: str) -> None:
        words = [n.lower() for n in names]
        hits = sum(any(t in w for w in words) or any(t.startswith(s) or s.startswith(t) for s in FOCUS[kind]) for t in terms)
        boost = min(0.5, 0.2 + 0.15 * hits) if hits else 0.0
        out.append(Hypothesis(f"{kind}-{len(out) + 1}", kind, question, min(1.0, base * KIND_WEIGHT[kind] + boost), params))

    for t in model.times[:2]:
        for m in model.measures:
            for g in candidate_grains(t.grain):
                add("trend", f"Does '{m.name}' change steadily along '{t.name}' by {g}?", measure_priority(m), [m.name, t.name], measure=m.name, time=t.name, grain=g)
                add("anomaly", f"Are there odd periods of '{m.name}' by {g} of '{t.name}'?", measure_priority(m), [m.name], measure=m.name, time=t.name, grain=g)
    for t in model.times[:1]:
        for m in model.measures:
            for d in (d for d in groupable if d.column != m.column):
                add("driver", f"Which values of '{d.name}' move '{m.name}'?", measure_priority(m) * dimension_priority(d.cardinality), [m.name, d.name], measure=m.name, dimension=d.name, time=t.name)
    for m in model.measures:
        if m.column != "*":
            for d in (d for d in groupable if d.column != m.column):
                add("comparison", f"Does '{m.name}' differ between values of '{d.name}'?", measure_priority(m) * dimension_priority(d.cardinality), [m.name, d.name], measure=m.name, dimension=d.name)
    for m in model.measures:
        if m.additive or m.column == "*":
            for d in model.dimensions:
                if d.cardinality >= 5:
                    add("concentration", f"Does '{m.name}' rest on few values of '{d.name}'?", measure_priority(m), [m.name, d.name], measure=m.name, dimension=d.name)
    for a, b in combinations([m for m in model.measures if m.column != "*"], 2):
        add("correlation", f"Do '{a.name}' and '{b.name}' vary together?", (measure_priority(a) + measure_priority(b)) / 2, [a.name, b.name], a=a.name, b=b.name)
    return sorted(out, key=lambda h: -h.priority)


@dataclass
class Collected:
    """Sufficient statistics of a run, however many hypotheses use them."""

    series: dict[tuple[str, str], dict[str, series.Series]] = field(default_factory=dict)
    segments: dict[str, list[segments.Segment]] = field(default_factory=dict)
    pairs: dict[tuple[str, str], tuple[int, float | None, float | None, list]] = field(default_factory=dict)
    shares: dict[tuple[str, str], dict] = field(default_factory=dict)
    jobs: int = 0


def collect(ds: Dataset, chosen: list[Hypothesis]) -> Collected:
    """One pass for each axis and grain, one for all segments, one for all
    Pearson pairs, and rank passes for pairs that can matter."""
    model, out = ds.model, Collected()
    measures = {m.name: m for m in model.measures}
    by_axis: dict[tuple[str, str], list[str]] = {}
    for h in chosen:
        if h.kind in ("trend", "anomaly"):
            by_axis.setdefault((h.params["time"], h.params["grain"]), []).append(h.params["measure"])
    for (time, grain), names in by_axis.items():
        axis = next(t for t in model.times if t.name == time)
        out.series[time, grain] = series.collect(ds, [measures[n] for n in dict.fromkeys(names)], axis, grain)
        out.jobs += 1
    wanted = [d for d in model.dimensions if any(h.params.get("dimension") == d.name for h in chosen)]
    if wanted:
        used = [m for m in model.measures if any(h.params.get("measure") == m.name and "dimension" in h.params for h in chosen)]
        axis = model.times[0].column if model.times and any(h.kind == "driver" for h in chosen) else None
        split = segments.split_moment(ds, axis)[0] if axis else None
        counted = axis is not None and any(h.kind == "driver" and measures[h.params["measure"]].column == "*" for h in chosen)
        out.segments = segments.collect_segments(ds, wanted, used, axis, split, middle=segments.middle_moment(ds, axis) if counted else None)
        out.jobs += 2 + counted
        for h in chosen:  # dimensions with more values than are listed: exact figures over all
            if h.kind == "concentration":
                m, d = measures[h.params["measure"]], next(d for d in wanted if d.name == h.params["dimension"])
                if d.cardinality > len(out.segments[d.name]):
                    out.shares[m.name, d.name] = segments.concentration_frame(segments.sums_by_segment(ds, d, m)).first().asDict()
                    out.jobs += 1
    pairs = [(h.params["a"], h.params["b"]) for h in chosen if h.kind == "correlation"]
    if pairs:
        names = list(dict.fromkeys(n for p in pairs for n in p))
        frame = ds.df.select(*[ds.number(measures[n].column).alias(f"c{i}") for i, n in enumerate(names)])
        row = segments.pearson_frame(frame, [f"c{i}" for i in range(len(names))]).first()
        out.jobs += 1
        for a, b in pairs:
            i, j = sorted((names.index(a), names.index(b)))
            n, r = row[f"n_{i}_{j}"], row[f"r_{i}_{j}"]
            rho = None
            if n >= analyzers.PAIRS and r is not None and abs(r) < analyzers.TRIVIAL_R:
                rho = segments.spearman_frame(frame, f"c{names.index(a)}", f"c{names.index(b)}").first()["rho"]
                out.jobs += 1
            out.pairs[a, b] = (n, r, rho, [])
    return out


def scatter(ds: Dataset, a: str, b: str, most: int = 400) -> list[tuple[float, float]]:
    """A bounded sample of the pairs of two measures, at equal strides along the first."""
    columns = {m.name: m.column for m in ds.model.measures}
    pairs = ds.df.select(ds.number(columns[a]).alias("a"), ds.number(columns[b]).alias("b")).dropna()
    return [tuple(r) for r in segments.stride_sample(pairs, "a", most).orderBy("a", "b").collect()]


def test(ds: Dataset, h: Hypothesis, c: Collected, ctx: analyzers.Context) -> Insight | None:
    measures = {m.name: m for m in ds.model.measures}
    dimension = next((d for d in ds.model.dimensions if d.name == h.params.get("dimension")), None)
    axis = next((t for t in ds.model.times if t.name == h.params.get("time")), None)
    m = measures.get(h.params.get("measure", ""))
    match h.kind:
        case "trend":
            return analyzers.trend(ctx, m, axis, h.params["grain"], c.series[axis.name, h.params["grain"]][m.name], ds.model.dimensions)
        case "anomaly":
            return analyzers.anomaly(ctx, m, axis, h.params["grain"], c.series[axis.name, h.params["grain"]][m.name])
        case "driver":
            return analyzers.driver(ctx, m, dimension, axis, c.segments[dimension.name])
        case "comparison":
            return analyzers.comparison(ctx, m, dimension, c.segments[dimension.name])
        case "concentration":
            return analyzers.concentration(ctx, m, dimension, c.segments[dimension.name], c.shares.get((m.name, dimension.name)))
        case "correlation":
            n, r, rho, points = c.pairs[h.params["a"], h.params["b"]]
            return analyzers.correlation(ctx, measures[h.params["a"]], measures[h.params["b"]], n, r, rho, points)
    raise ValueError(f"unknown kind {h.kind}")


def apply_quality(found: Insight, report: QualityReport) -> Insight:
    found.confidence = analyzers.clamp(found.confidence * (0.6 + 0.4 * report.score))
    found.score = found.impact * found.confidence
    if report.score < 0.7:
        found.caveats.append(f"Data quality is {report.score:.0%}: check the inputs first.")
    return found


def verify(found: list[Insight], reject: Callable[[str], None] = lambda reason: None) -> list[Insight]:
    """False-discovery control over all p-values of the run, then the limits."""
    tested = [x for x in found if x.evidence.p_value is not None]
    if len(tested) > 1:
        for x, q in zip(tested, stats.benjamini_hochberg([x.evidence.p_value for x in tested]), strict=True):
            x.evidence.q_value = q
            if q > 0.1:
                x.confidence *= 0.5
                x.caveats.append(f"After correction for {len(tested)} tests q = {q:.3f}: this may be chance.")
            x.score = x.impact * x.confidence
    kept = []
    for x in found:
        if x.kind != "quality" and x.confidence < LEAST_CONFIDENCE:
            reject("low confidence after correction")
        elif x.kind != "quality" and x.score < LEAST_SCORE:
            reject("little impact")
        else:
            kept.append(x)
    return kept


def rank(found: list[Insight]) -> list[Insight]:
    """Best first; near-repeats of a kind go, and further findings on a known
    subject lose weight."""
    order = lambda x: (x.kind != "quality", -x.score)
    out: list[Insight] = []
    seen: list[tuple[str, set[str]]] = []
    for x in sorted(found, key=order):
        subjects = set(x.subjects)
        if any(kind == x.kind and jaccard(s, subjects) >= SAME for kind, s in seen):
            continue
        x.score *= FADE ** sum(jaccard(s, subjects) > FAMILIAR for _, s in seen)
        out.append(x)
        seen.append((x.kind, subjects))
    return sorted(out, key=order)


def headline(ds: Dataset, found: list[Insight], report: QualityReport) -> str:
    real = [x for x in found if x.kind != "quality"]
    if not real:
        return f"'{ds.name}' ({ds.count()} rows) shows no stable pattern; data quality is {report.score:.0%}. " + ("Repair the data first." if report.score < 0.8 else "More dimensions or a longer period may help.")
    kinds: dict[str, int] = {}
    for x in real:
        kinds[x.kind] = kinds.get(x.kind, 0) + 1
    return f"{real[0].title}. {len(real)} findings ({', '.join(f'{k}: {n}' for k, n in kinds.items())}); data quality {report.score:.0%}, confidence {real[0].confidence:.0%}. First step: {real[0].next_steps[0].action}."


def next_steps(found: list[Insight], report: QualityReport, most: int = 7) -> list[Step]:
    weights = {"fix_data": 1.15, "act": 1.0}
    steps: dict[str, tuple[float, Step]] = {}
    for x in found:
        for s in x.next_steps:
            steps.setdefault(s.action.lower()[:60], (x.score * weights.get(s.type, 0.85), s))
    if report.score < 0.8:
        worst = " ".join(i.message for i in report.issues if i.severity == "high") or "Several minor issues add up."
        steps["__quality"] = (10.0, Step("fix_data", f"Raise the data quality from {report.score:.0%}", worst))
    return [s for _, s in sorted(steps.values(), key=lambda x: -x[0])[:most]]


@dataclass
class Summary:
    headline: str
    insights: list[Insight]
    steps: list[Step]
    hypotheses: int
    confirmed: int
    rejected: int
    jobs: int
    quality: QualityReport


def prepare(ds: Dataset) -> None:
    """Profile and model, where not there yet."""
    if not ds.profiles:
        ds.profiles = profile.profile(ds)
    if not ds.model.measures:
        ds.model = build_model(ds.profiles, ds.count())


def run(ds: Dataset, focus: str = "", most_hypotheses: int = MAX_HYPOTHESES, most_insights: int = MAX_INSIGHTS, narrate: Callable[[Dataset, list[Insight]], str | None] | None = None) -> Iterator[Event]:
    """Events of one run; the last carries a ``Summary``."""
    yield Event("ingest", f"{len(ds.columns)} columns", 0.03)
    prepare(ds)
    yield Event("profile", str(profile.type_histogram(ds.profiles)), 0.10)
    yield Event("semantic", semantic.describe_model(ds.model), 0.14)
    report = assess(ds, ds.profiles)
    yield Event("quality_gate", f"score {report.score:.2f}, {len(report.issues)} issues", 0.20, report)
    chosen = hypotheses(ds, focus)[:most_hypotheses]
    yield Event("hypothesize", f"{len(chosen)} hypotheses", 0.25, chosen)
    quality = {p.name: (1 - min(0.6, p.null_rate)) * (1 - min(0.4, p.invalid_count / max(1, p.rows))) for p in ds.profiles}
    ctx = analyzers.Context(ds.count(), ds.model.reviewed, quality)
    stats_of = collect(ds, chosen)
    found: list[Insight] = []
    for i, h in enumerate(chosen):
        try:
            x = test(ds, h, stats_of, ctx)
        except (ArithmeticError, ValueError) as error:  # one bad statistic does not end the run
            log.warning("%s failed: %s", h.id, error)
            x = None
        if x is not None:
            found.append(apply_quality(x, report))
        if i % EVENT_EVERY == 0:
            yield Event("test", f"{i + 1} of {len(chosen)}: {h.question}", 0.25 + 0.5 * (i + 1) / max(1, len(chosen)))
    reasons: list[str] = []
    kept = verify(found, reasons.append)
    yield Event("verify", f"{len(kept)} of {len(found)} hold", 0.82, reasons)
    best = rank(kept)[:most_insights]
    for x in best:
        if x.kind == "correlation":
            x.chart.series = [("rows", scatter(ds, *x.subjects))]
    yield Event("rank", f"{len(best)} selected", 0.88, best)
    text = None
    if narrate is not None:
        try:
            text = narrate(ds, best)
        except Exception as error:  # a narrator is optional, facts do not depend on it
            log.warning("narration failed: %s", error)
    text = text or headline(ds, report.insights + best, report)
    yield Event("narrate", text, 0.95)
    every = report.insights + best
    yield Event("done", text, 1.0, Summary(text, every, next_steps(every, report), len(chosen), len(best), len(chosen) - len(best), stats_of.jobs, report))


def run_all(ds: Dataset, focus: str = "", **options) -> Summary:
    return list(run(ds, focus, **options))[-1].payload


def insight_frame(spark, found: list[Insight]):
    """Insights as a DataFrame with nested evidence, steps and chart."""
    schema = """id string, kind string, title string, narrative string, impact double, confidence double, score double, subjects array<string>,
        evidence struct<statistic:double,label:string,p_value:double,q_value:double,effect_size:double,effect_label:string,sample_size:bigint,facts:array<struct<label:string,value:string>>>,
        trace array<string>, caveats array<string>, next_steps array<struct<type:string,action:string,rationale:string>>,
        chart struct<type:string,x_label:string,y_label:string,series:array<struct<name:string,points:array<struct<x:string,y:double>>>>>"""

    def real(v):
        return None if v is None else float(v)

    rows = []
    for x in found:
        e, c = x.evidence, x.chart
        chart = None if c is None else (c.type, c.x_label, c.y_label, [(n, [(str(a), float(b)) for a, b in ps]) for n, ps in c.series])
        rows.append((x.id, x.kind, x.title, x.narrative, float(x.impact), float(x.confidence), float(x.score), x.subjects, (real(e.statistic), e.statistic_label, real(e.p_value), real(e.q_value), real(e.effect_size), e.effect_label, int(e.sample_size), e.facts), x.trace, x.caveats, [(s.type, s.action, s.rationale) for s in x.next_steps], chart))
    return spark.createDataFrame(rows, schema)


