"""Findings from collected statistics. Each analyzer takes what a batched pass
gathered, applies its gates, and returns an insight or None."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from gleaner.functions import stats
from gleaner.functions.stats import Moments
from gleaner.model import Chart, Dimension, Evidence, Insight, Measure, Query, Metric, Step, TimeAxis
from gleaner.operators.segments import Segment
from gleaner.operators.series import Series

#: Limits of the findings.
TREND_POINTS, ANOMALY_POINTS = 6, 10
Z_LIMIT, MOST_OUTLIERS = 3.5, 0.25
WINDOW_ROWS, SEGMENT_ROWS = 20, 5
DRIVER_SHARE, DRIVER_EXCESS, OPPOSING = 0.25, 0.12, 0.15
COMPARE_ROWS, COMPARE_GROUPS, LEAST_D = 8, 40, 0.3
CONCENTRATED, UNEVEN, SEGMENTS = 0.5, 0.4, 5
PAIRS, LEAST_R, TRIVIAL_R, DIVERGENCE = 20, 0.35, 0.995, 0.25


@dataclass
class Context:
    """What analyzers share: the weight of each column's data quality."""

    rows: int
    reviewed: bool = False
    quality: dict[str, float] = field(default_factory=dict)

    def quality_of(self, *columns: str) -> float:
        return min([1.0, *(self.quality.get(c, 1.0) for c in columns)])

    def confidence(self, p: float | None, n: float, least: int, columns: tuple[str, ...], penalty: float = 1.0) -> float:
        steps = ((0.001, 1.0), (0.01, 0.9), (0.05, 0.75), (0.1, 0.5))
        base = 0.5 if p is None else next((s for limit, s in steps if p <= limit), 0.25)
        ratio = n / max(1, least)
        sample = 0.3 if ratio < 1 else min(1.0, 0.4 + 0.6 * math.log10(1 + 9 * min(1.0, (ratio - 1) / 3)))
        return clamp(base * sample * self.quality_of(*columns) * (1.0 if self.reviewed else 0.9) * penalty)


def clamp(v: float) -> float:
    return min(1.0, max(0.0, v)) if math.isfinite(v) else 0.0


def impact_of(share: float = 0.0, effect: float = 0.0, coverage: float = 0.0) -> float:
    size = min(1.0, math.log10(1 + 9 * min(1.0, abs(effect))))
    return clamp(0.45 * clamp(share) + 0.35 * size + 0.20 * clamp(coverage))


def relative(new: float, old: float, without: float = 1.0) -> float:
    return (new - old) / abs(old) if old else without


def number(v: float | None, unit: str | None = None) -> str:
    if v is None or not math.isfinite(v):
        return "n/a"
    if unit == "%":
        return f"{v * 100 if abs(v) <= 1 else v:.1f}%"
    text = f"{v / 1e6:.2f}M" if abs(v) >= 1e6 else f"{v:,.0f}" if abs(v) >= 1000 else f"{v:.4g}"
    return f"{text} {unit}" if unit else text


def signed(v: float) -> str:
    return f"{v:+.1%}"


def p_text(p: float) -> str:
    return "p < 0.001" if p < 0.001 else f"p = {p:.3f}"


def verdict(m: Measure, up: bool) -> str:
    if m.polarity == "neutral":
        return ""
    return " This is the wanted direction." if up == (m.polarity == "higher_is_better") else " This is the unwanted direction."


def _insight(kind: str, title: str, narrative: str, impact: float, confidence: float, subjects: list[str], evidence: Evidence, trace: list[str], caveats: list[str], steps: list[Step], chart: Chart | None = None) -> Insight:
    key = f"{kind}-" + "-".join(s.lower().replace(" ", "_")[:24] for s in subjects)
    return Insight(key, kind, title, narrative, impact, confidence, impact * confidence, subjects, evidence, trace, [c for c in caveats if c], steps, chart)


def _line(m: Measure, time: TimeAxis, s: Series) -> Chart:
    return Chart("line", time.name, m.name, [(m.name, list(zip(s.labels, s.values, strict=True)))])


def _trimmed(s: Series) -> list[str]:
    return ["An incomplete period at the edge was left out."] if s.trimmed_first or s.trimmed_last else []


def trend(ctx: Context, m: Measure, time: TimeAxis, grain: str, s: Series, dimensions: list[Dimension]) -> Insight | None:
    n = len(s.values)
    if n < TREND_POINTS:
        return None
    fit = stats.fit_line(range(n), s.values)
    k = max(1, n // 3)
    first, last = stats.mean(s.values[:k]), stats.mean(s.values[-k:])
    change = relative(last, first, 0.0 if last == 0 else 1.0)
    trace = [f"{m.aggregation}({m.name}) by {grain} of {time.name}: {n} points.", *_trimmed(s), f"Mean of the first third {number(first, m.unit)}, of the last {number(last, m.unit)} ({signed(change)}).", f"Line: slope {fit.slope:.4g}, R² {fit.r2:.3f}, {p_text(fit.p)}."]
    shift = stats.find_changepoint(s.values)
    if shift:
        line_rest = sum((y - fit.intercept - fit.slope * i) ** 2 for i, y in enumerate(s.values))
        step_rest = sum((y - (shift.before if i < shift.index else shift.after)) ** 2 for i, y in enumerate(s.values))
        trace.append(f"Step at {s.labels[shift.index]}: residual {step_rest:.4g} against {line_rest:.4g} of the line.")
        if shift.p < 0.01 and step_rest < 0.9 * line_rest:
            return _level_shift(ctx, m, time, s, shift, trace)
    if fit.p > 0.05 or abs(change) < 0.03:
        return None
    up = fit.slope > 0
    subject = next((d for d in dimensions if d.groupable), None)
    steps = [
        Step("investigate", f"Split '{m.name}' by segment to find where it changes", "Totals hide segments that move in different directions.", Query([Metric(m.name)], [time.name, subject.name], grain) if subject else None),
        Step("monitor", f"Watch '{m.name}' against {number(s.values[-1] + 2 * fit.slope, m.unit)}", "Beyond this value the trend has gained speed."),
    ]
    if n < 24:
        steps.append(Step("fix_data", "Load at least 24 periods of history", "Shorter series cannot tell trend from season."))
    return _insight(
        "trend", f"'{m.name}' {'rises' if up else 'falls'} by {signed(change)} over the period",
        f"Over {n} periods '{m.name}' went from {number(first, m.unit)} to {number(last, m.unit)} between the first and the last third. The slope is {number(fit.slope, m.unit)} for each period and significant ({p_text(fit.p)}); the line explains {fit.r2:.0%} of the variance.{verdict(m, up)}",
        impact_of(0.5, change, 1.0), ctx.confidence(fit.p, n, TREND_POINTS, (m.column, time.column), 0.75 if fit.r2 < 0.3 else 1.0), [m.name, time.name],
        Evidence(fit.slope, "Slope for each period", fit.p, None, fit.r2, "R²", n, [("Periods", str(n)), ("First third", number(first, m.unit)), ("Last third", number(last, m.unit)), ("Change", signed(change)), ("Projection, 3 periods", number(s.values[-1] + 3 * fit.slope, m.unit))]),
        trace, ["Much noise around the line." if fit.r2 < 0.5 else "", "A straight line leaves seasons out.", f"A level shift near {s.labels[shift.index]} is possible too." if shift else ""], steps, _line(m, time, s),
    )


def _level_shift(ctx: Context, m: Measure, time: TimeAxis, s: Series, shift: stats.Changepoint, trace: list[str]) -> Insight:
    change = relative(shift.after, shift.before)
    where, up = s.labels[shift.index], shift.after > shift.before
    return _insight(
        "trend", f"'{m.name}' {'jumps' if up else 'drops'} by {signed(change)} near {where}",
        f"'{m.name}' has two levels: {number(shift.before, m.unit)} before {where} and {number(shift.after, m.unit)} from then on ({signed(change)}, {p_text(shift.p)} after correction for the search). One event is more likely than a slow trend.{verdict(m, up)}",
        impact_of(0.6, change, 1.0), ctx.confidence(shift.p, len(s.values), TREND_POINTS, (m.column, time.column)), [m.name, time.name],
        Evidence(shift.after - shift.before, "Shift of the level", shift.p, None, change, "Relative change", len(s.values), [("Near", where), ("Before", number(shift.before, m.unit)), ("After", number(shift.after, m.unit))]),
        trace, ["One shift is found; there may be more.", "Coincidence in time is no cause."],
        [Step("investigate", f"Find out what happened near {where}", "A level shift mostly has one cause."), Step("investigate", "See whether all segments shifted", "A local shift points to its origin.")], _line(m, time, s),
    )


def anomaly(ctx: Context, m: Measure, time: TimeAxis, grain: str, s: Series) -> Insight | None:
    n = len(s.values)
    if n < ANOMALY_POINTS:
        return None
    fit = stats.fit_line(range(n), s.values)
    detrend = fit.p < 0.05 and fit.r2 > 0.25
    rest = [y - fit.intercept - fit.slope * i for i, y in enumerate(s.values)] if detrend else s.values
    z = stats.robust_z(rest)
    out = sorted((i for i in range(n) if abs(z.scores[i]) >= Z_LIMIT), key=lambda i: -abs(z.scores[i]))
    if not out or len(out) > MOST_OUTLIERS * n:
        return None
    i = out[0]
    expected = fit.intercept + fit.slope * i if detrend else z.centre
    gap = s.values[i] - expected
    change, p = relative(s.values[i], expected), stats.normal_two_sided(z.scores[i])
    total = abs(sum(s.values))
    return _insight(
        "anomaly", f"'{m.name}' in {s.labels[i]} is {signed(change)} off the expected value",
        f"In {s.labels[i]} '{m.name}' was {number(s.values[i], m.unit)} where {number(expected, m.unit)} was expected (robust z {z.scores[i]:.1f}, {p_text(p)}). {len(out)} of {n} periods are beyond the limit.",
        impact_of(min(1.0, abs(gap) / max(1e-9, total)), change, s.counts[i] / max(1, sum(s.counts))),
        ctx.confidence(p, n, ANOMALY_POINTS, (m.column, time.column), 1.0 if z.robust else 0.8), [m.name, time.name],
        Evidence(z.scores[i], "Robust z", p, None, change, "Relative deviation", n, [("Period", s.labels[i]), ("Value", number(s.values[i], m.unit)), ("Expected", number(expected, m.unit)), ("Rows in the period", str(s.counts[i])), ("Outliers", f"{len(out)} of {n}")]),
        [f"{m.aggregation}({m.name}) by {grain}: {n} points.", *_trimmed(s), "The line was taken out first." if detrend else "Deviations are from the median."],
        ["The spread is not robust: most values are equal." if not z.robust else "", "One period may differ for a reason outside the data."],
        [Step("investigate", f"Look at the rows of {s.labels[i]}", "A single day may be an event or an error of loading."), Step("monitor", f"Alert when '{m.name}' leaves {Z_LIMIT} deviations", "The next one is then seen at once.")], _line(m, time, s),
    )


def _share_p(c0: float, n0: float, c1: float, n1: float) -> float:
    """Whether a segment's share of all rows is another one than before: chi-square of 2 x 2."""
    n, own = n0 + n1, c0 + c1
    if own in (0, n):
        return 1.0
    x = sum((got - want) ** 2 / want for got, want in ((c0, n0 * own / n), (c1, n1 * own / n), (n0 - c0, n0 * (n - own) / n), (n1 - c1, n1 * (n - own) / n)))
    return stats.chi_square_p(x, 1.0)


def driver(ctx: Context, m: Measure, d: Dimension, time: TimeAxis, segments: list[Segment]) -> Insight | None:
    rows_only = m.column == "*"  # the split at the middle row leaves as many rows before as after: halves of the calendar count

    def part(s: Segment, which: str) -> tuple[float, float]:
        """(rows with a value, their mean)."""
        if rows_only:
            return float(s.rows_first if which == "prior" else s.rows_second), 1.0
        x = getattr(s, which)[m.name]
        return float(x.n), x.mean

    old, new = (sum(s.rows_first for s in segments), sum(s.rows_second for s in segments)) if rows_only else (sum(s.rows_prior for s in segments), sum(s.rows_recent for s in segments))
    if old < WINDOW_ROWS or new < WINDOW_ROWS:
        return None
    n0, n1 = sum(part(s, "prior")[0] for s in segments), sum(part(s, "recent")[0] for s in segments)
    if not n0 or not n1:
        return None
    rows = []
    for s in segments:
        (c0, m0), (c1, m1) = part(s, "prior"), part(s, "recent")
        if m.additive:
            mix, rate = (c1 - c0) * m0, c1 * (m1 - m0)
        else:
            mix, rate = (c1 / n1 - c0 / n0) * m0, c1 / n1 * (m1 - m0)
        delta = c1 * m1 - c0 * m0 if m.additive else mix + rate
        rows.append((s, c0, c1, m0, m1, mix, rate, delta))
    before = sum(c0 * m0 for _, c0, _, m0, *_ in rows) / (1 if m.additive else n0)
    after = sum(c1 * m1 for _, _, c1, _, m1, *_ in rows) / (1 if m.additive else n1)
    total = after - before
    usable = sorted((r for r in rows if r[1] + r[2] >= SEGMENT_ROWS), key=lambda r: (-abs(r[7]), r[0].value))
    if abs(total) < 1e-9 or len(usable) < 2:
        return None
    s, c0, c1, m0, m1, mix, rate, delta = usable[0]
    share, volume = delta / total, c1 / n1
    excess = abs(share) - volume
    if abs(share) < DRIVER_SHARE or excess < DRIVER_EXCESS:
        return None
    p = min(1.0, _share_p(c0, n0, c1, n1) * len(usable)) if rows_only else stats.welch(s.recent[m.name], s.prior[m.name]).p
    if rows_only and p > 0.05:  # the largest of several shifts in counts that chance alone makes
        return None
    against = [r[0].value for r in usable[1:] if r[7] * total < 0 and abs(r[7]) > OPPOSING * abs(total)]
    change = relative(c1 * m1, c0 * m0) if m.additive else relative(m1, m0)
    weight = abs(c1 * m1) / max(1e-9, abs(after)) if m.additive else volume
    how = "volume" if abs(mix) > abs(rate) else "level"
    return _insight(
        "driver", f"{d.name} = '{s.value}' drives the change of '{m.name}' ({share:.0%} of it)",
        f"'{m.name}' went from {number(before, m.unit)} to {number(after, m.unit)} between the two halves of {time.name}. '{s.value}' contributes {number(delta, m.unit)}, {share:.0%} of the change, with {volume:.0%} of recent rows; its {how} explains most of it." + (f" Against it move: {', '.join(against[:3])}." if against else ""),
        impact_of(clamp(weight), change, volume), ctx.confidence(p, c0 + c1, SEGMENT_ROWS, (m.column, d.column, time.column), 1.0 if abs(share) > 0.5 else 0.85), [m.name, d.name, s.value],
        Evidence(delta, "Contribution", p, None, share, "Share of the change", int(c0 + c1), [("Before", number(before, m.unit)), ("After", number(after, m.unit)), ("Volume effect", number(mix, m.unit)), ("Level effect", number(rate, m.unit)), ("Rows before, after", f"{c0:.0f}, {c1:.0f}")]),
        [f"Rows were split at the middle of {time.name}{' by the calendar' if rows_only else ''}.", f"{len(usable)} segments of '{d.name}' with {SEGMENT_ROWS} rows or more."],
        ["Contribution is arithmetic, not cause.", "The segment's level itself does not differ significantly." if p > 0.05 else ""],
        [Step("act", f"Look into '{s.value}' first", "It moves the total more than its size explains.", Query([Metric(m.name)], [time.name], None)), Step("monitor", f"Track '{m.name}' for '{s.value}' by itself", "Totals show it late.")],
        Chart("hbar", d.name, "change", [("change", [(r[0].value, r[7]) for r in usable[:10]])]),
    )


def comparison(ctx: Context, m: Measure, d: Dimension, segments: list[Segment]) -> Insight | None:
    if m.column == "*":
        return None
    groups = sorted(segments, key=lambda s: (-abs(s.total[m.name].n * s.total[m.name].mean), s.value))[:COMPARE_GROUPS]
    usable = [s for s in groups if s.total[m.name].n >= COMPARE_ROWS]
    if len(usable) < 2:
        return None
    # The rest is merged from the other segments: subtracting from the total would cancel.
    heads, tails = [Moments(0, 0.0, 0.0)], [Moments(0, 0.0, 0.0)]
    for s in usable:
        heads.append(heads[-1] + s.total[m.name])
    for s in reversed(usable):
        tails.append(tails[-1] + s.total[m.name])
    rests = [heads[i] + tails[len(usable) - 1 - i] for i in range(len(usable))]
    tests = [stats.welch(s.total[m.name], r) for s, r in zip(usable, rests, strict=True)]
    qs = stats.benjamini_hochberg([t.p for t in tests])
    found = sorted((i for i in range(len(usable)) if qs[i] <= 0.05 and abs(tests[i].d) >= LEAST_D), key=lambda i: (-abs(tests[i].d), usable[i].value))
    if not found:
        return None
    i = found[0]
    s, own, rest, test = usable[i], usable[i].total[m.name], rests[i], tests[i]
    change, share = relative(own.mean, rest.mean), own.n / max(1, sum(x.total[m.name].n for x in segments))
    size = "large" if abs(test.d) >= 0.8 else "medium" if abs(test.d) >= 0.5 else "small"
    return _insight(
        "comparison", f"{d.name} = '{s.value}' has {'higher' if own.mean > rest.mean else 'lower'} '{m.name}' than the rest ({signed(change)})",
        f"The mean of '{m.name}' for '{s.value}' is {number(own.mean, m.unit)}, that of the other segments {number(rest.mean, m.unit)}. The difference holds after correction (q = {qs[i]:.4f}) and its size is {size} (d = {test.d:.2f}); the segment has {share:.0%} of the rows.",
        impact_of(share, change, share), ctx.confidence(qs[i], min(own.n, rest.n), COMPARE_ROWS, (m.column, d.column)), [m.name, d.name, s.value],
        Evidence(test.t, "Welch t", test.p, qs[i], test.d, "Cohen's d", int(own.n + rest.n), [("Segment", number(own.mean, m.unit)), ("Rest", number(rest.mean, m.unit)), ("Rows", f"{own.n:.0f} and {rest.n:.0f}"), ("q", f"{qs[i]:.4f}")]),
        [f"{len(tests)} segments were each compared with the rest (Welch), p-values adjusted."], ["Segments may differ in other ways too.", f"Next: '{usable[found[1]].value}' (d = {tests[found[1]].d:.2f})." if len(found) > 1 else ""],
        [Step("investigate", f"Find what sets '{s.value}' apart", "The difference is stable, its reason is not in the test."), Step("act", f"Treat '{s.value}' separately in reports of '{m.name}'", "The overall mean describes neither group.")],
        Chart("bar", d.name, m.name, [(m.name, [(x.value, x.total[m.name].mean) for x in usable[:15]])]),
    )


def concentration(ctx: Context, m: Measure, d: Dimension, segments: list[Segment], exact: dict | None = None) -> Insight | None:
    """``exact`` has the figures over all values of a dimension with more of them than
    ``segments`` lists (``concentration_frame``); the largest are listed in any case."""
    sums = [(s.value, float(s.rows) if m.column == "*" else s.total[m.name].n * s.total[m.name].mean) for s in segments]
    sums = sorted((x for x in sums if x[1] > 0), key=lambda x: (-x[1], x[0]))
    if len(sums) < SEGMENTS:
        return None
    total, n = (exact["total"], exact["segments"]) if exact else (sum(v for _, v in sums), len(sums))
    shares = [v / total for _, v in sums]
    k = max(1, math.ceil(n * 0.1))
    top, hhi, g = (exact["top_share"], exact["hhi"], exact["gini"]) if exact else (sum(shares[:k]), stats.herfindahl(shares), stats.gini([v for _, v in sums]))
    if top < CONCENTRATED or g < UNEVEN:
        return None
    run, to_80 = 0.0, exact["to_80"] if exact else 0
    for x in () if exact else shares:
        run, to_80 = run + x, to_80 + 1
        if run >= 0.8:
            break
    band = "high" if hhi >= 0.25 else "moderate" if hhi >= 0.15 else "low"
    rows = ctx.rows if exact else sum(s.rows for s in segments)
    return _insight(
        "concentration", f"{top:.0%} of '{m.name}' comes from {k} of {n} values of '{d.name}'",
        f"'{m.name}' is unevenly spread over '{d.name}': {to_80} of {n} segments give 80%, and the largest, '{sums[0][0]}', has {shares[0]:.0%}. The Gini coefficient is {g:.2f}, the Herfindahl index {hhi:.3f} ({band} concentration).",
        impact_of(top, g, 1.0), ctx.confidence(0.001, rows, 30, (m.column, d.column), 1.0), [m.name, d.name],
        Evidence(top, "Share of the top tenth", None, None, g, "Gini", rows, [("Segments", str(n)), ("To reach 80%", str(to_80)), ("HHI", f"{hhi:.4f}"), *((v, f"{x:.1%}") for (v, _), x in zip(sums[:5], shares, strict=False))]),
        [f"{m.name} was summed for {n} values of {d.name}: {number(total, m.unit)}."], ["Concentration may be natural for this dimension."],
        [Step("act", f"Secure '{sums[0][0]}'", "Much depends on it."), Step("monitor", f"Track the share of the top {k}", "A rise means more dependence.")], Chart("hbar", d.name, m.name, [(m.name, sums[:10])]),
    )


def correlation(ctx: Context, a: Measure, b: Measure, n: int, r: float | None, rho: float | None, points: list[tuple[float, float]] | None = None) -> Insight | None:
    if n < PAIRS:
        return None
    (pr, pp), (sr, sp) = stats.correlation_p(r, n), stats.correlation_p(rho, n)
    if abs(pr) >= TRIVIAL_R or max(abs(pr), abs(sr)) < LEAST_R or min(pp, sp) > 0.01:
        return None
    weaker, p, name = (pr, pp, "Pearson") if abs(pr) <= abs(sr) else (sr, sp, "Spearman")
    outliers = abs(pr - sr) > DIVERGENCE
    strength = "strong" if abs(weaker) >= 0.7 else "moderate" if abs(weaker) >= 0.5 else "weak"
    coverage = n / max(1, ctx.rows)
    return _insight(
        "correlation", f"{strength.capitalize()} {'positive' if weaker > 0 else 'negative'} link of '{a.name}' and '{b.name}' (r = {weaker:.2f})",
        f"'{a.name}' and '{b.name}' vary together ({name} {weaker:.3f}, {p_text(p)}, {n} rows); they share {weaker * weaker:.0%} of their variance. Pearson is {pr:.2f} and Spearman {sr:.2f}" + (", so a few extreme rows make much of the link." if outliers else ", so it does not rest on a few rows."),
        impact_of(weaker * weaker * 0.5, weaker, coverage), ctx.confidence(p, n, PAIRS, (a.column, b.column), 0.65 if outliers else 1.0), [a.name, b.name],
        Evidence(weaker, name, p, None, weaker * weaker, "r²", n, [("Pearson", f"{pr:.3f}"), ("Spearman", f"{sr:.3f}"), ("Rows", str(n))]),
        [f"{n} of {ctx.rows} rows have both values."], ["Correlation is not causality: the direction is open, and a third quantity may cause both.", f"Only {coverage:.0%} of rows have both values." if coverage < 0.8 else ""],
        [Step("investigate", f"Test whether '{a.name}' changes '{b.name}'", "Only an experiment or a natural break can tell."), Step("investigate", "Look at the link inside segments", "A link between segments may vanish inside them.")],
        Chart("scatter", a.name, b.name, [("rows", points or [])]),
    )
