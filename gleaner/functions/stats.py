"""Statistics on the driver, over sufficient statistics and short series."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

#: The rational approximation of erf with an error below 1.5e-7.
ERF = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
MAD_SCALE = 1.4826


def mean(xs: Sequence[float]) -> float:
    return sum(xs) / len(xs) if xs else math.nan


def variance(xs: Sequence[float]) -> float:
    if len(xs) < 2:
        return 0.0
    m = mean(xs)
    return sum((x - m) ** 2 for x in xs) / (len(xs) - 1)


def stdev(xs: Sequence[float]) -> float:
    return math.sqrt(variance(xs))


def percentile(xs: Sequence[float], q: float) -> float:
    """Linear interpolation at (n - 1) * q."""
    if not xs:
        return math.nan
    s = sorted(xs)
    at = (len(s) - 1) * q
    k = math.floor(at)
    return s[k] + (s[min(k + 1, len(s) - 1)] - s[k]) * (at - k)


def median(xs: Sequence[float]) -> float:
    return percentile(xs, 0.5)


def mad(xs: Sequence[float]) -> float:
    m = median(xs)
    return MAD_SCALE * median([abs(x - m) for x in xs]) if xs else math.nan


# Distributions


def erf(x: float) -> float:
    p, *a = ERF
    t = 1 / (1 + p * abs(x))
    poly = 0.0
    for c in reversed(a):
        poly = (poly + c) * t
    return math.copysign(1 - poly * math.exp(-x * x), x)


def normal_cdf(z: float) -> float:
    return 0.5 * (1 + erf(z / math.sqrt(2)))


def clamp_p(p: float) -> float:
    return min(1.0, max(0.0, p)) if math.isfinite(p) else 1.0


def normal_two_sided(z: float) -> float:
    return clamp_p(2 * (1 - normal_cdf(abs(z))))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return front * out


def t_two_sided(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0
    if not df > 0 or math.isnan(t):
        return 1.0
    return clamp_p(incomplete_beta(df / 2, 0.5, df / (df + t * t)))


def lower_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0 or a <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return 1 - front * h


def chi_square_p(x: float, df: float) -> float:
    return 1.0 if x <= 0 or df <= 0 else clamp_p(1 - lower_gamma(df / 2, x / 2))


# Tests


@dataclass(frozen=True)
class Moments:
    """Count, mean and sum of squared deviations; they merge exactly."""

    n: float
    mean: float
    m2: float

    @classmethod
    def of(cls, n: float | None, avg: float | None, var: float | None) -> Moments:
        n = n or 0
        return cls(n, avg or 0.0, (var or 0.0) * max(0, n - 1))

    @classmethod
    def from_values(cls, xs: Sequence[float]) -> Moments:
        return cls.of(len(xs), mean(xs) if xs else 0.0, variance(xs))

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        d = other.mean - self.mean
        return Moments(n, self.mean + d * other.n / n, self.m2 + other.m2 + d * d * self.n * other.n / n)

    @property
    def var(self) -> float:
        return self.m2 / (self.n - 1) if self.n > 1 else 0.0


@dataclass(frozen=True)
class TTest:
    t: float
    df: float
    p: float
    d: float  # Cohen's, with the pooled deviation


def welch(a: Moments, b: Moments) -> TTest:
    if a.n < 2 or b.n < 2:
        return TTest(0.0, 0.0, 1.0, 0.0)
    va, vb = a.var / a.n, b.var / b.n
    gap = a.mean - b.mean
    if va + vb < 1e-300:
        if gap == 0:
            return TTest(0.0, a.n + b.n - 2, 1.0, 0.0)
        return TTest(math.copysign(math.inf, gap), a.n + b.n - 2, 0.0, math.copysign(10.0, gap))
    t = gap / math.sqrt(va + vb)
    df = (va + vb) ** 2 / (va * va / (a.n - 1) + vb * vb / (b.n - 1))
    pooled = math.sqrt((a.m2 + b.m2) / (a.n + b.n - 2))
    return TTest(t, df, t_two_sided(t, df), gap / pooled if pooled else 0.0)


@dataclass(frozen=True)
class Line:
    slope: float
    intercept: float
    r2: float
    t: float
    p: float


def fit_line(xs: Sequence[float], ys: Sequence[float]) -> Line:
    n = len(xs)
    if n < 3:
        return Line(0.0, mean(ys) if ys else 0.0, 0.0, 0.0, 1.0)
    mx, my = mean(xs), mean(ys)
    sxx = sum((x - mx) ** 2 for x in xs)
    sxy = sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True))
    syy = sum((y - my) ** 2 for y in ys)
    if sxx == 0:
        return Line(0.0, my, 0.0, 0.0, 1.0)
    slope = sxy / sxx
    rest = max(0.0, syy - slope * sxy)
    r2 = 0.0 if syy == 0 else 1 - rest / syy
    if rest <= 1e-12 * max(syy, 1e-300):
        t = 0.0 if slope == 0 else math.copysign(math.inf, slope)
    else:
        t = slope / math.sqrt(rest / (n - 2) / sxx)
    return Line(slope, my - slope * mx, r2, t, 1.0 if t == 0 else t_two_sided(t, n - 2))


def correlation_p(r: float | None, n: int) -> tuple[float, float]:
    """(r, p) of a correlation over n pairs; undefined ones are (0, 1)."""
    if n < 3 or r is None or math.isnan(r):
        return 0.0, 1.0
    r = max(-1.0, min(1.0, r))
    if 1 - r * r <= 1e-12:
        return r, 0.0
    return r, t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def pearson(xs: Sequence[float], ys: Sequence[float]) -> tuple[float, float]:
    n = len(xs)
    if n < 3:
        return 0.0, 1.0
    mx, my = mean(xs), mean(ys)
    sxx, syy = sum((x - mx) ** 2 for x in xs), sum((y - my) ** 2 for y in ys)
    if sxx == 0 or syy == 0:
        return 0.0, 1.0
    return correlation_p(sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True)) / math.sqrt(sxx * syy), n)


def average_ranks(xs: Sequence[float]) -> list[float]:
    order = sorted(range(len(xs)), key=xs.__getitem__)
    out = [0.0] * len(xs)
    i = 0
    while i < len(order):
        j = i
        while j + 1 < len(order) and xs[order[j + 1]] == xs[order[i]]:
            j += 1
        for k in range(i, j + 1):
            out[order[k]] = (i + j) / 2 + 1
        i = j + 1
    return out


def spearman(xs: Sequence[float], ys: Sequence[float]) -> tuple[float, float]:
    return pearson(average_ranks(xs), average_ranks(ys))


def benjamini_hochberg(ps: Sequence[float]) -> list[float]:
    """Step-up q-values in the given order."""
    n, low = len(ps), 1.0
    out = [1.0] * n
    for rank, i in sorted(enumerate(sorted(range(n), key=ps.__getitem__), 1), reverse=True):
        low = min(low, ps[i] * n / rank)
        out[i] = low
    return out


# Shares and series


def herfindahl(values: Sequence[float]) -> float:
    total = sum(values)
    return sum((v / total) ** 2 for v in values) if total else 0.0


def gini(values: Sequence[float]) -> float:
    xs = sorted(v for v in values if math.isfinite(v) and v >= 0)
    n, total = len(xs), sum(xs)
    if not n or not total:
        return 0.0
    return 2 * sum(i * x for i, x in enumerate(xs, 1)) / (n * total) - (n + 1) / n


@dataclass(frozen=True)
class RobustZ:
    scores: list[float]
    centre: float
    scale: float
    robust: bool


def robust_z(xs: Sequence[float]) -> RobustZ:
    """Deviations from the median in MADs, or in standard deviations if the MAD is 0."""
    centre, scale = median(xs), mad(xs)
    robust = scale >= 1e-12
    if not robust:
        scale = stdev(xs)
    if not scale >= 1e-12:
        return RobustZ([0.0] * len(xs), centre, 0.0, robust)
    return RobustZ([(x - centre) / scale for x in xs], centre, scale, robust)


@dataclass(frozen=True)
class Changepoint:
    index: int
    before: float
    after: float
    p: float  # after Bonferroni


def find_changepoint(xs: Sequence[float], alpha: float = 0.01) -> Changepoint | None:
    """The split with the largest Welch |t|, from prefix moments."""
    n = len(xs)
    least = max(4, int(0.15 * n))
    if n < 2 * least:
        return None
    heads, tails = [Moments(0, 0.0, 0.0)], [Moments(0, 0.0, 0.0)]
    for x in xs:
        heads.append(heads[-1] + Moments(1, x, 0.0))
    for x in reversed(xs):
        tails.append(tails[-1] + Moments(1, x, 0.0))
    best: tuple[float, int, TTest] | None = None
    for k in range(least, n - least + 1):
        test = welch(heads[k], tails[n - k])
        if best is None or abs(test.t) > best[0]:
            best = (abs(test.t), k, test)
    _, k, test = best
    p = min(1.0, test.p * (n - 2 * least + 1))
    return Changepoint(k, heads[k].mean, tails[n - k].mean, p) if p <= alpha else None
