import math

import pytest
from gleaner.functions import stats
from gleaner.functions.stats import Moments


def test_percentile_interpolates():
    assert stats.percentile([1, 2, 3, 4], 0.25) == 1.75 and stats.median([3, 1, 2]) == 2
    assert math.isnan(stats.percentile([], 0.5)) and math.isnan(stats.mean([]))


def test_spread():
    assert stats.stdev([5]) == 0 and stats.variance([1, 2, 3]) == 1
    assert stats.mad([1, 2, 3, 4, 5]) == pytest.approx(1.4826)


def test_line():
    fit = stats.fit_line(range(10), [3 * x + 7 for x in range(10)])
    assert (fit.slope, fit.intercept, fit.r2, fit.p) == (pytest.approx(3), pytest.approx(7), pytest.approx(1), 0) and math.isinf(fit.t)
    assert stats.fit_line([1, 2], [1, 2]).p == 1 and stats.fit_line([1, 1, 1], [1, 2, 3]).p == 1
    flat = stats.fit_line(range(5), [2] * 5)
    assert flat.r2 == 0 and flat.p == 1


def test_pearson():
    x = list(range(20))
    assert stats.pearson(x, [2 * v for v in x])[0] == pytest.approx(1)
    assert stats.pearson(x, [-v for v in x]) == (pytest.approx(-1), 0)
    assert stats.pearson(x, [4] * 20) == (0, 1) and stats.pearson([1], [1]) == (0, 1)


def test_spearman_and_ranks():
    x = list(range(1, 12))
    assert stats.spearman(x, [2**v for v in x])[0] == pytest.approx(1)
    assert stats.average_ranks([10, 20, 20, 30]) == [1, 2.5, 2.5, 4]


def test_student_t_table():
    for t, df in ((2.228, 10), (12.706, 1), (1.984, 100)):
        assert stats.t_two_sided(t, df) == pytest.approx(0.05, abs=2e-4)
    assert stats.t_two_sided(math.inf, 5) == 0 and stats.t_two_sided(2, 0) == 1


def test_chi_square_table():
    for x, df in ((3.841, 1), (5.991, 2), (18.307, 10)):
        assert stats.chi_square_p(x, df) == pytest.approx(0.05, abs=2e-4)
    assert stats.chi_square_p(0, 3) == 1


def test_normal():
    assert stats.normal_two_sided(1.96) == pytest.approx(0.05, abs=1e-4)
    assert all(abs(stats.erf(x / 10) - math.erf(x / 10)) < 1.5e-7 for x in range(-40, 41))


def test_welch():
    a, b = [5.1, 4.9, 5.3, 5.0, 5.2], [6.1, 6.3, 5.9, 6.2, 6.0]
    t = stats.welch(Moments.from_values(a), Moments.from_values(b))
    assert t.t == pytest.approx(-10) and t.df == pytest.approx(8) and t.p < 1e-4 and t.d < -5
    same = stats.welch(Moments(5, 1, 0), Moments(6, 1, 0))
    apart = stats.welch(Moments(5, 2, 0), Moments(6, 1, 0))
    assert same.p == 1 and apart.p == 0 and apart.d == 10 and stats.welch(Moments(1, 1, 0), Moments(9, 1, 1)).p == 1


def test_moments_merge():
    x, y = [1.0, 5.0, 2.5], [10.0, -3.0, 7.0, 8.0]
    m, want = Moments.from_values(x) + Moments.from_values(y), Moments.from_values(x + y)
    assert (m.n, m.mean, m.var) == (want.n, pytest.approx(want.mean), pytest.approx(want.var))


def test_benjamini_hochberg():
    ps = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205]
    qs = stats.benjamini_hochberg(ps)
    assert qs[0] == pytest.approx(0.008) and qs == sorted(qs) and all(q >= p for p, q in zip(ps, qs, strict=True)) and max(qs) <= 1
    assert stats.benjamini_hochberg(ps[::-1]) == qs[::-1] and stats.benjamini_hochberg([]) == []


def test_concentration():
    assert stats.gini([5, 5, 5, 5]) == pytest.approx(0) and stats.gini([0] * 19 + [100]) > 0.7 and stats.gini([]) == 0
    assert stats.herfindahl([7]) == 1 and stats.herfindahl([1, 1, 1, 1]) == 0.25


def test_robust_z():
    z = stats.robust_z([10, 11, 9, 10, 12, 8, 100])
    assert z.robust and abs(z.scores[-1]) > 3.5
    flat = stats.robust_z([5, 5, 5, 5, 9])
    assert not flat.robust and flat.scores[-1] > 1 and stats.robust_z([1, 1]).scores == [0, 0]


def test_changepoint():
    c = stats.find_changepoint([10 + i % 2 for i in range(12)] + [30 + i % 2 for i in range(12)])
    assert c.index == 12 and c.before < 11 < 30 <= c.after and c.p < 0.01
    assert stats.find_changepoint([1, 2, 1, 2, 1, 2]) is None and stats.find_changepoint([10 + i % 3 for i in range(30)]) is None
