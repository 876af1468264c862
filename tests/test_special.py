"""Distribution tails against known values and identities."""

import math

import numpy as np

from varloom.functions import special


def test_gamma_family():
    x = np.array([0.1, 0.7, 1.0, 2.5, 30.0, 1e4])
    assert np.allclose(special.gammaln(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    assert np.isclose(special.digamma(1.0), -0.57721566490153286)
    assert np.isclose(special.trigamma(1.0), math.pi**2 / 6)
    h = 1e-5
    slope = (special.gammaln(x[1:] + h) - special.gammaln(x[1:] - h)) / (2 * h)
    assert np.allclose(special.digamma(x[1:]), slope, rtol=1e-5)


def test_tails():
    assert np.isclose(special.student_t_two_sided(2.228138851964939, 10), 0.05)
    assert np.isclose(special.student_t_two_sided(1.0, 1), 0.5)
    assert np.isclose(special.chi2_tail(3.841458820694124, 1), 0.05)
    assert np.isclose(special.chi2_tail(5.991464547107979, 2), 0.05)
    assert np.isclose(special.f_tail(4.964602743730711, 1, 10), 0.05)
    assert np.isclose(special.chi2_tail(200.0, 1), 2.0884875837625446e-45, rtol=1e-6)
    assert np.allclose(special.chi2_tail(np.array([0.0, 4.0]), 2), [1.0, math.exp(-2)])


def test_normal_quantile_inverts_the_tail():
    p = np.array([1e-12, 1e-4, 0.02, 0.3, 0.5, 0.975, 1 - 1e-9])
    q = special.normal_quantile(p)
    back = 0.5 * np.array([math.erfc(-v / math.sqrt(2)) for v in q])
    assert np.allclose(back, p, rtol=1e-9)
    assert np.isclose(special.normal_quantile(0.975), 1.959963984540054)


def test_beta_binomial_sums_to_one():
    y = np.arange(13.0)
    total = np.exp(special.log_beta_binomial(y, 12.0, 2.3, 0.7)).sum()
    assert np.isclose(total, 1.0)
