"""Distribution tails and gamma-family functions on numpy arrays, for use inside tasks."""

from __future__ import annotations

import math

import numpy as np

_TINY = 1e-300

# fixed values: Lanczos coefficients for g = 7
_LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)


def gammaln(x):
    """Log of the gamma function for positive arguments."""
    x = np.asarray(x, dtype=float)
    small = x < 0.5
    z = np.where(small, 1.0 - x, x) - 1.0
    series = np.full_like(z, _LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], start=1):
        series = series + c / (z + i)
    t = z + 7.5
    out = 0.5 * math.log(2 * math.pi) + (z + 0.5) * np.log(t) - t + np.log(series)
    with np.errstate(divide="ignore", invalid="ignore"):
        mirrored = np.log(np.pi / np.abs(np.sin(np.pi * x))) - out
    return np.where(small, mirrored, out)


def betaln(a, b):
    return gammaln(a) + gammaln(b) - gammaln(np.asarray(a) + np.asarray(b))


def _shift_up(x, step, limit=10.0):
    """Sum of ``step`` over the recurrence and the argument moved above ``limit``."""
    x = np.array(x, dtype=float, ndmin=1)
    total = np.zeros_like(x)
    while True:
        low = x < limit
        if not low.any():
            return x, total
        total[low] += step(x[low])
        x[low] += 1.0


def digamma(x):
    """Derivative of the log gamma function for positive arguments."""
    y, total = _shift_up(x, lambda v: -1.0 / v)
    w = 1.0 / (y * y)
    tail = w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w * (1 / 240 - w / 132))))
    return (total + np.log(y) - 0.5 / y - tail).reshape(np.shape(x))


def trigamma(x):
    """Second derivative of the log gamma function for positive arguments."""
    y, total = _shift_up(x, lambda v: 1.0 / (v * v))
    w = 1.0 / (y * y)
    tail = w * (1 / 6 - w * (1 / 30 - w * (1 / 42 - w / 30)))
    return (total + 1.0 / y + 0.5 * w + tail / y).reshape(np.shape(x))


def incomplete_beta(a, b, x):
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(p * np.log(z) + q * np.log1p(-z) - betaln(p, q)) / p
        c = np.ones_like(z)
        d = 1.0 / np.where(np.abs(1 - (p + q) * z / (p + 1)) < _TINY, _TINY, 1 - (p + q) * z / (p + 1))
        h = d.copy()
        for m in range(1, 400):
            even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            for term in (even, odd):
                d = 1.0 + term * d
                d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
                c = 1.0 + term / c
                c = np.where(np.abs(c) < _TINY, _TINY, c)
                h = h * d * c
            if np.nanmax(np.abs(d * c - 1.0), initial=0.0) < 1e-15:
                break
        value = front * h
    value = np.where(z <= 0, 0.0, value)
    return np.where(swap, 1.0 - value, value)


def student_t_two_sided(t, df):
    """Two-sided tail of Student's t."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def f_tail(f, d1, d2):
    """Upper tail of the F distribution."""
    f = np.asarray(f, dtype=float)
    return incomplete_beta(np.asarray(d2) / 2.0, np.asarray(d1) / 2.0, d2 / (d2 + d1 * f))


def chi2_tail(x, df):
    """Upper tail of the chi-square distribution."""
    return incomplete_gamma_upper(np.asarray(df, dtype=float) / 2.0, np.asarray(x, dtype=float) / 2.0)


def incomplete_gamma_upper(a, x):
    """Regularised upper incomplete gamma function: series below a + 1, fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float))
    x = np.maximum(x, 0.0)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(-x + a * np.log(np.where(x > 0, x, 1.0)) - gammaln(a))
        term = 1.0 / a
        total = term.copy() if isinstance(term, np.ndarray) else np.asarray(term)
        for n in range(1, 1000):
            term = term * x / (a + n)
            total = total + term
            if np.nanmax(np.where(x < a + 1, term / total, 0.0), initial=0.0) < 1e-16:
                break
        series = 1.0 - front * total
        b = x + 1.0 - a
        b = np.where(np.abs(b) < _TINY, _TINY, b)
        c = np.full_like(b, 1.0 / _TINY)
        d = 1.0 / b
        h = d.copy()
        for i in range(1, 1000):
            an = -i * (i - a)
            b = b + 2.0
            d = an * d + b
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
            if np.nanmax(np.where(x >= a + 1, np.abs(d * c - 1.0), 0.0), initial=0.0) < 1e-15:
                break
        fraction = front * h
    out = np.where(x < a + 1, series, fraction)
    return np.where(x <= 0, 1.0, out)


_erfc = np.vectorize(math.erfc, otypes=[float])


def normal_two_sided(z):
    """Two-sided tail of the normal distribution."""
    return _erfc(np.abs(np.asarray(z, dtype=float)) / math.sqrt(2.0))


# fixed values: rational approximation of the normal quantile (Acklam)
_CENTRE_TOP = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
_CENTRE_LOW = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01, 1.0,
)
_TAIL_TOP = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
_TAIL_LOW = (
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
    3.754408661907416e00, 1.0,
)


def normal_quantile(p):
    """Quantile of the normal distribution, with one Halley step to full precision."""
    p = np.asarray(p, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        side = np.minimum(p, 1.0 - p)
        q = p - 0.5
        r = q * q
        centre = q * np.polyval(_CENTRE_TOP, r) / np.polyval(_CENTRE_LOW, r)
        s = np.sqrt(-2.0 * np.log(side))
        tail = np.polyval(_TAIL_TOP, s) / np.polyval(_TAIL_LOW, s)
        x = np.where(side < 0.02425, np.where(p < 0.5, tail, -tail), centre)
        error = 0.5 * _erfc(-x / math.sqrt(2.0)) - p
        u = error * math.sqrt(2.0 * math.pi) * np.exp(0.5 * x * x)
        refined = x - u / (1.0 + 0.5 * x * u)
    inside = (p > 0) & (p < 1)
    ends = np.where(p == 0, -np.inf, np.where(p == 1, np.inf, np.nan))
    return np.where(inside, refined, ends)


def log_beta_binomial(y, n, a, b):
    """Log probability of a beta-binomial count."""
    choose = gammaln(n + 1.0) - gammaln(y + 1.0) - gammaln(n - y + 1.0)
    return choose + betaln(y + a, n - y + b) - betaln(a, b)


def sigmoid(x):
    x = np.asarray(x, dtype=float)
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def logsumexp(x, axis=-1):
    """Logarithm of the sum of exponentials along an axis, without overflow."""
    x = np.asarray(x, dtype=float)
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis=axis)
