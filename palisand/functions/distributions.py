"""Distribution functions that Spark lacks, for single values and small arrays."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def beta_part(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_part(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f = 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + step * d) or 1e-30)
        c = 1 + step / c or 1e-30
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's distribution."""
    return beta_part(df / 2, 0.5, df / (df + t * t))


def kolmogorov(d: float, n: int) -> float:
    """P(D_n >= d), asymptotically with the finite-sample factor."""
    x = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def binomial_two_sided(k: int, n: int, p: float = 0.5) -> float:
    """Sum of the probabilities that aren't larger than that of k."""
    i = np.arange(n + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in range(n + 1)]) + i * math.log(p) + (n - i) * math.log1p(-p)
    pmf = np.exp(logs)
    return float(min(1.0, pmf[pmf <= pmf[k] * (1 + 1e-7)].sum()))


def shapiro(x: np.ndarray) -> tuple[float, float]:
    """W and its p-value by Royston's approximation (n from 12; algorithm AS R94's published polynomials)."""
    from statistics import NormalDist

    n, norm = len(x), NormalDist()
    m = np.array([norm.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ssq, rsn = float(m @ m), 1 / math.sqrt(n)
    a = m / math.sqrt(ssq)
    # fixed values: the published polynomial coefficients of the two outer weights
    last = a[-1] + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], rsn)
    second = a[-2] + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], rsn)
    phi = (ssq - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
    a = m / math.sqrt(phi)
    a[-1], a[-2], a[0], a[1] = last, second, -last, -second
    s = np.sort(x)
    w = float((a @ s) ** 2 / ((s - s.mean()) ** 2).sum())
    # fixed values: the published polynomials of the mean and deviation of log(1 - W)
    log_n = math.log(n)
    mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log_n)
    sigma = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], log_n))
    return w, 1 - norm.cdf((math.log(max(1 - w, 1e-300)) - mu) / sigma)


def simplex_search(f: Callable[[np.ndarray], float], start: np.ndarray, size: float, steps: int = 400, tol: float = 1e-9) -> np.ndarray:
    """A minimum of f near start by Nelder and Mead's method."""
    n = len(start)
    points = [np.array(start, dtype=float), *(np.array(start, dtype=float) + size * e for e in np.eye(n))]
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < tol * (1 + abs(values[0])):
            break
        middle = np.mean(points[:-1], axis=0)
        tried = middle + (middle - points[-1])
        got = f(tried)
        if got < values[0]:
            far = middle + 2 * (middle - points[-1])
            more = f(far)
            points[-1], values[-1] = (far, more) if more < got else (tried, got)
        elif got < values[-2]:
            points[-1], values[-1] = tried, got
        else:
            near = middle + 0.5 * ((tried if got < values[-1] else points[-1]) - middle)
            less = f(near)
            if less < min(got, values[-1]):
                points[-1], values[-1] = near, less
            else:
                points = [points[0], *(points[0] + 0.5 * (p - points[0]) for p in points[1:])]
                values = [values[0], *(f(p) for p in points[1:])]
    return points[int(np.argmin(values))]
