"""Scalar statistics that Spark has no built-in for."""

from __future__ import annotations

import math


def _log_beta_half(a: float) -> float:
    """ln B(a, 1/2), with the large-argument series where lgamma would cancel."""
    if a > 1e4:
        gap = 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a ** 3)
    else:
        gap = math.lgamma(a + 0.5) - math.lgamma(a)
    return math.lgamma(0.5) - gap


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated until it settles."""
    floor = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > floor else floor)
    value, m = d, 0
    while True:
        m += 1
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > floor else floor)
            c = 1.0 + top / c
            c = c if abs(c) > floor else floor
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-16 or m > 1_000_000:
            return value


def correlation_p(rho: float | None, n: int | None) -> float | None:
    """Two-sided Student-t p-value of a rank correlation with n - 2 degrees of freedom."""
    if rho is None or n is None or math.isnan(rho) or n < 3:
        return None
    square = min(rho * rho, 1.0)
    if square == 1.0:
        return 0.0
    a, b, x = (n - 2) / 2.0, 0.5, (1.0 - rho) * (1.0 + rho)
    front = math.exp(a * math.log1p(-square) + b * math.log(square) - _log_beta_half(a)) \
        if square > 0 else 0.0
    if x < (a + 1.0) / (a + b + 2.0):
        return min(1.0, front * _beta_fraction(a, b, x) / a)
    return max(0.0, 1.0 - front * _beta_fraction(b, a, square) / b)

