"""Student's t distribution by the incomplete beta function."""

from __future__ import annotations

import math


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def two_sided_p(t: float, dof: float) -> float:
    return 1.0 if t == 0 else incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))


def quantile(q: float, dof: float) -> float:
    """The t with a probability of q below it, for q above one half."""
    low, high = 0.0, 1.0
    while 1 - two_sided_p(high, dof) / 2 < q:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - two_sided_p(middle, dof) / 2 < q else (low, middle)
    return (low + high) / 2
