"""Vector expressions on ``array<double>`` columns (JVM-side higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_vector(v) -> Column:
    """float array -> double array (the model stores float factors)."""
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    """Dot product of two equal-length arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm2(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v) -> Column:
    """x / |x|; NULL for a zero vector (callers drop and count those)."""
    n = norm2(v)
    return F.when(n > 0, F.transform(_c(v), lambda x: x / n))


def horner(coeffs: list[float], t: Column) -> Column:
    """sum_k coeffs[k] * t**k, coefficients low order first."""
    acc = F.lit(float(coeffs[-1]))
    for c in reversed(coeffs[:-1]):
        acc = acc * t + F.lit(float(c))
    return acc


def kernel_value(coeffs: list[float], cutoff: float, t, inclusive: bool = True) -> Column:
    """g(t) above the cutoff, 0 below. ``inclusive`` keeps ``t >= cutoff`` (inference);
    the fitting side uses ``t > cutoff`` with the argument capped at 1."""
    t = _c(t)
    keep = t >= F.lit(cutoff) if inclusive else t > F.lit(cutoff)
    return F.when(keep, horner(coeffs, t)).otherwise(F.lit(0.0))
