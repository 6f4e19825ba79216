"""Scalar rating expressions: noisy rounding, z-scores, predicted rating, diversified score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratinglab.functions.rng import hash_normal

# Fixed values that define results (they must equal the reference's).
# Inference kernel g(t), monomial coefficients low order first, valid for rank 6:
#   -17.647, 171.865, -664.272, 1273.414, -1210.543, 456.619
# cutoff 0.4, epsilon 1e-5, diversification weight B 0.5, picks per user N 5.
# Sampler: noise sd 0.1, lowest kept rating 1, one pseudo-count per star 1..5,
# 100 accepted draws, at most 100000 proposals; thresholds 110 (trusted, job),
# 120 (trusted, study), 45 (plain moments); ridge L2 0.2; ALS rank 6, 25 iterations,
# reg 0.1 plain / 0.2 normalised; study sizes 5, 10, 15, 20, 25.
INFERENCE_KERNEL = [-17.647, 171.865, -664.272, 1273.414, -1210.543, 456.619]
INFERENCE_CUTOFF = 0.4
EPSILON = 1e-5
B_DEFAULT = 0.5
N_DEFAULT = 5
NOISE_SD = 0.1
MIN_RATING = 1.0
ACCEPTS = 100
MAX_ITER = 100000
TRUSTED_MIN_JOB = 110
TRUSTED_MIN_STUDY = 120
SAMPLE_MIN = 45
RIDGE_REG = 0.2
STUDY_SIZES = (5, 10, 15, 20, 25)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_up(x: Column) -> Column:
    """Round half up to an integer, as ``floor(x + 0.5)`` (same in every engine)."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def noisy_round(rating, seed: int, noise_sd: float = NOISE_SD, keys=("user_id", "item_id")) -> Column:
    """round(r + N(0, sd)) with the normal draw hashed from the rating's key."""
    z = hash_normal(seed, "noise", *keys)
    return half_up(_c(rating) + z * F.lit(float(noise_sd)))


def zscore(rating, mean, std) -> Column:
    """Guarded z-score: ``rating - mean`` when std is 0."""
    r, m, s = _c(rating), _c(mean), _c(std)
    return F.when(s == 0, r - m).otherwise((r - m) / s)


def inverse_zscore(prediction, mean, std) -> Column:
    """prediction * std + mean (does not undo the std == 0 branch, on purpose)."""
    return _c(prediction).cast("double") * _c(std) + _c(mean)


def predict_rating(mean, std, dot_uv, rounding: str = "literal") -> Column:
    """Predicted stars clamped to 1..5.

    ``literal``: round(mean + std*dot*2) then integer halving (whole stars);
    ``half_star``: round((mean + std*dot)*2) / 2.
    Integer halving truncates and floor differs only below zero, where the clamp
    gives 1 either way, so ``floor`` is used.
    """
    m, s, d = _c(mean), _c(std), _c(dot_uv)
    if rounding == "literal":
        raw = F.floor(half_up(m + s * d * F.lit(2.0)) / F.lit(2)).cast("double")
    elif rounding == "half_star":
        raw = half_up((m + s * d) * F.lit(2.0)).cast("double") / F.lit(2.0)
    else:
        raise ValueError(f"rounding must be 'literal' or 'half_star', got {rounding!r}")
    return F.least(F.greatest(raw, F.lit(1.0)), F.lit(5.0))


def ln_jvm(x) -> Column:
    """Natural log with the JVM's edge values (Spark's ``log`` gives NULL instead):
    -inf at 0 and NaN below 0."""
    x = _c(x)
    return (F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf")))
            .otherwise(F.lit(float("nan"))))


def diversified_score(predicted, pdf, b: float = B_DEFAULT, epsilon: float = EPSILON) -> Column:
    """predicted - B * ln(pdf + epsilon). The kernel dips just below 0 above the cutoff,
    so ``pdf + epsilon`` can be negative: the score is then NaN, as in the reference."""
    return _c(predicted) - F.lit(float(b)) * ln_jvm(_c(pdf) + F.lit(float(epsilon)))
