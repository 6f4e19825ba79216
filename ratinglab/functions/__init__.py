"""Column expressions (all JVM-side built-ins, codegen-friendly)."""

from ratinglab.functions.rng import hash_normal, hash_uniform
from ratinglab.functions.scoring import (diversified_score, half_up, inverse_zscore, noisy_round,
                                         predict_rating, zscore)
from ratinglab.functions.vectors import (as_vector, dot, horner, kernel_value, l2_normalize,
                                         norm2)

__all__ = [
    "hash_uniform", "hash_normal", "noisy_round", "zscore", "inverse_zscore", "predict_rating",
    "diversified_score", "half_up", "as_vector", "dot", "norm2", "l2_normalize", "horner",
    "kernel_value",
]
