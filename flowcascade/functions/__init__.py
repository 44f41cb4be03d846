"""Column-to-column building blocks."""

from flowcascade.functions.arrays import (
    argmax,
    linear_scores,
    logsumexp,
    pad_scores,
    softmax,
    with_softmax,
)
from flowcascade.functions.numbers import (
    finite_or_zero,
    is_finite,
    is_missing,
    looks_numeric,
    nan_to_null,
    quoted,
    to_double,
)

__all__ = [
    "argmax", "finite_or_zero", "is_finite", "is_missing", "linear_scores",
    "logsumexp", "looks_numeric", "nan_to_null", "pad_scores", "quoted", "softmax",
    "to_double", "with_softmax",
]
