"""Score-array helpers.

With a known ``width`` the element expressions are written out, so they stay in
generated code; without it the higher-order functions (interpreted) are used.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowcascade.schema import MASKED_LOGIT


def _items(scores: Column, width: int) -> list[Column]:
    return [scores[i] for i in range(width)]


def _total(items: list[Column]) -> Column:
    total = items[0]
    for item in items[1:]:
        total = total + item
    return total


def softmax(scores: Column, width: int | None = None) -> Column:
    """exp(x - max) / sum, element by element."""
    peak = F.array_max(scores)
    if width is None:
        shifted = F.transform(scores, lambda x: F.exp(x - peak))
        total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x)
        return F.transform(shifted, lambda x: x / total)
    shifted = [F.exp(x - peak) for x in _items(scores, width)]
    total = _total(shifted)
    return F.array(*[x / total for x in shifted])


def with_softmax(df: DataFrame, wanted: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Add ``{name: softmax of (score column, width)}``.

    Maximum, exponentials and sum get a projection each, so every exponential is
    evaluated once and the generated code stays short.
    """
    names = list(wanted)
    source = {n: F.col(f"`{wanted[n][0]}`") for n in names}
    width = {n: wanted[n][1] for n in names}
    peaks = df.withColumns({f"__max_{n}": F.array_max(source[n]) for n in names})
    powers = peaks.withColumns({
        f"__exp_{n}": F.array(*[F.exp(x - F.col(f"__max_{n}"))
                                for x in _items(source[n], width[n])]) for n in names})
    sums = powers.withColumns({
        f"__sum_{n}": _total(_items(F.col(f"__exp_{n}"), width[n])) for n in names})
    out = sums.withColumns({
        n: F.array(*[x / F.col(f"__sum_{n}") for x in _items(F.col(f"__exp_{n}"), width[n])])
        for n in names})
    return out.drop(*[f"__{part}_{n}" for n in names for part in ("max", "exp", "sum")])


def logsumexp(scores: Column, width: int | None = None, peak: Column | None = None) -> Column:
    """``peak`` is the largest score, if a column already has it."""
    peak = F.array_max(scores) if peak is None else peak
    if width is None:
        total = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + F.exp(x - peak))
    else:
        total = _total([F.exp(x - peak) for x in _items(scores, width)])
    return peak + F.ln(total)


def argmax(scores: Column) -> Column:
    """0-based index of the largest element, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def pad_scores(scores: Column, width: int) -> Column:
    """Extend a score array to ``width`` with scores that can never win."""
    missing = F.greatest(F.lit(width) - F.size(scores), F.lit(0))
    return F.concat(scores, F.array_repeat(F.lit(MASKED_LOGIT), missing))


def linear_scores(features: list[Column], weights: list[list[float]],
                  intercepts: list[float]) -> Column:
    """One score per class: the weighted sum of the features plus an intercept."""
    scores = []
    for row, intercept in zip(weights, intercepts):
        terms = [c * F.lit(float(w)) for c, w in zip(features, row)]
        scores.append(_total(terms) + F.lit(float(intercept)))
    return F.array(*scores)
