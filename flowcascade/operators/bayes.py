"""Gaussian naive Bayes, fitted from moments.

Counts, means and variances per leaf come from one grouped aggregate and can be joined, and
every class of every node is a union of leaves: so one scan fits all nodes, whatever the
number of nodes, classes and smoothing settings.  A fitted model is a few numbers per class;
scoring is one projection.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowcascade.schema import LEVEL_COLUMNS, UNRESOLVED, Node

DEFAULT_SMOOTHING = 1e-9        # share of the largest variance that is added to all
SMALLEST_VARIANCE = 1e-300      # keeps features that never vary from dividing by zero
ABSENT = -1e18                  # score of a class without training rows


@dataclass(frozen=True)
class Moments:
    """Count, and mean and population variance per feature, of some rows."""

    n: int
    means: tuple[float, ...]
    variances: tuple[float, ...]

    def join(self, other: "Moments") -> "Moments":
        """Moments of both sets of rows together."""
        n = self.n + other.n
        share = other.n / n
        means, variances = [], []
        for m, v, o, w in zip(self.means, self.variances, other.means, other.variances):
            means.append(m + (o - m) * share)
            variances.append(v + (w - v) * share + (o - m) ** 2 * share * (1 - share))
        return Moments(n, tuple(means), tuple(variances))


def joined(parts: Iterable[Moments]) -> Moments | None:
    total = None
    for part in parts:
        total = part if total is None else total.join(part)
    return total


def level_moments(df: DataFrame, features: Sequence[Column]) -> dict[tuple[int, ...], Moments]:
    """Moments per combination of level codes: one scan, and no more rows than leaves."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(features):
        aggs += [F.avg(c).alias(f"m{i}"), F.var_pop(c).alias(f"v{i}")]
    known = df.filter(F.greatest(*[F.col(c) for c in LEVEL_COLUMNS]) > UNRESOLVED)
    rows = known.groupBy(*LEVEL_COLUMNS).agg(*aggs).collect()
    return {
        tuple(r[c] for c in LEVEL_COLUMNS): Moments(
            r["n"], tuple(r[f"m{i}"] for i in range(len(features))),
            tuple(r[f"v{i}"] for i in range(len(features))))
        for r in sorted(rows, key=lambda r: tuple(r[c] for c in LEVEL_COLUMNS))}


def class_moments(found: dict[tuple[int, ...], Moments], node: Node) -> dict[int, Moments]:
    """Moments per class of one node, joined from those of the leaves below it."""
    at = LEVEL_COLUMNS.index(node.label_column)
    classes = {}
    for code in range(node.width):
        total = joined(m for codes, m in found.items() if codes[at] == code)
        if total is not None:
            classes[code] = total
    return classes


@dataclass(frozen=True)
class GaussianBayesModel:
    """Per class the log of its share, and means and smoothed variances; null if absent."""

    priors: list[float | None]
    means: list[list[float] | None]
    variances: list[list[float] | None]

    @property
    def numClasses(self) -> int:        # noqa: N802 - as Spark's classification models say it
        return len(self.priors)

    def scores(self, features: Sequence[Column]) -> Column:
        """Log of prior times density per class, up to nothing: their softmax is the posterior."""
        found = []
        for prior, means, variances in zip(self.priors, self.means, self.variances):
            if prior is None:
                found.append(F.lit(ABSENT))
                continue
            score = F.lit(prior - 0.5 * sum(math.log(2 * math.pi * v) for v in variances))
            for c, mean, variance in zip(features, means, variances, strict=True):
                off = c - F.lit(mean)
                score = score + off * off * F.lit(-0.5 / variance)
            found.append(score)
        return F.array(*found)

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class GaussianBayes:
    """A candidate: Gaussian naive Bayes with this smoothing."""

    smoothing: float = DEFAULT_SMOOTHING

    def fit(self, classes: dict[int, Moments], width: int) -> GaussianBayesModel:
        """A model of ``width`` classes; ``smoothing`` of the node's largest variance is added."""
        if not classes:
            raise ValueError("cannot fit a classifier without rows")
        everything = joined(classes.values())
        added = self.smoothing * max(everything.variances, default=0.0)
        present = [classes.get(code) for code in range(width)]
        return GaussianBayesModel(
            [m and math.log(m.n / everything.n) for m in present],
            [m and list(m.means) for m in present],
            [m and [max(v + added, SMALLEST_VARIANCE) for v in m.variances] for m in present])
