"""Feature engineering: one-hot, min-max scaling, PCA.

Fitting reads the table once for the categories and once for the moments, from which
ranges, means and the components follow, and keeps only small state on the driver:
category lists, one minimum, maximum and mean per feature, and the loadings.  Applying
the state is a single row-wise projection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, ElementwiseProduct, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcascade.functions import finite_or_zero, quoted
from flowcascade.operators.clean import Accounting, Fences, numeric_columns
from flowcascade.operators.moments import TableMoments, moment_rows, table_moments
from flowcascade.schema import (
    CATEGORICAL_FEATURES,
    DEFAULT_COMPONENTS,
    resolve_label,
)

COMPONENT_PREFIX = "pca_component_"

_INPUT, _RAW, _OUT = "__scaled", "__projected", "__components"


@dataclass(frozen=True)
class Range:
    """Minimum, maximum and mean of one feature before scaling."""

    low: float
    high: float
    mean: float

    @property
    def divisor(self) -> float:
        """The range, or 1 for a constant feature."""
        return (self.high - self.low) or 1.0


@dataclass
class FeatureState:
    """Everything a transform needs that was learned from the training table."""

    categories: dict[str, list] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)
    ranges: dict[str, Range] = field(default_factory=dict)
    components: int = DEFAULT_COMPONENTS
    explained: list[float] = field(default_factory=list)
    projection: PipelineModel | None = None
    label_map: dict[str, int] = field(default_factory=dict)
    fences: Fences = field(default_factory=dict)
    accounting: Accounting = field(default_factory=list)

    @property
    def output_columns(self) -> list[str]:
        return [f"{COMPONENT_PREFIX}{i + 1}" for i in range(self.components)]


# --- one-hot ---------------------------------------------------------------
def category_name(column: str, value) -> str:
    """``Protocol_6`` for 6 and for 6.0."""
    whole = isinstance(value, float) and value.is_integer()
    return f"{column}_{int(value) if whole else value}"


def fit_one_hot(df: DataFrame, column: str, max_categories: int | None = None) -> list:
    """Sorted distinct categories, in the order of the column's own type.

    With ``max_categories`` a column of more raises ``ValueError``; by default there is no
    limit.
    """
    distinct = (
        df.select(quoted(column).alias("v")).filter(F.col("v").isNotNull())
        .distinct().orderBy("v")
    )
    found = (distinct if max_categories is None else distinct.limit(max_categories + 1)).collect()
    if max_categories is not None and len(found) > max_categories:
        raise ValueError(f"column {column!r} has more than {max_categories} categories")
    return [r["v"] for r in found]


def already_encoded(columns: list[str], column: str) -> bool:
    return any(c.startswith(f"{column}_") for c in columns)


def one_hot(df: DataFrame, column: str, categories: list) -> DataFrame:
    """Replace ``column`` by 0/1 columns at the end; an unknown value sets none."""
    source = quoted(column)
    flags = [
        F.when(source == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0)).alias(category_name(column, v))
        for v in categories]
    return df.select(*[quoted(c) for c in df.columns if c != column], *flags)


def encode_categories(df: DataFrame, categories: dict[str, list]) -> DataFrame:
    for column, values in categories.items():
        if column in df.columns and not already_encoded(df.columns, column):
            df = one_hot(df, column, values)
    return df


# --- min-max ---------------------------------------------------------------
def fit_ranges(df: DataFrame, cols: list[str]) -> dict[str, Range]:
    """Minimum, maximum and mean of every column in one aggregate."""
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        v = quoted(c).cast("double")
        aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.avg(v).alias(f"av{i}")]
    row = df.agg(*aggs).first()
    if row["lo0"] is None:
        raise ValueError("cannot fit on a table without rows")
    return {c: Range(row[f"lo{i}"], row[f"hi{i}"], row[f"av{i}"]) for i, c in enumerate(cols)}


def min_max(c: Column, r: Range) -> Column:
    """(x - min) / (max - min), with divisor 1 for a constant feature; no clamping."""
    return (c.cast("double") - F.lit(r.low)) / F.lit(r.divisor)


def minmax_apply(df: DataFrame, ranges: dict[str, Range]) -> DataFrame:
    return df.select(*[
        min_max(quoted(c), ranges[c]).alias(c) if c in ranges else quoted(c)
        for c in df.columns])


# --- PCA -------------------------------------------------------------------
def _centred(df: DataFrame, order: list[str], ranges: dict[str, Range],
             keep: list[Column]) -> DataFrame:
    """Scaled features minus their scaled means, assembled into one vector."""
    missing = [c for c in order if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    scaled = [
        (min_max(quoted(c), ranges[c])
         - F.lit((ranges[c].mean - ranges[c].low) / ranges[c].divisor)).alias(f"__f{i}")
        for i, c in enumerate(order)]
    return df.select(*keep, *scaled)


def _largest_positive(loadings: np.ndarray) -> list[float]:
    """Per component the sign that makes its largest absolute loading positive."""
    rows = np.abs(loadings).argmax(axis=0)
    return [1.0 if loadings[r, j] >= 0 else -1.0 for j, r in enumerate(rows)]


def ranges_of(moments: TableMoments, order: list[str]) -> dict[str, Range]:
    """Minimum, maximum and mean per feature, all of them finite."""
    if not moments.n:
        raise ValueError("cannot fit on a table without rows" + (
            " that have all features" if moments.missing else ""))
    if moments.missing:
        raise ValueError(f"{moments.missing} rows miss features")
    ranges = {c: Range(float(a), float(b), float(m)) for c, a, b, m in
              zip(order, moments.low, moments.high, moments.mean)}
    infinite = [c for c, r in ranges.items()
                if not np.isfinite([r.low, r.high, r.mean]).all()]
    if infinite:
        raise ValueError(f"features hold infinite values: {infinite}")
    return ranges


def fit_projection(df: DataFrame, order: list[str], ranges: dict[str, Range], components: int,
                   moments: TableMoments | None = None) -> tuple[PipelineModel, list[float]]:
    """PCA on centred min-max features; component signs are made definite.

    It needs the features' covariance only.  Spark's PCA gets a few rows that have exactly
    this covariance; the table is read for ``moments``, once, or not at all if they are known.
    """
    if components > len(order):
        raise ValueError(f"{components} components asked of {len(order)} features")
    if moments is None:
        moments = table_moments(df, order)
        ranges_of(moments, order)           # refuses what has no covariance
    divisors = np.array([ranges[c].divisor for c in order])
    rows = moment_rows(moments.covariance / np.outer(divisors, divisors))
    few = df.sparkSession.createDataFrame(
        [(Vectors.dense(r.tolist()),) for r in rows], [_INPUT])
    pca = PCA(k=components, inputCol=_INPUT, outputCol=_RAW).fit(few)
    signs = _largest_positive(pca.pc.toArray())
    # a missing input must not fail a whole scoring job: it ends up as 0 components
    assembler = VectorAssembler(inputCols=[f"__f{i}" for i in range(len(order))],
                                outputCol=_INPUT, handleInvalid="keep")
    flip = ElementwiseProduct(
        scalingVec=Vectors.dense(signs), inputCol=_RAW, outputCol=_OUT)
    return PipelineModel([assembler, pca, flip]), [float(v) for v in pca.explainedVariance]


def loadings(state: FeatureState, spark: SparkSession) -> DataFrame:
    """``(component, feature, loading)`` of every kept component and feature."""
    _, pca, flip = state.projection.stages
    matrix = pca.pc.toArray() * np.array(flip.getScalingVec().toArray())
    rows = [(j + 1, c, float(matrix[i, j])) for i, c in enumerate(state.order)
            for j in range(state.components)]
    return spark.createDataFrame(rows, "component int, feature string, loading double")


def explained_variance(state: FeatureState, df: DataFrame) -> DataFrame:
    """``(component, ratio, cumulative)``; one row per kept component."""
    total = 0.0
    rows = []
    for i, ratio in enumerate(state.explained):
        total += ratio
        rows.append((i + 1, ratio, total))
    return df.sparkSession.createDataFrame(rows, "component int, ratio double, cumulative double")


# --- fit / apply -----------------------------------------------------------
def fit_features(df: DataFrame, components: int = DEFAULT_COMPONENTS,
                 categorical: Iterable[str] = CATEGORICAL_FEATURES,
                 ignore: Iterable[str] = (), max_categories: int | None = None) -> FeatureState:
    """Learn categories, feature order, ranges and projection from a clean table.

    Every category becomes a column of the covariance matrix; ``max_categories`` refuses
    columns of more (by default none is refused).
    """
    categories = {
        c: fit_one_hot(df, c, max_categories) for c in categorical
        if c in df.columns and not already_encoded(df.columns, c)}
    encoded = encode_categories(df, categories)
    order = numeric_columns(encoded, [resolve_label(df.columns), *ignore])
    if components > len(order):
        raise ValueError(f"{components} components asked of {len(order)} features")
    moments = table_moments(encoded, order)
    ranges = ranges_of(moments, order)
    projection, explained = fit_projection(encoded, order, ranges, components, moments)
    return FeatureState(categories, order, ranges, components, explained, projection)


def apply_features(df: DataFrame, state: FeatureState, keep: Iterable[str] | None = None,
                   transform: Callable[[Column], Column] | None = None,
                   as_array: bool = False) -> DataFrame:
    """Components of every row, and the columns to carry along (by default the label).

    ``transform`` is applied to the array of components of each row.  With
    ``as_array`` they come as one ``features`` column of floats instead of one
    column per component.
    """
    if keep is None:
        label = resolve_label(df.columns)
        keep = [label] if label else []
    keep = list(keep)
    encoded = encode_categories(df, state.categories)
    lost = [c for c in keep if c not in encoded.columns]
    if lost:
        raise ValueError(f"no such column to keep: {lost}")
    carried = [quoted(c).alias(f"__k{i}") for i, c in enumerate(keep)]
    centred = _centred(encoded, state.order, state.ranges, carried)
    components = vector_to_array(F.col(_OUT))
    if transform is not None:
        components = transform(components)
    projected = state.projection.transform(centred)
    names = [F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)]
    if as_array:
        clean = F.transform(components, finite_or_zero)
        return projected.select(clean.cast("array<float>").alias("features"), *names)
    arrays = projected.select(components.alias("__c"), *names)
    return arrays.select(
        *[finite_or_zero(F.col("__c")[i]).alias(c) for i, c in enumerate(state.output_columns)],
        *[quoted(c) for c in keep])


def single_precision(column: str) -> Column:
    """A component at the precision a sample has."""
    return quoted(column).cast("float").cast("double")


def feature_vector(columns: list[str], out: str = "features") -> Column:
    """Component columns as the ML vector the classifiers take."""
    return array_to_vector(F.array(*[single_precision(c) for c in columns])).alias(out)
