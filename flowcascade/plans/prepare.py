"""From a flow CSV (or table) to components, label codes and level labels."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcascade.functions import quoted
from flowcascade.operators.clean import (
    FENCE_MULTIPLIER,
    Accounting,
    clip_to,
    dedup,
    drop_missing,
    iqr_fences,
    stage_counted,
)
from flowcascade.operators.features import FeatureState, apply_features, fit_features
from flowcascade.operators.labels import (
    fit_label_map,
    hierarchical_labels,
    label_is_numeric,
    present_level_ids,
    resolve_leaf,
    select_level,
    stage_by_leaf,
)
from flowcascade.schema import DEFAULT_COMPONENTS, LEVEL_COLUMNS, require_label
from flowcascade.session import stage
from flowcascade.sources.flows import stage_clean_flows


def prepare(spark: SparkSession, source: str | DataFrame, state: FeatureState | None = None,
            hierarchical: bool = True, components: int = DEFAULT_COMPONENTS,
            fences: str = "stored", k: float = FENCE_MULTIPLIER, approx: bool = False,
            exclude: Iterable[str] = (), label_map: dict[str, int] | None = None,
            keep: Iterable[str] = (),
            transform: Callable[[Column], Column] | None = None, accounting: bool = False,
            ) -> tuple[DataFrame, FeatureState]:
    """Load, clean, build features, attach labels.

    Without ``state`` one is fitted on this input; with it the stored one is
    applied.  ``fences="stored"`` limits outliers with the training fences,
    ``"refit"`` measures them on this input.  Columns in ``keep`` are carried
    along untouched: they take no part in features or the test for missing values, but in
    de-duplication.  Of a CSV they stay text.  With ``accounting`` a state that is fitted
    here also says how many rows each cleaning step read and removed.

    Output: ``keep``, ``pca_component_*``, ``leaf``, ``label_code`` and, if
    ``hierarchical``, ``level1`` .. ``level5``.
    """
    keep = list(keep)
    counts: Accounting | None = [] if accounting and state is None else None
    if isinstance(source, str):
        table = stage_clean_flows(spark, source, keep=keep, accounting=counts)
        fresh = True
    elif counts is not None:
        table, counts[:] = stage_counted(source, "clean", keep)
        fresh = True
    else:
        table, fresh = drop_missing(dedup(source), ignore=keep), False
    label = require_label(table.columns)
    fitting = state is None
    measure = fitting or fences == "refit"
    if measure and not fresh:
        table = stage(table, "clean")
    if measure:
        limits = iqr_fences(table, None, k, approx, [label, *exclude, *keep])
    else:
        limits = state.fences
    table = clip_to(table, limits)
    if fitting:
        state = fit_features(table, components, ignore=keep)
        state.fences = limits
        state.accounting = counts or []
        numeric_label = label_is_numeric(table, label)
        state.label_map = label_map or (
            {} if numeric_label else fit_label_map(table, label))
    features = apply_features(table, state, [*keep, label], transform)
    labelled = resolve_leaf(
        features.withColumnRenamed(label, "__label"), "__label", state.label_map)
    if hierarchical:
        labelled = hierarchical_labels(labelled, "leaf")
    levels = LEVEL_COLUMNS if hierarchical else []
    return labelled.select(
        *[quoted(c) for c in keep], *[F.col(c) for c in state.output_columns],
        "leaf", "label_code", *levels), state


def level_datasets(train: DataFrame, valid: DataFrame,
                   staged: bool = True) -> dict[int, tuple[DataFrame, DataFrame]]:
    """``{level: (train rows, valid rows)}`` for the levels present in training.

    Both tables are written down once, by leaf, and every level reads its leaves' folders.
    """
    if staged:
        train, valid = stage_by_leaf(train, "train"), stage_by_leaf(valid, "valid")
    return {level: (select_level(train, level), select_level(valid, level))
            for level in present_level_ids(train)}
