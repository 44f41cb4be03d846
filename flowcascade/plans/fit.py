"""Fitting one classifier per node and choosing among candidates."""

from __future__ import annotations

import logging
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcascade.functions import argmax
from flowcascade.operators.bayes import (
    GaussianBayes,
    GaussianBayesModel,
    class_moments,
    level_moments,
)
from flowcascade.operators.evaluate import cross_entropy
from flowcascade.operators.sample import WEIGHT, priority_sample
from flowcascade.plans.prepare import level_datasets
from flowcascade.plans.scoring import (
    FEATURES,
    component_columns,
    component_values,
    score_side_by_side,
    with_feature_vector,
)
from flowcascade.schema import NODE_BY_LEVEL, Node, node_of
from flowcascade.session import discard_stage, stage

log = logging.getLogger(__name__)

TARGET = "__target"
DEFAULT_PENALTY = 0.001
DEFAULT_PATIENCE = 5

HISTORY_SCHEMA = ("level int, round int, train_loss double, val_loss double, "
                  "train_acc double, val_acc double")


def logistic(penalty: float = DEFAULT_PENALTY, iterations: int = 50) -> LogisticRegression:
    """Multinomial logistic regression with an L2 penalty and an iteration budget."""
    return LogisticRegression(family="multinomial", regParam=penalty, maxIter=iterations)


# A round refits with a larger iteration budget.
DEFAULT_CANDIDATES = tuple((DEFAULT_PENALTY, n) for n in (5, 10, 20, 40))

Candidate = Estimator | GaussianBayes | tuple[float, int]
Fitted = Model | GaussianBayesModel


@dataclass
class Round:
    """Losses are means over rows, accuracies are in percent; null without rows to measure."""

    level: int
    round: int
    train_loss: float | None
    val_loss: float | None
    train_acc: float | None
    val_acc: float | None


@dataclass
class Selection:
    model: Fitted | None
    best_round: int
    best_loss: float
    history: list[Round]


@dataclass
class Cascade:
    """Fitted nodes by name, what happened in every round, and the nodes left out."""

    models: dict[str, Fitted] = field(default_factory=dict)
    history: list[Round] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)


def _estimator(candidate: Candidate | None) -> Estimator:
    if candidate is None:
        return logistic()
    if isinstance(candidate, tuple):
        return logistic(*candidate)
    return candidate


def _fit_rows(rows: DataFrame, node: Node, max_fit_rows: int | None) -> DataFrame:
    """Feature vector and target of the rows to fit on: all, or a weighted sample."""
    weight = []
    if max_fit_rows is not None:
        columns = [*component_columns(rows), node.label_column]
        rows = stage(priority_sample(rows.select(*columns), node.label_column, max_fit_rows),
                     "fit-sample")
        weight = [WEIGHT]
    return with_feature_vector(rows).select(
        FEATURES, F.col(node.label_column).cast("double").alias(TARGET), *weight)


def _set_up(candidate: Candidate | None, weighted: bool) -> Estimator:
    estimator = _estimator(candidate).copy()
    estimator.setFeaturesCol(FEATURES).setLabelCol(TARGET)
    if weighted:
        if not estimator.hasParam("weightCol"):
            raise ValueError(f"{type(estimator).__name__} takes no weights, "
                             "so it cannot be fitted on a sample")
        estimator.set(estimator.weightCol, WEIGHT)
    return estimator


def fit_candidates(train: DataFrame, level: int | str, candidates: Sequence[Candidate | None],
                   max_fit_rows: int | None = None) -> list[Fitted]:
    """Fit candidates of one node on the rows whose *true* label belongs to it.

    All naive Bayes candidates come from one scan of their moments; the others are fitted
    one by one.  With ``max_fit_rows`` those others see a weighted sample of at most so many
    rows of each class, the same for any partitioning; by default they see all rows.
    """
    node = node_of(level)
    rows = train.filter(F.col(node.label_column) >= 0)
    ready, classes, models = None, None, []
    for candidate in candidates:
        if isinstance(candidate, GaussianBayes):
            if classes is None:
                classes = class_moments(level_moments(rows, component_values(rows)), node)
            models.append(candidate.fit(classes, node.width))
            continue
        estimator = _set_up(candidate, max_fit_rows is not None)
        if ready is None:
            ready = _fit_rows(rows, node, max_fit_rows)
        models.append(estimator.fit(ready))
    if ready is not None and max_fit_rows is not None:
        discard_stage(ready)
    return models


def fit_node(train: DataFrame, level: int | str, candidate: Candidate | None = None,
             max_fit_rows: int | None = None) -> Fitted:
    """Fit one node on the rows whose *true* label belongs to it."""
    return fit_candidates(train, level, [candidate], max_fit_rows)[0]


Quality = tuple[int, float | None, float | None]


def node_qualities(df: DataFrame, models: Sequence[Fitted], node: Node) -> list[Quality]:
    """``(rows, loss, accuracy)`` of models of one node on the rows its level applies to.

    All models are measured by one aggregate in one scan.  Without such rows loss and
    accuracy are null, and so is a loss that is no number.
    """
    rows = df.filter(F.col(node.label_column) >= 0)
    scored, columns = score_side_by_side(rows, models, node.name, "__scores")
    target, aggs = F.col(node.label_column), [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        aggs += [F.avg(cross_entropy(F.col(c), target, node.width)).alias(f"loss{i}"),
                 F.count_if(argmax(F.col(c)) == target).alias(f"hits{i}")]
    row = scored.agg(*aggs).first()
    n, found = row["n"], []
    for i in range(len(columns)):
        loss = row[f"loss{i}"]
        if loss is not None and math.isnan(loss):
            loss = None
        found.append((n, loss, 100.0 * row[f"hits{i}"] / n if n else None))
    return found


def node_quality(df: DataFrame, model: Fitted, node: Node) -> Quality:
    """``(rows, loss, accuracy)`` of one model of a node."""
    return node_qualities(df, [model], node)[0]


def select_model(train: DataFrame, valid: DataFrame, level: int | str,
                 candidates: Sequence[Candidate] = DEFAULT_CANDIDATES,
                 patience: int = DEFAULT_PATIENCE,
                 max_fit_rows: int | None = None) -> Selection:
    """Keep the candidate with the strictly lowest validation loss.

    Candidates count in order, one per round; trying stops after ``patience`` rounds in a
    row without improvement.  As many as will be tried in any case, whatever their losses,
    are fitted together and measured side by side, in one scan of each table.  Without
    validation rows the training loss decides.  If both are the same table, the models are
    measured on it once.  A candidate whose loss is no number is
    never chosen.
    """
    node = node_of(level)
    chosen = Selection(None, 0, float("inf"), [])
    stale, number = 0, 0
    same = train.sameSemantics(valid)
    while number < len(candidates) and (stale < patience or not number):
        certain = candidates[number:number + max(patience - stale, 1)]
        models = fit_candidates(train, node.level, certain, max_fit_rows)
        on_train = node_qualities(train, models, node)
        on_valid = on_train if same else node_qualities(valid, models, node)
        measured = zip(models, on_train, on_valid)
        for model, (_, train_loss, train_acc), (val_rows, val_loss, val_acc) in measured:
            number += 1
            chosen.history.append(
                Round(node.level, number, train_loss, val_loss, train_acc, val_acc))
            loss = val_loss if val_rows else train_loss
            if loss is not None and loss < chosen.best_loss:
                chosen.model, chosen.best_round, chosen.best_loss = model, number, loss
                stale = 0
            else:
                stale += 1
    return chosen


def fit_cascade(datasets: Mapping[int, tuple[DataFrame, DataFrame]],
                candidates: Sequence[Candidate] = DEFAULT_CANDIDATES,
                patience: int = DEFAULT_PATIENCE,
                max_fit_rows: int | None = None) -> Cascade:
    """Fit every node that has data, in level order; the others are skipped."""
    fitted = Cascade()
    for level, node in sorted(NODE_BY_LEVEL.items()):
        if level not in datasets:
            log.warning("node %s has no data and is skipped", node.name)
            fitted.skipped.append(node.name)
            continue
        chosen = select_model(*datasets[level], level, candidates, patience, max_fit_rows)
        fitted.history += chosen.history
        if chosen.model is None:
            log.warning("node %s got no model", node.name)
            fitted.skipped.append(node.name)
        else:
            fitted.models[node.name] = chosen.model
    return fitted


def fit_bayes(train: DataFrame, candidate: GaussianBayes = GaussianBayes()) -> Cascade:
    """Fit naive Bayes at every node from one scan of a labelled table."""
    found = level_moments(train, component_values(train))
    fitted = Cascade()
    for _, node in sorted(NODE_BY_LEVEL.items()):
        classes = class_moments(found, node)
        if classes:
            fitted.models[node.name] = candidate.fit(classes, node.width)
        else:
            log.warning("node %s has no data and is skipped", node.name)
            fitted.skipped.append(node.name)
    return fitted


def fit_tables(train: DataFrame, valid: DataFrame, **options) -> Cascade:
    """Fit the cascade on two prepared tables."""
    return fit_cascade(level_datasets(train, valid), **options)


def history_table(spark: SparkSession, history: list[Round]) -> DataFrame:
    """One row per node and round."""
    rows = [(r.level, r.round, r.train_loss, r.val_loss, r.train_acc, r.val_acc)
            for r in history]
    return spark.createDataFrame(rows, HISTORY_SCHEMA)
