"""Scoring tables with fitted node classifiers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import (
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowcascade.functions import argmax, linear_scores, pad_scores, quoted, softmax
from flowcascade.operators.bayes import GaussianBayesModel
from flowcascade.operators.cascade import cascade, prediction_columns
from flowcascade.operators.features import (
    COMPONENT_PREFIX,
    feature_vector,
    single_precision,
)
from flowcascade.schema import NODES, Node, node_of

FEATURES, RAW = "__features", "__raw"
SMALLEST_PROBABILITY = 1e-300

MOST_WEIGHTS = 256      # of a model that is written out
CERTAIN = 1000.0        # logit of the only class a node was fitted on


def score_column(node: Node) -> str:
    return f"scores_{node.name}"


def component_columns(df: DataFrame) -> list[str]:
    found = [c for c in df.columns if c.startswith(COMPONENT_PREFIX)]
    if not found:
        raise ValueError("no component columns")
    return sorted(found, key=lambda c: int(c.removeprefix(COMPONENT_PREFIX)))


def with_feature_vector(df: DataFrame) -> DataFrame:
    return df.withColumn(FEATURES, feature_vector(component_columns(df), FEATURES))


def component_values(df: DataFrame) -> list[Column]:
    """The components at the precision the classifiers see."""
    return [single_precision(c) for c in component_columns(df)]


def _logits(model: Model) -> tuple[str, Column]:
    """The model output to ask for, and the logits made from it."""
    raw = vector_to_array(F.col(RAW))
    if isinstance(model, MultilayerPerceptronClassificationModel):
        return "raw", raw
    if isinstance(model, LogisticRegressionModel):
        intercepts = model.interceptVector.toArray()
        if len(intercepts) == 1 and model.numClasses == 2:
            # binomial form: the margin of class 1 over class 0
            return "raw", F.array(F.lit(0.0), raw[1])
        if np.isinf(intercepts).any():
            # fitted on a single class
            return "raw", F.transform(raw, lambda x: F.greatest(
                F.least(x, F.lit(CERTAIN)), F.lit(-CERTAIN)))
        return "raw", raw
    # softmax of log-probabilities gives the probabilities back
    return "probability", F.transform(
        raw, lambda p: F.ln(F.greatest(p, F.lit(SMALLEST_PROBABILITY))))


def _is_plain(model: Model) -> bool:
    """A logistic regression with one finite row of weights per class.

    Its margins are written out as an expression: per row and node that spares making a vector
    and reading the margins back from another.
    """
    return (isinstance(model, LogisticRegressionModel)
            and len(model.interceptVector) == model.numClasses
            and model.numClasses * model.numFeatures <= MOST_WEIGHTS
            and bool(np.isfinite(model.interceptVector.toArray()).all()))


def _add_scores(df: DataFrame, model: Model, node: Node, out: str) -> DataFrame:
    """Scores of one node for every row, padded to the node's class count."""
    if isinstance(model, GaussianBayesModel):
        return df.withColumn(out, model.scores(component_values(df)))
    if _is_plain(model):
        weights = model.coefficientMatrix.toArray()
        scores = linear_scores(component_values(df), weights.tolist(),
                               model.interceptVector.toArray().tolist())
        if model.numClasses < node.width:
            scores = pad_scores(scores, node.width)
        return df.withColumn(out, scores)
    output, logits = _logits(model)
    model = model.copy()
    model.setFeaturesCol(FEATURES).setPredictionCol("")
    model.setRawPredictionCol(RAW if output == "raw" else "")
    model.setProbabilityCol(RAW if output == "probability" else "")
    if model.numClasses < node.width:
        logits = pad_scores(logits, node.width)
    return model.transform(df).withColumn(out, logits).drop(RAW)


def score_node(df: DataFrame, models: Mapping[str, Model], key: int | str,
               out: str | None = None) -> DataFrame:
    """Add one node's score array; an unknown or unfitted node is an error."""
    node = node_of(key)
    if node.name not in models:
        raise ValueError(f"node {node.name!r} has no model")
    vectors = with_feature_vector(df)
    return _add_scores(vectors, models[node.name], node, out or score_column(node)).drop(FEATURES)


def score_side_by_side(df: DataFrame, models: Sequence[Model], key: int | str,
                       prefix: str) -> tuple[DataFrame, list[str]]:
    """The score arrays of several models of one node, as one column each."""
    node, scored, columns = node_of(key), with_feature_vector(df), []
    for i, model in enumerate(models):
        columns.append(f"{prefix}{i}")
        scored = _add_scores(scored, model, node, columns[-1])
    return scored.drop(FEATURES), columns


def score_all(df: DataFrame, models: Mapping[str, Model]) -> tuple[DataFrame, dict[str, str]]:
    """Add the score array of every fitted node; also say which column is whose."""
    scored, columns = with_feature_vector(df), {}
    for node in NODES:
        if node.name in models:
            columns[node.name] = score_column(node)
            scored = _add_scores(scored, models[node.name], node, columns[node.name])
    return scored.drop(FEATURES), columns


def predict(df: DataFrame, models: Mapping[str, Model], key: int | str,
            with_probs: bool = False, keep: Iterable[str] = ()) -> DataFrame:
    """One node on the rows its level applies to: ``y_true``, ``y_pred`` and ``probs``."""
    node = node_of(key)
    rows = df.filter(F.col(node.label_column) >= 0)
    scored = score_node(rows, models, key, "__scores")
    columns = [F.col(node.label_column).alias("y_true"),
               argmax(F.col("__scores")).alias("y_pred")]
    if with_probs:
        columns.append(softmax(F.col("__scores"), node.width).alias("probs"))
    return scored.select(*[quoted(c) for c in keep], *columns)


def cascade_rows(df: DataFrame, models: Mapping[str, Model],
                 flat_probs: bool = False) -> DataFrame:
    """Score every node and route: the node records and ``flat_pred`` on each row."""
    scored, columns = score_all(df, models)
    return cascade(scored, columns, flat_probs)


def predict_hierarchical(df: DataFrame, models: Mapping[str, Model],
                         target: str = "leaf", keep: Iterable[str] = ()) -> DataFrame:
    """One wide row per input: components, target, all node predictions, flat prediction."""
    carried = [*keep, *component_columns(df), target]
    return prediction_columns(cascade_rows(df, models), carried)
