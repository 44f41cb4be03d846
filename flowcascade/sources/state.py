"""Stores for the fitted feature state and for the node classifiers."""

from __future__ import annotations

import dataclasses
import importlib

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from flowcascade.operators.bayes import GaussianBayesModel
from flowcascade.operators.clean import Fence
from flowcascade.operators.features import FeatureState, Range
from flowcascade.schema import NODES
from flowcascade.sources.store import open_version, read_json, save_version, write_json

_PLAIN = ("categories", "order", "components", "explained", "label_map", "accounting")


def save_state(spark: SparkSession, state: FeatureState, path: str) -> None:
    """Write the projection and the small lists and numbers beside it, as one version."""
    plain = {name: getattr(state, name) for name in _PLAIN}
    plain["ranges"] = {c: dataclasses.astuple(r) for c, r in state.ranges.items()}
    plain["fences"] = {c: dataclasses.astuple(f) for c, f in state.fences.items()}

    def write(folder: str) -> None:
        state.projection.write().overwrite().save(f"{folder}/projection")
        write_json(spark, plain, f"{folder}/state.json")

    save_version(spark, path, write)


def load_state(spark: SparkSession, path: str) -> FeatureState:
    """Read the newest saved state; a missing or foreign part is an error."""
    folder, _ = open_version(spark, path)
    plain = read_json(spark, f"{folder}/state.json")
    return FeatureState(
        **{name: plain[name] for name in _PLAIN},
        ranges={c: Range(*r) for c, r in plain["ranges"].items()},
        fences={c: Fence(*f) for c, f in plain["fences"].items()},
        projection=PipelineModel.load(f"{folder}/projection"),
    )


def save_models(spark: SparkSession, models: dict, path: str) -> None:
    """One folder per fitted node and the kinds of them, as one version."""
    def write(folder: str) -> dict:
        kinds = {}
        for name, model in models.items():
            kind = type(model)
            kinds[name] = f"{kind.__module__}.{kind.__name__}"
            if isinstance(model, GaussianBayesModel):
                write_json(spark, model.as_dict(), f"{folder}/{name}")
            else:
                model.write().overwrite().save(f"{folder}/{name}")
        write_json(spark, kinds, f"{folder}/models.json")
        return kinds

    save_version(spark, path, write)


def load_models(spark: SparkSession, path: str) -> dict:
    """Fitted nodes of the newest version by name, in node order."""
    folder, kinds = open_version(spark, path)
    models = {}
    for node in NODES:
        if node.name not in kinds:
            continue
        module, _, kind = kinds[node.name].rpartition(".")
        if kind == GaussianBayesModel.__name__:
            models[node.name] = GaussianBayesModel(**read_json(spark, f"{folder}/{node.name}"))
            continue
        if not module.startswith("pyspark.ml"):
            raise ValueError(f"not a Spark ML model class: {kinds[node.name]}")
        models[node.name] = getattr(importlib.import_module(module), kind).load(
            f"{folder}/{node.name}")
    return models
