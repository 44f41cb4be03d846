"""Train and evaluate: two flow CSVs in; models, state and reports out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from flowcascade.operators.cascade import cascade
from flowcascade.operators.evaluate import (
    end_to_end_report,
    evaluate_levels,
    level_report,
)
from flowcascade.operators.features import FeatureState
from flowcascade.operators.labels import stage_by_leaf
from flowcascade.plans.fit import (
    DEFAULT_CANDIDATES,
    DEFAULT_PATIENCE,
    Candidate,
    Cascade,
    fit_cascade,
    history_table,
)
from flowcascade.plans.prepare import level_datasets, prepare
from flowcascade.plans.scoring import score_all
from flowcascade.schema import DEFAULT_COMPONENTS, NODES
from flowcascade.session import discard_stage, restage
from flowcascade.sources.reports import write_report
from flowcascade.sources.state import save_models, save_state


@dataclass
class Outcome:
    state: FeatureState
    cascade: Cascade
    history: DataFrame
    levels: DataFrame
    reports: dict[str, DataFrame]


def train_and_evaluate(spark: SparkSession, train_path: str, valid_path: str, out_dir: str,
                       components: int = DEFAULT_COMPONENTS,
                       candidates: Sequence[Candidate] = DEFAULT_CANDIDATES,
                       patience: int = DEFAULT_PATIENCE, approx: bool = False) -> Outcome:
    """Prepare both inputs once, fit all nodes, evaluate, and save everything.

    Written below ``out_dir``: ``state``, ``models``, one report folder per node
    and ``end_to_end_report``.
    """
    train, state = prepare(spark, train_path, components=components, approx=approx)
    save_state(spark, state, f"{out_dir}/state")
    valid, _ = prepare(spark, valid_path, state)
    laid_out = stage_by_leaf(train, "train"), stage_by_leaf(valid, "valid")
    discard_stage(train)
    discard_stage(valid)
    train, valid = laid_out
    fitted = fit_cascade(level_datasets(train, valid, staged=False), candidates, patience)
    save_models(spark, fitted.models, f"{out_dir}/models")

    scored, columns = score_all(valid, fitted.models)
    scored = restage(scored.select("leaf", *[n.label_column for n in NODES], *columns.values()),
                     "scored")
    discard_stage(train)
    reports = {n.name: level_report(scored, columns, n) for n in NODES if n.name in columns}
    reports["end_to_end"] = end_to_end_report(cascade(scored, columns), "leaf")
    for node in NODES:
        if node.name in reports:
            write_report(reports[node.name], f"{out_dir}/level{node.level}_classification_report")
    write_report(reports["end_to_end"], f"{out_dir}/end_to_end_report")
    return Outcome(state, fitted, history_table(spark, fitted.history),
                   evaluate_levels(scored, columns), reports)
