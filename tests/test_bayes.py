import contextlib
import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowcascade.operators import bayes as B
from flowcascade.operators.labels import (
    LEAF_FOLDER,
    hierarchical_labels,
    present_level_ids,
    select_level,
    stage_by_leaf,
)
from flowcascade.plans import fit as T
from flowcascade.plans import scoring as S
from flowcascade.plans.prepare import level_datasets
from flowcascade.schema import LEAVES, NODES, leaves_of_node, node_of
from flowcascade.sources import load_models, save_models


def make(spark, leaves, n=600, seed=0, width=4):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(3).normal(size=(len(LEAVES) + 1, width)) * 3
    spreads = np.random.default_rng(4).uniform(0.3, 1.5, size=(len(LEAVES) + 1, width))
    names = [*LEAVES, "STRANGE"]
    picked = [names.index(str(x)) for x in rng.choice(leaves, n)]
    points = (centres[picked] + rng.normal(size=(n, width)) * spreads[picked]).astype("f4")
    rows = [(names[k], *map(float, p)) for k, p in zip(picked, points)]
    columns = [f"pca_component_{i + 1} double" for i in range(width)]
    df = spark.createDataFrame(rows, "leaf string, " + ", ".join(columns))
    return hierarchical_labels(df, "leaf")


def plain_scores(points, codes, width, smoothing):
    """Log prior and density per class, computed row by row."""
    added = smoothing * points.var(axis=0).max()
    found = np.full((len(points), width), B.ABSENT)
    for c in range(width):
        own = points[codes == c]
        if len(own):
            v = own.var(axis=0) + added
            found[:, c] = math.log(len(own) / len(points)) - 0.5 * (
                np.log(2 * np.pi * v) + (points - own.mean(axis=0)) ** 2 / v).sum(axis=1)
    return found


@pytest.mark.parametrize("smoothing", [1e-9, 0.1])
def test_scores_equal_the_plain_formula(spark, smoothing):
    rows = make(spark, [*LEAVES, "STRANGE"])
    frame = rows.toPandas()
    for node in NODES:
        model = T.fit_node(rows, node.level, B.GaussianBayes(smoothing))
        own = frame[frame[node.label_column] >= 0]
        want = plain_scores(own[[c for c in frame if c.startswith("pca")]].to_numpy(),
                            own[node.label_column].to_numpy(), node.width, smoothing)
        scored = S.score_node(select_level(rows, node.level), {node.name: model}, node.name, "s")
        got = {tuple(r[1:5]): r["s"] for r in scored.collect()}
        for point, scores in zip(own[[c for c in frame if c.startswith("pca")]].to_numpy(), want):
            np.testing.assert_allclose(got[tuple(point)], scores, rtol=1e-9, atol=1e-9)


def test_one_scan_fits_the_same_nodes(spark):
    rows = make(spark, LEAVES)
    together = T.fit_bayes(rows).models
    assert list(together) == [n.name for n in NODES]
    for node in NODES:
        alone = T.fit_node(rows, node.level, B.GaussianBayes())
        for a, b in zip(together[node.name].means, alone.means):
            np.testing.assert_allclose(a, b)
        for a, b in zip(together[node.name].variances, alone.variances):
            np.testing.assert_allclose(a, b)


def test_moments_join_in_any_order():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(50, 3)) * [1, 100, 1e-3] + [0, 1e6, 5]
    parts = [B.Moments(len(p), tuple(p.mean(0)), tuple(p.var(0)))
             for p in (rows[:3], rows[3:4], rows[4:])]
    for order in ((0, 1, 2), (2, 0, 1), (1, 2, 0)):
        total = B.joined(parts[i] for i in order)
        assert total.n == 50
        np.testing.assert_allclose(total.means, rows.mean(0))
        np.testing.assert_allclose(total.variances, rows.var(0))
    assert B.joined([]) is None


def test_absent_classes_and_flat_features(spark):
    rows = make(spark, ["Syn"], 30).withColumn("pca_component_2", F.lit(1.0))
    model = T.fit_node(rows, 5, B.GaussianBayes())
    got = S.predict(rows, {"3_generic_dos": model}, 5, with_probs=True).collect()
    assert {r["y_pred"] for r in got} == {0}
    assert all(r["probs"] == [1.0, 0.0] for r in got)
    with pytest.raises(ValueError, match="without rows"):
        T.fit_node(rows, "2_protocol", B.GaussianBayes())
    assert T.fit_bayes(rows).skipped == ["2_protocol", "3_drdos"]


def test_saved_and_loaded(spark, tmp_path):
    rows = make(spark, [*LEAVES, "STRANGE"])
    fitted = T.fit_bayes(rows)
    save_models(spark, fitted.models, str(tmp_path / "m"))
    again = load_models(spark, str(tmp_path / "m"))
    assert again == fitted.models
    out = S.predict_hierarchical(rows, again)
    wrong = out.filter((F.col("leaf") != "STRANGE")
                       & (F.get(F.array(*map(F.lit, LEAVES)), "flat_pred") != F.col("leaf")))
    assert wrong.count() < 120


def test_mixed_kinds_in_one_cascade(spark, tmp_path):
    rows = make(spark, LEAVES, 300)
    models = T.fit_bayes(rows).models | {"1": T.fit_node(rows, 1, (0.01, 10))}
    save_models(spark, models, str(tmp_path / "m"))
    want = S.predict_hierarchical(rows, models).collect()
    assert sorted(S.predict_hierarchical(
        rows, load_models(spark, str(tmp_path / "m"))).collect()) == sorted(want)


def reads(df):
    """The plan as text."""
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def test_levels_read_only_their_leaf_folders(spark):
    rows = make(spark, [*LEAVES, "STRANGE"])
    counts = {r["leaf"]: r["count"] for r in rows.groupBy("leaf").count().collect()}
    table = stage_by_leaf(rows, "by-leaf")
    assert table.count() == 600
    assert {f.split(f"{LEAF_FOLDER}=")[1].split("/")[0] for f in table.inputFiles()} == {
        *LEAVES, "other"}
    assert present_level_ids(table) == [1, 2, 3, 4, 5]
    for node in NODES:
        level = select_level(table, node.level)
        plan = reads(level)
        filters = [x for x in plan.splitlines() if "PartitionFilters" in x]
        assert len(filters) == 1 and LEAF_FOLDER in filters[0], plan
        read = {r[0] for r in level.select(F.input_file_name()).distinct().collect()}
        folders = {f.split(f"{LEAF_FOLDER}=")[1].split("/")[0] for f in read}
        assert folders == set(leaves_of_node(node))
        assert level.count() == sum(counts[x] for x in leaves_of_node(node))
        assert level.filter(F.col(node.label_column) < 0).count() == 0


def test_selection_side_by_side(spark):
    train, valid = make(spark, LEAVES, seed=1), make(spark, LEAVES, 200, seed=2)
    tries = [B.GaussianBayes(s) for s in (3.0, 1.0, 0.3, 0.1, 0.01, 1e-9)]
    every = T.select_model(train, valid, 1, tries, patience=10)
    assert len(every.history) == 6
    losses = [r.val_loss for r in every.history]
    assert every.best_loss == min(losses) and every.best_round == losses.index(min(losses)) + 1
    for i, candidate in enumerate(tries):
        alone = T.select_model(train, valid, 1, [candidate]).history[0]
        assert alone.val_loss == pytest.approx(losses[i])
    worse = [tries[5], tries[0], tries[0], tries[5]]
    assert [r.round for r in T.select_model(train, valid, 1, worse, patience=2).history] == [1, 2, 3]


def test_one_aggregate_measures_any_number_of_candidates(spark):
    rows, node = make(spark, LEAVES, 200), node_of(1)
    models = T.fit_candidates(rows, 1, [B.GaussianBayes(s) for s in (0.1, 0.2, 0.3)])
    models.append(T.fit_node(rows, 1, (0.01, 5)))
    together = T.node_qualities(rows, models, node)
    assert together == [T.node_quality(rows, m, node) for m in models]


def test_datasets_are_laid_out_by_leaf(spark):
    sets = level_datasets(make(spark, ["BENIGN", "Syn"]), make(spark, ["BENIGN", "STRANGE"]))
    assert sorted(sets) == [1, 2, 5]
    assert sets[5][1].count() == 0 and sets[1][1].count() > 0
