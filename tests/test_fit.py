import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.sql import functions as F

from flowcascade.operators.labels import hierarchical_labels
from flowcascade.plans import fit as T
from flowcascade.plans import scoring as S
from flowcascade.plans.prepare import level_datasets, prepare
from flowcascade.plans.train import train_and_evaluate
from flowcascade.schema import BASE_FEATURES, LEAVES, node_of
from flowcascade.sources import load_models, load_state, save_models


def make(spark, leaves, n=240, seed=0):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(9).normal(size=(13, 6)) * 4
    picked = [str(x) for x in rng.choice(leaves, n)]
    points = centres[[LEAVES.index(x) for x in picked]] + rng.normal(size=(n, 6)) * 0.5
    frame = pd.DataFrame(points, columns=[f"pca_component_{i + 1}" for i in range(6)])
    frame["leaf"] = picked
    return hierarchical_labels(spark.createDataFrame(frame), "leaf").cache()


@pytest.fixture(scope="module")
def train(spark):
    return make(spark, LEAVES)


def test_logits_match_the_model(train):
    model = T.fit_node(train, 1, (0.01, 10))
    scored = S.score_node(train, {"1": model}, "1", "s")
    ready = S.with_feature_vector(train)
    model.setFeaturesCol(S.FEATURES)
    want = [r["probability"].toArray() for r in model.transform(ready).collect()]
    from flowcascade.functions import softmax
    got = [r["p"] for r in scored.select(softmax(F.col("s"), 3).alias("p")).collect()]
    np.testing.assert_allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("make_estimator", [
    lambda: LogisticRegression(family="binomial", maxIter=10),
    lambda: RandomForestClassifier(numTrees=3, seed=1),
    lambda: MultilayerPerceptronClassifier(layers=[6, 4, 2], maxIter=20, seed=1),
])
def test_any_classifier_can_be_a_node(train, make_estimator):
    model = T.fit_node(train, "2_protocol", make_estimator())
    rows = S.predict(train, {"2_protocol": model}, "2_protocol", with_probs=True).collect()
    assert rows and all(sum(r["probs"]) == pytest.approx(1.0) for r in rows)
    hits = np.mean([r["y_true"] == r["y_pred"] for r in rows])
    assert hits > 0.9


def test_node_with_one_class_is_padded(spark):
    for leaf, code in (("Syn", 0), ("UDP-lag", 1)):
        rows = make(spark, [leaf], 30)
        model = T.fit_node(rows, 5, (0.01, 5))
        got = S.predict(rows, {"3_generic_dos": model}, 5, with_probs=True).collect()
        assert {r["y_pred"] for r in got} == {code}
        assert all(len(r["probs"]) == 2 and r["probs"][code] == pytest.approx(1.0) for r in got)


def test_unknown_and_unfitted_nodes(train):
    with pytest.raises(ValueError, match="unknown node"):
        S.score_node(train, {}, "x")
    with pytest.raises(ValueError, match="no model"):
        S.score_node(train, {}, 1)


def test_selection_keeps_the_lowest_loss_and_stops(train):
    node = node_of(1)
    tries = [(10.0, 5), (0.001, 20), (50.0, 5), (60.0, 5), (0.0001, 50)]
    chosen = T.select_model(train, train, 1, tries, patience=2)
    assert [r.round for r in chosen.history] == [1, 2, 3, 4]
    assert chosen.best_round == 2
    assert chosen.best_loss == min(r.val_loss for r in chosen.history)
    assert T.node_quality(train, chosen.model, node)[1] == pytest.approx(chosen.best_loss)
    same = T.select_model(train, train, 1, [(0.1, 5), (0.1, 5)], patience=5)
    assert same.best_round == 1     # equal is not better


def test_selection_without_validation_rows_uses_the_training_loss(train):
    tries = [(1.0, 1), (0.001, 20)]
    chosen = T.select_model(train, train.limit(0), 1, tries)
    assert chosen.best_round == 2
    assert [(r.val_loss, r.val_acc) for r in chosen.history] == [(None, None)] * 2
    history = T.history_table(train.sparkSession, chosen.history)
    assert history.filter("val_loss is null and train_loss > 0").count() == 2


def test_cascade_skips_missing_nodes(spark, tmp_path):
    rows = make(spark, ["BENIGN", "Syn", "UDP-lag", "DNS"], 200)
    sets = level_datasets(rows, rows)
    assert sorted(sets) == [1, 2, 4, 5]
    fitted = T.fit_cascade(sets, [(0.001, 20)])
    assert fitted.skipped == ["2_protocol"]
    out = S.predict_hierarchical(rows, fitted.models)
    assert out.filter("flat_pred >= 0").count() == 200
    save_models(spark, fitted.models, str(tmp_path / "m"))
    again = S.predict_hierarchical(rows, load_models(spark, str(tmp_path / "m")))
    assert sorted(out.collect()) == sorted(again.collect())
    history = T.history_table(spark, fitted.history)
    assert history.count() == 4 and history.filter("level = 3").count() == 0


def flow_csv(path, n, seed, leaves=LEAVES):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(8).normal(size=(13, len(BASE_FEATURES))) * 3
    index = rng.integers(0, len(leaves), n)
    codes = np.array([LEAVES.index(leaves[i]) for i in index])
    frame = pd.DataFrame(centres[codes] + rng.normal(size=(n, len(BASE_FEATURES))),
                         columns=[f" {c}" for c in BASE_FEATURES])
    frame[" Protocol"] = np.array([0, 6, 17])[codes % 3]
    frame[" Timestamp"] = "2018-11-03"
    frame["Flow ID"] = "x"
    frame[" Label"] = [LEAVES[c] for c in codes]
    frame.to_csv(path, index=False)
    return str(path)


def test_train_and_evaluate_round_trip(spark, tmp_path):
    train_path = flow_csv(tmp_path / "train.csv", 600, 1)
    valid_path = flow_csv(tmp_path / "valid.csv", 300, 2)
    out = train_and_evaluate(spark, train_path, valid_path, str(tmp_path / "out"),
                             components=10, candidates=[(0.001, 20)])
    assert sorted(out.reports) == sorted([*out.cascade.models, "end_to_end"])
    report = {r["class"]: r for r in out.reports["end_to_end"].collect()}
    assert report["accuracy"]["f1"] > 0.9
    assert {r["level"] for r in out.levels.collect()} == {1, 2, 3, 4, 5}
    for level in range(1, 6):
        assert list((tmp_path / "out" / f"level{level}_classification_report").glob("*.csv"))
    state = load_state(spark, str(tmp_path / "out" / "state"))
    models = load_models(spark, str(tmp_path / "out" / "models"))
    rows, _ = prepare(spark, valid_path, state)
    scored = S.predict_hierarchical(rows, models)
    assert scored.count() == 300
    assert [c for c in scored.columns if c.startswith("pca")] == state.output_columns
    refit, _ = prepare(spark, valid_path, state, fences="refit")
    assert refit.count() == 300


def test_prepare_with_table_ids_and_unseen_label(spark, tmp_path):
    path = flow_csv(tmp_path / "t.csv", 200, 3, ["BENIGN", "Syn", "UDP"])
    frame = pd.read_csv(path).rename(columns=str.strip)
    frame["id"] = range(len(frame))
    df = spark.createDataFrame(frame.drop(columns=["Flow ID"]))
    first, state = prepare(spark, df, components=5, keep=["id"])
    assert first.columns[0] == "id" and first.count() == 200
    assert state.label_map == {"BENIGN": 0, "Syn": 1, "UDP": 2}
    other = df.withColumn("Label", F.lit("Portmap"))
    second, _ = prepare(spark, other, state, keep=["id"])
    assert {(r["label_code"], r["level1"]) for r in second.collect()} == {(-1, 2)}
    flat, _ = prepare(spark, df, state, hierarchical=False)
    assert "level1" not in flat.columns
    with pytest.raises(ValueError, match="no label column"):
        prepare(spark, df.drop("Label"), components=5)
    from_path, _ = prepare(spark, path, state, keep=["FlowID"])
    assert from_path.columns[0] == "FlowID" and from_path.count() == 200
    assert {r["FlowID"] for r in from_path.collect()} == {"x"}


def test_logistic_margins_are_written_out(train, capsys):
    for level, found in ((1, train), (2, train), (4, train.filter("leaf != 'UDP'"))):
        node = node_of(level)
        model = T.fit_node(found, level, (0.01, 10))
        scored = S.score_node(train, {node.name: model}, level, "s")
        scored.explain()
        assert "UDF" not in capsys.readouterr().out         # no vector is made per row
        model.setFeaturesCol(S.FEATURES)
        raw = S.with_feature_vector(scored)
        for r in model.transform(raw).select("s", "rawPrediction").collect():
            np.testing.assert_allclose(
                r["s"][:model.numClasses], r["rawPrediction"].toArray(), rtol=1e-12, atol=1e-12)
            assert len(r["s"]) == node.width


def test_one_table_is_measured_once(train, monkeypatch):
    measured = []
    plain = T.node_qualities
    monkeypatch.setattr(T, "node_qualities", lambda *a: measured.append(1) or plain(*a))
    first = T.select_model(train, train, 1, [(0.01, 5)])
    assert len(measured) == 1
    assert (first.history[0].train_loss, first.history[0].train_acc) == (
        first.history[0].val_loss, first.history[0].val_acc)
    T.select_model(train, train.filter("leaf != 'Syn'"), 1, [(0.01, 5)])
    assert len(measured) == 3
