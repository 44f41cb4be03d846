import numpy as np
import pytest
from pyspark.sql import functions as F

from flowcascade.operators import evaluate as E
from flowcascade.operators import roc as R
from flowcascade.operators.labels import hierarchical_labels
from flowcascade.schema import LEAVES, NODES

NAMES = ["a", "b", "c", "never"]


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(4)
    true = rng.integers(0, 3, 500)
    pred = np.where(rng.random(500) < 0.6, true, rng.integers(-1, 3, 500))
    rows = [(int(t), int(p)) for t, p in zip(true, pred)]
    return rows, spark.createDataFrame(rows, "t int, p int")


def test_log_loss_and_accuracy(spark):
    rows = [([1.0, 2.0, 0.5], 1), ([0.0, 0.0, 0.0], 2), ([800.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "s array<double>, y int")
    want = np.mean([np.log(np.exp(np.array(s) - max(s)).sum()) + max(s) - s[y] for s, y in rows])
    for width in (None, 3):
        got = E.log_loss(df, "s", "y", width).first()
        assert got["rows"] == 3 and got["loss"] == pytest.approx(want)
    assert tuple(E.log_loss(df.limit(0), "s", "y").first()) == (0, 0.0)
    both = spark.createDataFrame([(1, 1), (0, 1), (1, 1), (2, 2)], "t int, p int")
    assert tuple(E.accuracy(both, "t", "p").first()) == (4, 3, 75.0)
    assert tuple(E.accuracy(both.limit(0), "t", "p").first()) == (0, 0, 0.0)


def test_confusion(pairs):
    rows, df = pairs
    want = {k: rows.count(k) for k in set(rows)}
    got = {(r["y_true"], r["y_pred"]): r["n"] for r in E.confusion(df, "t", "p").collect()}
    assert got == want and sum(got.values()) == len(rows)
    for r in E.confusion_normalised(df, "t", "p").collect():
        total = sum(v for k, v in want.items() if k[0] == r["y_true"])
        assert r["share"] == pytest.approx(r["n"] / total)
    wide = E.confusion_matrix(df, "t", "p").collect()
    assert [r["y_true"] for r in wide] == [-1, 0, 1, 2]
    assert wide[0].asDict() == {"y_true": -1, "p_-1": 0, "p_0": 0, "p_1": 0, "p_2": 0}
    assert wide[2]["p_1"] == want[1, 1]
    norm = E.confusion_matrix(df, "t", "p", normalise=True).collect()
    assert norm[0]["p_0"] == 0.0 and sum(norm[1][1:]) == pytest.approx(1.0)
    assert E.confusion_matrix(df.limit(0), "t", "p").count() == 0


def test_confusion_keeps_unnamed_classes(spark):
    df = spark.createDataFrame([(0, 0), (2, 0), (0, 2), (1, 1)], "t int, p int")
    wide = [tuple(r) for r in E.confusion_matrix(df, "t", "p", [1, 0]).collect()]
    assert wide == [(1, 1, 0, 0), (0, 0, 1, 1), (2, 0, 1, 0)]
    norm = E.confusion_matrix(df, "t", "p", [0, 1], normalise=True).collect()
    assert norm[0]["p_0"] == pytest.approx(0.5) and norm[0]["p_2"] == pytest.approx(0.5)


def test_report(pairs):
    rows, df = pairs
    got = {r["class"]: r for r in E.classification_report(df, "t", "p", NAMES).collect()}
    t, p = np.array(rows).T
    scores = []
    for c, name in enumerate(NAMES):
        hit, predicted, true = ((t == c) & (p == c)).sum(), (p == c).sum(), (t == c).sum()
        precision = hit / predicted if predicted else 0.0
        recall = hit / true if true else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        scores.append((precision, recall, f1, float(true)))
        np.testing.assert_allclose(tuple(got[name])[1:], scores[-1])
    scores = np.array(scores)
    np.testing.assert_allclose(tuple(got["accuracy"])[1:], [(t == p).mean()] * 4)
    np.testing.assert_allclose(
        tuple(got["macro avg"])[1:], [*scores[:, :3].mean(axis=0), len(rows)])
    np.testing.assert_allclose(
        tuple(got["weighted avg"])[1:],
        [*(scores[:, :3] * scores[:, 3:]).sum(axis=0) / len(rows), len(rows)])
    assert E.classification_report(df.limit(0), "t", "p", NAMES).count() == 0


@pytest.fixture(scope="module")
def probabilities(spark):
    rng = np.random.default_rng(6)
    n = 700
    y = rng.integers(0, 3, n)
    scores = rng.dirichlet([1, 1, 1], n).round(2)
    scores[rng.random(n) < 0.35] = [0.2, 0.5, 0.3]      # one score holds a third of the rows
    rows = [(int(a), [float(v) for v in s], ) for a, s in zip(y, scores)]
    return y, scores, spark.createDataFrame(rows, "y int, p array<double>")


def curve(y, scores, c):
    points = [(np.inf, 0.0, 0.0)]
    pos, neg = (y == c).sum(), (y != c).sum()
    for t in sorted(set(scores[:, c]), reverse=True):
        above = scores[:, c] >= t
        points.append((t, (above & (y != c)).sum() / neg, (above & (y == c)).sum() / pos))
    return points


@pytest.mark.parametrize("ranges", [None, 1, 21])
def test_roc_and_auc_equal_brute_force(probabilities, ranges):
    y, scores, df = probabilities
    names = ["a", "b", "c"]
    full = R.roc_points(df, "y", "p", names, False, ranges).collect()
    short = R.roc_points(df, "y", "p", names, True, ranges).collect()
    areas = {r["class"]: r for r in R.auc(df, "y", "p", names, ranges).collect()}
    for c, name in enumerate(names):
        want = curve(y, scores, c)
        got = sorted(((r["threshold"], r["fpr"], r["tpr"]) for r in full if r["class"] == name),
                     reverse=True)
        np.testing.assert_allclose(got, want)
        x, h = np.array(want)[:, 1], np.array(want)[:, 2]
        steps = np.diff(np.array([x * (y != c).sum(), h * (y == c).sum()]).round(), axis=1)
        keep = [0, 1] + [i for i in range(2, len(want) - 1)
                         if (steps[:, i - 1] != steps[:, i]).any()] + [len(want) - 1]
        fewer = sorted(((r["threshold"], r["fpr"], r["tpr"]) for r in short if r["class"] == name),
                       reverse=True)
        np.testing.assert_allclose(fewer, np.array(want)[keep])
        assert areas[name]["auc"] == pytest.approx(np.trapezoid(h, x))


def test_roc_takes_one_hot_targets(probabilities):
    _, _, df = probabilities
    hot = df.withColumn("y", F.array(*[(F.col("y") == c).cast("int") for c in range(3)]))
    names = ["a", "b", "c"]
    assert sorted(R.auc(hot, "y", "p", names).collect()) == sorted(
        R.auc(df, "y", "p", names).collect())


def test_roc_of_one_sided_classes(spark):
    df = spark.createDataFrame([(0, [0.9, 0.1]), (0, [0.4, 0.6])], "y int, p array<double>")
    areas = R.auc(df, "y", "p", ["a", "b"]).collect()
    assert [r["auc"] for r in areas] == [None, None]
    points = R.roc_points(df, "y", "p", ["a", "b"]).collect()
    assert {r["fpr"] for r in points if r["class"] == "a"} == {None}
    assert {r["tpr"] for r in points if r["class"] == "b"} == {None}
    assert R.roc_points(df.limit(0), "y", "p", ["a", "b"]).count() == 0


def test_levels(spark):
    rng = np.random.default_rng(7)
    leaves = [str(x) for x in rng.choice([*LEAVES, "OTHER"], 200)]
    rows = [(leaf, *[rng.normal(size=n.width).tolist() for n in NODES]) for leaf in leaves]
    schema = "leaf string, " + ", ".join(f"s{n.level} array<double>" for n in NODES)
    df = hierarchical_labels(spark.createDataFrame(rows, schema), "leaf")
    columns = {n.name: f"s{n.level}" for n in NODES}
    table = {r["node"]: r for r in E.evaluate_levels(df, columns).collect()}
    long = E.level_pairs(df, columns).groupBy("node").agg(
        F.count("*").alias("rows"), F.avg("loss").alias("loss"),
        (100 * F.avg((F.col("y_true") == F.col("y_pred")).cast("int"))).alias("accuracy"))
    for r in long.collect():
        got = table[r["node"]]
        assert got["rows"] == r["rows"]
        assert got["loss"] == pytest.approx(r["loss"])
        assert got["accuracy"] == pytest.approx(r["accuracy"])
    assert E.level_report(df, columns, NODES[3]).count() == 8 + 3
    missing = E.evaluate_levels(df.filter("leaf = 'BENIGN'"), columns).collect()
    assert [tuple(r)[2:] for r in missing[1:]] == [(0, 0.0, 0.0)] * 4


def test_end_to_end_counts_unresolved_as_wrong(spark):
    df = spark.createDataFrame(
        [("Syn", 9), ("Syn", -1), ("UDP", 11), ("OTHER", 11)], "leaf string, flat_pred int")
    got = {r["class"]: r for r in E.end_to_end_report(df, "leaf").collect()}
    assert got["accuracy"]["recall"] == pytest.approx(2 / 3)
    assert got["Syn"]["recall"] == 0.5 and got["Syn"]["precision"] == 1.0
    assert got["UDP"]["precision"] == 1.0
