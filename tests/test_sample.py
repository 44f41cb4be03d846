import hashlib

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from flowcascade.operators import sample as M
from flowcascade.operators.labels import hierarchical_labels
from flowcascade.plans import fit as T
from flowcascade.plans import scoring as S

ROWS = [(i, "ab"[i % 3 == 0], float(i)) for i in range(300)] + [(900 + i, "c", 1.0) for i in range(4)]


def table(spark, partitions):
    return spark.createDataFrame(ROWS, "id long, kind string, x double").repartition(partitions)


def test_same_sample_for_any_partitioning(spark):
    def rank(i):
        return int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)
    want = set()
    for kind in "abc":
        own = sorted((i for i, k, _ in ROWS if k == kind), key=rank)[:20]
        want |= {(i, kind) for i in own}
    for partitions in (1, 4, 13):
        got = M.priority_sample(table(spark, partitions), "kind", 20, key=["id"]).collect()
        assert {(r["id"], r["kind"]) for r in got} == want
        weights = {}
        for r in got:
            weights[r["kind"]] = weights.get(r["kind"], 0) + r["weight"]
        assert weights == pytest.approx({"a": 200, "b": 100, "c": 4})


def test_equal_rows_share_a_weight(spark):
    rows = [(1.0, "a")] * 500 + [(float(i), "a") for i in range(2, 302)]
    df = spark.createDataFrame(rows, "x double, kind string").repartition(6)
    for bound in (5, 50, 700):
        got = M.priority_sample(df, "kind", bound).collect()
        assert len(got) == len({r["x"] for r in got}) <= min(bound, 301)
        assert sum(r["weight"] for r in got) == pytest.approx(800)


def test_frequent_keys_that_come_late(spark):
    # most rows have one key; whether its hash is small or large, enough rows are found
    for late in range(8):
        rows = [(late, "a", float(i)) for i in range(900)] + [(100 + i, "a", 0.0) for i in range(60)]
        df = spark.createDataFrame(rows, "id long, kind string, x double")
        got = M.priority_sample(df, "kind", 40, key=["id"]).collect()
        assert sum(r["weight"] for r in got) == pytest.approx(960) and len(got) == 40


def test_small_and_empty_tables(spark):
    df = table(spark, 2)
    everything = M.priority_sample(df, "kind", 10_000).collect()
    assert len(everything) == len(ROWS) and {r["weight"] for r in everything} == {1.0}
    assert M.priority_sample(df.limit(0), "kind", 5).collect() == []
    nothing = M.priority_sample(df.withColumn("kind", F.lit(None).cast("string")), "kind", 5)
    assert nothing.collect() == []
    with pytest.raises(ValueError, match="at least one row"):
        M.priority_sample(df, "kind", 0)


def learnable(spark, n):
    rng = np.random.default_rng(0)
    codes = (rng.random(n) < 0.1).astype(int)
    points = rng.normal(size=(n, 2)) + codes[:, None] * 3
    rows = [(["Syn", "UDP-lag"][c], *map(float, p)) for c, p in zip(codes, points)]
    df = spark.createDataFrame(rows, "leaf string, pca_component_1 double, pca_component_2 double")
    return hierarchical_labels(df, "leaf")


def test_fitting_on_a_sample(spark):
    rows = learnable(spark, 4000)
    whole = T.fit_node(rows, 5, (0.01, 50))
    some = T.fit_node(rows, 5, (0.01, 50), max_fit_rows=300)
    again = T.fit_node(rows.repartition(9), 5, (0.01, 50), max_fit_rows=300)
    np.testing.assert_allclose(some.coefficientMatrix.toArray(), again.coefficientMatrix.toArray(),
                               rtol=1e-6)
    one = {r["y_pred"] for r in S.predict(rows, {"3_generic_dos": some}, 5).collect()}
    assert one == {0, 1}
    share = [S.predict(rows, {"3_generic_dos": m}, 5).filter("y_true = y_pred").count() / 4000
             for m in (whole, some)]
    assert share[0] > 0.95 and abs(share[0] - share[1]) < 0.02
    estimator = LogisticRegression(maxIter=5)
    T.fit_node(rows, 5, estimator, max_fit_rows=100)
    assert not estimator.isSet("weightCol")         # the caller's estimator stays as it is
    with pytest.raises(ValueError, match="takes no weights"):
        T.fit_node(rows, 5, MultilayerPerceptronClassifier(layers=[2, 2]), max_fit_rows=100)
