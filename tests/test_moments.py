import numpy as np
import pytest
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import functions as F

from flowcascade.operators import features as P
from flowcascade.operators import moments as M


def frame(spark, rows, partitions=5):
    width = len(rows[0])
    schema = ", ".join(f"`x.{i}` double" for i in range(width))
    data = [tuple(None if v is None else float(v) for v in r) for r in rows]
    return spark.createDataFrame(data, schema).repartition(partitions)


@pytest.mark.parametrize("partitions", [1, 3, 20])
def test_moments_equal_numpy(spark, partitions):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(400, 4)) * [1, 1e4, 1e-3, 0] + [1e6, 0, 5, 7]
    df = frame(spark, rows.tolist(), partitions)
    found = M.table_moments(df, df.columns)
    assert (found.n, found.missing) == (400, 0)
    np.testing.assert_array_equal(found.low, rows.min(0))
    np.testing.assert_array_equal(found.high, rows.max(0))
    np.testing.assert_allclose(found.mean, rows.mean(0), rtol=1e-10)
    want = np.cov(rows.T)
    scale = np.sqrt(np.outer(np.diag(want), np.diag(want))) + 1e-300
    assert (np.abs(found.covariance - want) <= 1e-9 * scale + 1e-12).all()


def test_missing_rows_are_counted_and_refused(spark):
    df = frame(spark, [[1, 2], [None, 3], [float("nan"), 1], [4, 5]])
    found = M.table_moments(df, df.columns)
    assert (found.n, found.missing) == (2, 2)
    with pytest.raises(ValueError, match="2 rows miss features"):
        P.fit_features(df, components=1)
    with pytest.raises(ValueError, match="without rows that have all features"):
        P.fit_features(df.filter("isnan(`x.0`)"), components=1)


def test_infinite_values_and_empty_tables(spark):
    df = frame(spark, [[1, 2], [float("inf"), 3]])
    with pytest.raises(ValueError, match="infinite"):
        P.fit_features(df, components=1)
    empty = M.table_moments(df.limit(0), df.columns)
    assert (empty.n, empty.missing) == (0, 0)
    with pytest.raises(ValueError, match="without rows"):
        P.fit_features(df.limit(0), components=1)


def test_few_rows_have_the_covariance():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(3, 5))
    for cov in (a.T @ a, np.diag([4.0, 0.0]), np.array([[2.5]])):
        rows = M.moment_rows(cov)
        assert len(rows) == 2 * len(cov)
        np.testing.assert_allclose(rows.mean(0), 0, atol=1e-12)
        np.testing.assert_allclose(np.atleast_2d(np.cov(rows.T)), cov, atol=1e-9)


def test_components_equal_those_of_the_whole_table(spark):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * [1, 10, 100, 1, 1, 5] + 50
    df = frame(spark, rows.tolist()).withColumnsRenamed({f"x.{i}": f"f{i}" for i in range(6)})
    state = P.fit_features(df, components=4)
    scaled = P.minmax_apply(df, state.ranges)
    ready = VectorAssembler(inputCols=scaled.columns, outputCol="v").transform(scaled)
    want = PCA(k=4, inputCol="v", outputCol="o").fit(ready)
    np.testing.assert_allclose(state.explained, want.explainedVariance.toArray(), rtol=1e-9)
    got = {(r["feature"], r["component"]): r["loading"]
           for r in P.loadings(state, spark).collect()}
    for j in range(4):
        axis = want.pc.toArray()[:, j]
        axis = axis * np.sign(axis[np.abs(axis).argmax()])
        np.testing.assert_allclose([got[c, j + 1] for c in state.order], axis, atol=1e-9)


def test_features_are_read_once_for_ranges_and_components(spark, monkeypatch):
    calls = []
    real = M.table_moments
    monkeypatch.setattr(P, "table_moments", lambda *a: calls.append(a) or real(*a))
    monkeypatch.setattr(P, "fit_ranges", lambda *a: pytest.fail("a second scan"))
    df = spark.range(50).select(F.col("id").cast("double").alias("a"),
                                (F.col("id") % 7).cast("double").alias("b"))
    P.fit_features(df, components=2)
    assert len(calls) == 1
