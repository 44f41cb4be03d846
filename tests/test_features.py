import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowcascade.operators import features as P
from flowcascade.operators.clean import Fence
from flowcascade.sources import load_state, save_state


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    n = 300
    base = rng.normal(size=(n, 3)) @ np.array([[3, 0, 1], [0, 1, 1], [0, 0, 0.2]])
    frame = pd.DataFrame({
        "id": np.arange(n), "Protocol": rng.choice([0.0, 6.0, 17.0], n), "Flow/s": base[:, 0],
        "b": base[:, 1] * 50, "c": base[:, 2], "same": 5.0,
        "Timestamp": "t", "Label": rng.choice(["Syn", "UDP"], n)})
    return frame, spark.createDataFrame(frame)


def scaled(frame):
    x = frame[["Flow/s", "b", "c", "same"]].copy()
    for v in (0, 6, 17):
        x[f"Protocol_{v}"] = (frame["Protocol"] == v).astype(float)
    spread = (x.max() - x.min()).replace(0, 1)
    return ((x - x.min()) / spread).values


def test_one_hot_numeric_order_and_unseen(spark, table):
    _, df = table
    cats = P.fit_one_hot(df, "Protocol")
    assert cats == [0.0, 6.0, 17.0]
    out = P.one_hot(spark.createDataFrame([(6.0, 1), (99.0, 2), (None, 3)],
                                          "Protocol double, x int"), "Protocol", cats)
    assert out.columns == ["x", "Protocol_0", "Protocol_6", "Protocol_17"]
    assert [tuple(r) for r in out.collect()] == [(1, 0, 1, 0), (2, 0, 0, 0), (3, 0, 0, 0)]
    again = P.encode_categories(out, {"Protocol": cats})
    assert again.columns == out.columns


def test_min_max_constant_and_unclamped(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    ranges = P.fit_ranges(df, ["x", "k"])
    new = spark.createDataFrame([(5.0, 7.0)], "x double, k double")
    assert tuple(P.minmax_apply(df, ranges).first()) == (0.0, 0.0)
    assert tuple(P.minmax_apply(new, ranges).first()) == (2.0, 2.0)


def test_components_equal_a_direct_decomposition(table):
    frame, df = table
    state = P.fit_features(df, components=3, ignore=["id"])
    assert state.order == ["Flow/s", "b", "c", "same", "Protocol_0", "Protocol_6", "Protocol_17"]
    x = scaled(frame)
    x = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    signs = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])
    want = (x @ (vt.T * signs))[:, :3]
    out = P.apply_features(df, state, keep=["id", "Label"])
    assert out.columns == [*state.output_columns, "id", "Label"]
    got = out.toPandas().sort_values("id")
    np.testing.assert_allclose(got[state.output_columns].values, want, atol=1e-9)
    np.testing.assert_allclose(state.explained, (s ** 2 / (s ** 2).sum())[:3], atol=1e-9)
    shares = P.explained_variance(state, df).collect()
    assert [r["component"] for r in shares] == [1, 2, 3]
    assert shares[-1]["cumulative"] == pytest.approx(sum(state.explained))


def test_all_components_keep_all_variance(table):
    frame, df = table
    state = P.fit_features(df, components=7, ignore=["id"])
    assert sum(state.explained) == pytest.approx(1.0)
    out = P.apply_features(df, state, keep=[]).toPandas().values
    x = scaled(frame)
    assert (out ** 2).sum() == pytest.approx(((x - x.mean(axis=0)) ** 2).sum())


def test_errors(spark, table):
    _, df = table
    with pytest.raises(ValueError, match="components"):
        P.fit_features(df, components=9, ignore=["id"])
    with pytest.raises(ValueError, match="infinite"):
        P.fit_features(df.withColumn("b", F.lit(float("inf"))), components=2)
    with pytest.raises(ValueError, match="without rows"):
        P.fit_features(df.limit(0), components=2)
    state = P.fit_features(df, components=2, ignore=["id"])
    with pytest.raises(ValueError, match="missing feature"):
        P.apply_features(df.drop("b"), state)
    with pytest.raises(ValueError, match="to keep"):
        P.apply_features(df, state, keep=["nope"])


def test_non_finite_input_becomes_zero_and_hook(table):
    _, df = table
    state = P.fit_features(df, components=2, ignore=["id"])
    bad = df.withColumn("b", F.lit(float("nan")))
    assert set(P.apply_features(bad, state, keep=[]).toPandas().values.ravel()) == {0.0}
    plain = P.apply_features(df, state, keep=["id"]).toPandas().sort_values("id")
    hooked = P.apply_features(df, state, keep=["id"],
                              transform=lambda c: F.transform(c, lambda x: x * 2))
    doubled = hooked.toPandas().sort_values("id")
    np.testing.assert_allclose(doubled["pca_component_2"], plain["pca_component_2"] * 2)
    sample = P.apply_features(df, state, keep=["id"], as_array=True)
    assert dict(sample.dtypes)["features"] == "array<float>"
    assert sample.select(F.size("features")).first()[0] == 2


def test_state_round_trip(spark, table, tmp_path):
    _, df = table
    state = P.fit_features(df, components=2, ignore=["id"])
    state.fences = {"b": Fence(1.0, 2.0, float("nan"), float("inf"))}
    state.label_map = {"Syn": 0, "UDP": 1}
    save_state(spark, state, str(tmp_path / "state"))
    back = load_state(spark, str(tmp_path / "state"))
    assert (back.order, back.ranges, back.label_map, back.categories) == (
        state.order, state.ranges, state.label_map, state.categories)
    assert np.isnan(back.fences["b"].lower) and back.fences["b"].upper == float("inf")
    a = P.apply_features(df, state, keep=["id"]).orderBy("id").collect()
    assert a == P.apply_features(df, back, keep=["id"]).orderBy("id").collect()
    with pytest.raises(RuntimeError, match="incomplete"):
        load_state(spark, str(tmp_path / "nothing"))


def test_fitted_features_apply_to_a_stream(spark, table, tmp_path):
    _, df = table
    state = P.fit_features(df, components=2, ignore=["id"])
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = P.apply_features(stream, state, keep=["id"])
    assert out.isStreaming
    run = out.writeStream.format("memory").queryName("applied").start()
    run.processAllAvailable()
    run.stop()
    batch = P.apply_features(df, state, keep=["id"]).orderBy("id").collect()
    assert spark.table("applied").orderBy("id").collect() == batch
