import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowcascade.operators import clean as K
from flowcascade.operators.quantiles import approx_quantiles, exact_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """Columns with ties holding half of all rows, infinities and huge gaps."""
    rng = np.random.default_rng(3)
    n = 4001
    frame = pd.DataFrame({
        "normal": rng.normal(size=n),
        "few": rng.integers(0, 4, n).astype(float),
        "zeros": np.where(rng.random(n) < 0.5, 0.0, rng.exponential(size=n)),
        "infinite": np.where(rng.random(n) < 0.4, np.inf, rng.normal(size=n)),
        "gap": np.where(rng.random(n) < 0.5, -1.0, 1e12),
        "Flow/s": np.full(n, 3.0),
    })
    return frame, spark.createDataFrame(frame).repartition(5)


@pytest.mark.parametrize("accuracy,sample_rows,gather_rows", [
    (10_000, 10_000, 100_000),
    (100, 10_000, 200), (10, 10_000, 3),
    (1000, 300, 50),                        # proposals from a (too) small sample
])
def test_quantiles_equal_numpy(skewed, accuracy, sample_rows, gather_rows):
    frame, df = skewed
    shares = [0.25, 0.75]
    with np.errstate(all="ignore"):
        want = {c: np.quantile(frame[c], shares) for c in frame}
    got = exact_quantiles(df, list(frame), shares, accuracy, sample_rows, gather_rows)
    for c in frame:
        np.testing.assert_array_equal(np.array(got[c]), want[c], err_msg=c)


def test_quantiles_ignore_missing_and_handle_nothing(spark):
    df = spark.createDataFrame(
        [(1.0, None), (math.nan, None), (None, None), (3.0, None)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [2.0], "b": [None]}
    assert exact_quantiles(df, [], [0.5]) == {}
    assert K.iqr_fences(df).keys() == {"a"}


def test_approximate_quantiles_are_close(skewed):
    frame, df = skewed
    got = approx_quantiles(df, ["normal"], [0.25, 0.75])["normal"]
    assert np.allclose(got, np.quantile(frame["normal"], [0.25, 0.75]), atol=0.01)


def test_dedup_unifies_missing_and_signed_zero(spark):
    df = spark.createDataFrame(
        [(math.nan, "a"), (None, "a"), (-0.0, "b"), (0.0, "b"), (math.inf, "c"), (math.inf, "c")],
        "x double, y string")
    assert K.dedup(df).count() == 3


def test_drop_missing_keeps_infinities(spark):
    df = spark.createDataFrame(
        [(math.inf, "a"), (-math.inf, "a"), (math.nan, "a"), (None, "a"), (1.0, None)],
        "x double, y string")
    assert sorted(r["x"] for r in K.drop_missing(df).collect()) == [-math.inf, math.inf]


def test_clean_report(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (None,), (math.nan,), (2.0,)], "x double")
    assert [tuple(r) for r in K.clean_report(df).collect()] == [
        ("input", 5, 0), ("dedup", 3, 2), ("drop_missing", 2, 1)]
    assert [r["rows"] for r in K.clean_report(df.limit(0)).collect()] == [0, 0, 0]


def test_impute_mode_smallest_on_ties(spark):
    df = spark.createDataFrame(
        [("b", None, "l"), ("a", None, None), ("a", None, "l"), ("b", None, "l"), (None, None, "l")],
        "t string, none string, Label string")
    rows = K.impute_mode(df).collect()
    assert [r["t"] for r in rows].count("a") == 3
    assert all(r["none"] is None for r in rows)
    assert [r["Label"] for r in rows].count(None) == 1


def test_zero_iqr_collapses_to_the_constant(spark):
    df = spark.createDataFrame([(1.0,)] * 7 + [(9.0,)], "x double")
    out = K.clip_to(df, K.iqr_fences(df))
    assert {r["x"] for r in out.collect()} == {1.0}


def test_nan_fence_is_no_limit_and_missing_passes(spark):
    df = spark.createDataFrame([(5.0,), (None,), (math.nan,), (-7.0,)], "x double")
    fence = K.Fence(0.0, 0.0, math.nan, 2.0)
    values = [r["x"] for r in K.clip_to(df, {"x": fence}).collect()]
    assert values[0] == 2.0 and values[1] is None and math.isnan(values[2]) and values[3] == -7.0
    both = K.Fence(0.0, 0.0, math.nan, math.nan)
    assert K.clip_to(df, {"x": both}).first()["x"] == 5.0


def test_infinite_quartile_gives_no_limit(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (math.inf,), (math.inf,), (math.inf,)], "x double")
    fence = K.iqr_fences(df)["x"]
    want = pd.Series([1.0, 2.0, math.inf, math.inf, math.inf])
    lower, upper = want.quantile(0.25), want.quantile(0.75)
    assert fence.q1 == lower or (math.isnan(fence.q1) and math.isnan(lower))
    assert math.isnan(upper) and math.isnan(fence.upper)


def test_clean_equals_pandas(spark):
    rng = np.random.default_rng(5)
    n = 500
    frame = pd.DataFrame({
        "Protocol": rng.choice([0.0, 6.0, 17.0], n), "a": rng.normal(size=n).round(1),
        "b": np.where(rng.random(n) < 0.05, 1e6, rng.normal(size=n).round(1)),
        "t": rng.choice(["x", "y"], n), "Label": rng.choice(["Syn", "UDP"], n)})
    frame.loc[rng.random(n) < 0.1, "a"] = np.nan
    frame.loc[rng.random(n) < 0.1, "t"] = None
    want = frame.drop_duplicates().dropna()
    for c in ("Protocol", "a", "b"):
        q1, q3 = want[c].quantile(0.25), want[c].quantile(0.75)
        want[c] = want[c].clip(q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1))
    for staged in (True, False):
        got, fences = K.clean(spark.createDataFrame(frame), staged=staged)
        assert sorted(map(tuple, got.collect())) == sorted(want.itertuples(index=False, name=None))
        assert set(fences) == {"Protocol", "a", "b"}
    kept, _ = K.clean(spark.createDataFrame(frame), exclude=["Protocol"])
    assert kept.agg(F.max("Protocol")).first()[0] == 17.0


def test_coerce_and_zero(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("-inf",), ("nan",)], "v string")
    numbers = [r["v"] for r in K.coerce_numeric(df, ["v"]).collect()]
    assert numbers[:3] == [1.5, None, None] and numbers[3] == -math.inf
    zeros = K.zero_nonfinite(K.coerce_numeric(df, ["v"]), ["v"])
    assert [r["v"] for r in zeros.collect()] == [1.5, 0.0, 0.0, 0.0, 0.0]


def test_empty_input_keeps_its_schema(spark):
    df = spark.createDataFrame([], "x double, Label string")
    out, fences = K.clean(df)
    assert out.columns == df.columns and out.count() == 0 and fences == {}
