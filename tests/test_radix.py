import numpy as np
import pytest
from pyspark.sql import functions as F

from flowcascade.operators import radix as R
from flowcascade.operators.clean import iqr_fences

EDGES = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308,
         float("inf"), float("-inf"), 1 + 2 ** -52, 1e-300, -1e300]


def test_codes_sort_as_numbers_and_come_back():
    rng = np.random.default_rng(1)
    values = np.concatenate([EDGES, rng.normal(size=500), rng.normal(size=500) * 1e200])
    codes = R.codes_of(values)
    order = np.argsort(codes, kind="stable")
    assert (np.diff(values[order]) >= 0).all()
    np.testing.assert_array_equal(R.values_of(codes), values)
    assert len(set(R.codes_of(np.array([0.0, -0.0])))) == 1


def frame(spark, columns, partitions=5):
    names = list(columns)
    rows = [tuple(None if v is None else float(v) for v in r) for r in zip(*columns.values())]
    schema = ", ".join(f"`{n}` double" for n in names)
    return spark.createDataFrame(rows, schema).repartition(partitions)


@pytest.mark.parametrize("n", [1, 2, 3, 1000])
@pytest.mark.parametrize("partitions", [1, 7])
def test_equal_numpy(spark, n, partitions):
    rng = np.random.default_rng(n)
    columns = {
        "normal": rng.normal(size=n), "ties": rng.integers(0, 3, n), "flat": np.full(n, 7.5),
        "half.zero": np.where(rng.random(n) < 0.5, 0.0, rng.normal(size=n)),
        "close": 1 + rng.integers(0, 5, n) * 2.0 ** -52, "wide": rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n),
    }
    shares = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = R.radix_quantiles(frame(spark, columns, partitions), list(columns), shares)
    for c, v in columns.items():
        np.testing.assert_array_equal(got[c], np.quantile(v.astype(float), shares), err_msg=c)


def test_missing_values_and_empty_columns(spark):
    df = frame(spark, {"a": [1, None, float("nan"), 3], "b": [None] * 4, "c": [float("inf")] * 4})
    assert R.radix_quantiles(df, ["a", "b"], [0.5, 1.0]) == {"a": [2.0, 3.0], "b": [None, None]}
    assert R.radix_quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}
    assert R.radix_quantiles(df, [], [0.5]) == {}


def test_more_columns_than_one_round(spark, monkeypatch):
    monkeypatch.setattr(R, "COLUMNS_AT_ONCE", 3)
    columns = {f"c{i}": np.arange(20) * (i + 1.0) for i in range(8)}
    got = R.radix_quantiles(frame(spark, columns), list(columns), [0.25])
    assert got == {f"c{i}": [4.75 * (i + 1)] for i in range(8)}


def test_integer_columns_have_fences(spark):
    df = spark.range(101).select(F.col("id").alias("n"), F.lit("x").alias("Label"))
    fence = iqr_fences(df)["n"]
    assert (fence.q1, fence.q3, fence.lower, fence.upper) == (25.0, 75.0, -125.0, 225.0)
