"""Count, extent, mean and co-moments of many columns from one scan.

Every partition keeps one matrix of columns x columns and joins its batches into it; the
partitions' matrices are joined a few at a time.  Co-moments are always around the mean of
the rows they were taken from, so large means cost no digits.  Ranges, means and the
covariance of min-max scaled columns all follow from the result, because scaling is affine.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame

from flowcascade.functions import quoted
from flowcascade.states import join_states

# functions of this module travel to the executors by value, which need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE = ("id long, n long, missing long, low array<double>, high array<double>, "
         "mean array<double>, together array<double>")


@dataclass
class TableMoments:
    """Of the rows that miss none of the columns; ``missing`` counts the others."""

    n: int
    missing: int
    low: np.ndarray
    high: np.ndarray
    mean: np.ndarray
    together: np.ndarray        # sums of products around the mean

    @property
    def covariance(self) -> np.ndarray:
        """Sample covariance; of one row, zero."""
        return self.together / max(self.n - 1, 1)

    def join(self, other: "TableMoments") -> "TableMoments":
        n, missing = self.n + other.n, self.missing + other.missing
        if not self.n or not other.n:
            some = self if self.n else other
            return TableMoments(n, missing, some.low, some.high, some.mean, some.together)
        off = other.mean - self.mean
        return TableMoments(
            n, missing, np.minimum(self.low, other.low), np.maximum(self.high, other.high),
            self.mean + off * (other.n / n),
            self.together + other.together + np.outer(off, off) * (self.n * other.n / n))

    def as_row(self) -> dict:
        return {"n": self.n, "missing": self.missing, "low": self.low.tolist(),
                "high": self.high.tolist(), "mean": self.mean.tolist(),
                "together": self.together.ravel().tolist()}


def of_rows(rows: np.ndarray) -> TableMoments:
    whole = ~np.isnan(rows).any(axis=1)
    kept, width = rows[whole], rows.shape[1]
    missing = len(rows) - len(kept)
    if not len(kept):
        zero = np.zeros(width)
        return TableMoments(0, missing, zero, zero, zero, np.zeros((width, width)))
    with np.errstate(invalid="ignore", over="ignore"):      # infinite values are told later
        mean = kept.mean(axis=0)
        centred = kept - mean
        return TableMoments(len(kept), missing, kept.min(axis=0), kept.max(axis=0), mean,
                            centred.T @ centred)


def _of_state(row: dict) -> TableMoments:
    width = len(row["mean"])
    return TableMoments(row["n"], row["missing"], np.array(row["low"]), np.array(row["high"]),
                        np.array(row["mean"]), np.array(row["together"]).reshape(width, width))


def table_moments(df: DataFrame, cols: list[str]) -> TableMoments:
    """Moments of ``cols``; nulls and NaN are missing values."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("missing", pa.int64()),
                        *[(c, pa.list_(pa.float64()))
                          for c in ("low", "high", "mean", "together")]])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = of_rows(np.column_stack(
                    [c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float))
                total = found if total is None else total.join(found)
        if total is not None:
            yield pa.RecordBatch.from_pylist(
                [total.as_row() | {"id": TaskContext.get().partitionId()}], schema=schema)

    def join(rows: list[dict]) -> dict:
        total = _of_state(rows[0])
        for row in rows[1:]:
            total = total.join(_of_state(row))
        return total.as_row()

    data = df.select(*[quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    row = join_states(data.mapInArrow(collect, STATE), "moments", join)
    return of_rows(np.empty((0, len(cols)))) if row is None else _of_state(row.asDict())


def moment_rows(covariance: np.ndarray) -> np.ndarray:
    """Twice as many rows as columns with mean zero and this sample covariance."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    half = vectors * np.sqrt(np.maximum(values, 0.0)) * np.sqrt(len(values) - 0.5)
    return np.vstack([half.T, -half.T])
