"""Whitening of embeddings by an incremental eigendecomposition.

Entries are made whole numbers first, so that equal vectors, counts and sums are exact.
Every partition of the distinct vectors keeps a spectrum by centred rank-one updates; the
spectra are joined a few at a time, again by rank-one updates.  One more pass over the
vectors (Rayleigh-Ritz in the basis found) brings the components to double precision, and a
last one measures how far the whitened vectors are from unit covariance.

State is one matrix of width x width per partition; the driver gets one of them, and a task
at most ``JOINED``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from flowcascade.llm.common import named
from flowcascade.llm.spectrum import EPS, Spectrum
from flowcascade.session import discard_stage, stage

SCALE, SHIFT = 64, 1_000_000        # an entry c becomes floor(SCALE * c) + SHIFT
LIMIT = float(1 << 40)              # scaled entries beyond it are cut to it
COMPONENTS = 16
JOINED = 8                          # states joined by one task
BLOCK_ROWS = 1024                   # rows that are added to a spectrum at one time

STATE = ("id long, n long, sums array<long>, mean array<double>, eigenvalues array<double>, "
         "eigenvectors array<double>")
TOTAL = "id long, total array<double>"
WHITENED = ("vec_id long, component int, n long, deviation long, whitened double, "
            "explained double, identity_error double")


def whole_numbers(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """Every entry as ``floor(scale * entry) + shift``."""
    def one(c: Column) -> Column:
        scaled = F.least(F.greatest(c.cast("double") * scale, F.lit(-LIMIT)), F.lit(LIMIT))
        return F.floor(scaled) + F.lit(shift).cast("long")
    return F.transform(vector, one)


def usable(vector: Column) -> Column:
    """Not null, not empty, every entry a finite number."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
                      & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _join_states(states: DataFrame, schema: str, name: str,
                 join: Callable[[list[dict]], dict]) -> Row | None:
    """Join states a few at a time until one is left; the rows are written in between."""
    def joined(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["id"])
        return pa.Table.from_pylist([join(rows) | {"id": rows[0]["id"] // JOINED}],
                                    schema=table.schema)

    table = stage(states, name)
    while table.agg(F.count("*")).first()[0] > 1:
        group = F.floor(F.col("id") / JOINED).alias("group")
        fewer = stage(table.groupBy(group).applyInArrow(joined, schema), name)
        discard_stage(table)
        table = fewer
    row = table.first()
    discard_stage(table)
    return row


def _spectrum(row: dict) -> Spectrum:
    width = len(row["mean"])
    found = Spectrum(width)
    found.n, found.sums = row["n"], np.array(row["sums"], np.int64)
    found.mean, found.values = np.array(row["mean"]), np.array(row["eigenvalues"])
    found.vectors = np.array(row["eigenvectors"]).reshape(width, width)
    return found


def _state(number: int, s: Spectrum) -> dict:
    return {"id": number, "n": s.n, "sums": s.sums.tolist(), "mean": s.mean.tolist(),
            "eigenvalues": s.values.tolist(), "eigenvectors": s.vectors.ravel().tolist()}


def fit_spectrum(vectors: DataFrame, width: int, block_rows: int = BLOCK_ROWS) -> Spectrum | None:
    """Spectrum of the column ``x`` of a table, relative to ``SHIFT``; none without rows."""
    types = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())),
                       *[(c, pa.list_(pa.float64()))
                         for c in ("mean", "eigenvalues", "eigenvectors")]])

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Spectrum(width)
        for batch in batches:
            rows = _matrix(batch.column("x"), width) - SHIFT
            for at in range(0, len(rows), block_rows):
                found.add_rows(rows[at:at + block_rows])
        if found.n:
            yield pa.RecordBatch.from_pylist(
                [_state(TaskContext.get().partitionId(), found)], schema=types)

    def join(rows: list[dict]) -> dict:
        found = _spectrum(rows[0])
        for row in rows[1:]:
            found.add(_spectrum(row))
        return _state(0, found)

    row = _join_states(vectors.mapInArrow(update, STATE), STATE, "spectrum", join)
    return None if row is None else _spectrum(row.asDict())


@dataclass
class Whitener:
    """Exact count and sums, and what projects a vector on unit variance."""

    n: int
    sums: np.ndarray            # of x - SHIFT
    values: np.ndarray          # falling eigenvalues of the covariance, divisor n
    vectors: np.ndarray         # unit columns, the largest absolute entry positive
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x`` less the mean: whole part and fraction of the mean are taken off apart."""
        whole = self.sums // self.n
        return (x - SHIFT - whole) - (self.sums - whole * self.n) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(n x - sums) ** 2``; null where a long cannot hold it."""
        whole = self.sums // self.n
        near, rest = x - SHIFT - whole, self.sums - whole * self.n
        most = float(np.abs(near).max(initial=0) + 1) * self.n
        if most * most * x.shape[1] < float(1 << 62):
            return ((near * self.n - rest) ** 2).sum(1).tolist()
        exact = ((near.astype(object) * self.n - rest.astype(object)) ** 2).sum(1)
        return [v if v < 1 << 63 else None for v in exact]


def _summed(vectors: DataFrame, name: str, length: int,
            terms: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum of the terms of all batches, partition by partition, then a few at a time."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(length), False
        for batch in batches:
            if batch.num_rows:
                total, seen = total + terms(batch).ravel(), True
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()),
                 pa.array([total.tolist()], pa.list_(pa.float64()))], ["id", "total"])

    row = _join_states(vectors.mapInArrow(add, TOTAL), TOTAL, name, lambda rows: {
        "total": np.sum([r["total"] for r in rows], axis=0).tolist()})
    return np.array(row["total"])


def refine(vectors: DataFrame, width: int, spectrum: Spectrum, components: int) -> Whitener:
    """Rayleigh-Ritz: the covariance in the basis found, its small eigenproblem, the turn back.

    The basis is complete, so what is left of the updates' rounding is taken out of every
    component.  Components without variance, up to rounding, are left out.
    """
    basis, _ = np.linalg.qr(spectrum.vectors[:, ::-1])
    start = Whitener(spectrum.n, spectrum.sums, np.ones(width), basis, 0.0)

    def inner(batch: pa.RecordBatch) -> np.ndarray:
        y = start.centred(_matrix(batch.column("x"), width)) @ basis
        return y.T @ y

    ritz = _summed(vectors, "ritz", width * width, inner).reshape(width, width) / spectrum.n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values, found = values[::-1], (basis @ turn)[:, ::-1]
    trace = float(values.sum())
    kept = [i for i in range(min(components, width)) if values[i] > width * EPS * values[0]]
    found = found[:, kept] / np.linalg.norm(found[:, kept], axis=0)
    found = found * np.where(found[np.abs(found).argmax(0), np.arange(len(kept))] < 0, -1, 1)
    return Whitener(spectrum.n, spectrum.sums, values[kept], found, trace)


def measure_identity(vectors: DataFrame, width: int, whitener: Whitener) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity."""
    k = len(whitener.values)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        w = whitener.whitened(_matrix(batch.column("x"), width))
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    total = _summed(vectors, "identity", k + k * k, moments) / whitener.n
    mean, second = total[:k], total[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def fit_whitening(vectors: DataFrame, width: int, components: int = COMPONENTS,
                  block_rows: int = BLOCK_ROWS) -> Whitener | None:
    """Whitener of the distinct vectors ``x`` of a table; none if nothing varies."""
    distinct = stage(vectors.select("x").distinct(), "distinct-vectors")
    spectrum = fit_spectrum(distinct, width, block_rows)
    fitted = None
    if spectrum is not None:
        fitted = refine(distinct, width, spectrum, components)
        if len(fitted.values):
            fitted.identity_error = measure_identity(distinct, width, fitted)
        else:
            fitted = None
    discard_stage(distinct)
    return fitted


def whiten_embeddings(embeddings: DataFrame, components: int = COMPONENTS,
                      id_col: str = "vec_id", vector_col: str = "embedding",
                      block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per vector and component.

    Rows without a vector, with an empty one, or with an entry that is null, NaN or infinite
    are dropped; so are vectors whose length is not the most frequent one (of equally frequent
    ones the longest).  Equal vectors count once in the fit and get a row each.  Null ids stay
    null.  Entries beyond ``LIMIT / SCALE`` count as that.  A deviation that a long cannot hold
    is null.  There are as many components as have variance, at most ``components``; an empty
    table, a single vector or equal vectors give an empty result.  Other columns are not read.
    """
    vector = named(vector_col)
    rows = embeddings.filter(usable(vector)).select(
        named(id_col).cast("long").alias("vec_id"), whole_numbers(vector).alias("x"))
    most = rows.groupBy(F.size("x").alias("width")).count().orderBy(
        F.desc("count"), F.desc("width")).first()
    width = most["width"] if most else 1
    rows = rows.filter(F.size("x") == width)
    fitted = fit_whitening(rows, width, components, block_rows)
    if fitted is None:
        return rows.limit(0).select("vec_id").mapInArrow(lambda batches: iter(()), WHITENED)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fitted.values)
        shares = fitted.values / fitted.trace
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k)))
            deviations = pa.array(fitted.deviations(x), pa.int64())
            size = len(x) * k
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(size, fitted.n, np.int64)),
                deviations.take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(fitted.whitened(x).ravel()), pa.array(np.tile(shares, len(x))),
                pa.array(np.full(size, fitted.identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained",
                 "identity_error"])

    return rows.mapInArrow(project, WHITENED)
