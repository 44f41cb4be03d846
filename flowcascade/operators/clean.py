"""Cleaning: duplicates, missing values, outlier fences, row accounting."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowcascade.functions import (
    finite_or_zero,
    is_missing,
    nan_to_null,
    quoted,
    to_double,
)
from flowcascade.operators.quantiles import approx_quantiles
from flowcascade.operators.radix import radix_quantiles
from flowcascade.schema import resolve_label
from flowcascade.session import stage

FENCE_MULTIPLIER = 3.0

FENCE_SCHEMA = "feature string, q1 double, q3 double, lower double, upper double"


@dataclass(frozen=True)
class Fence:
    """Limits of one column; a NaN limit is no limit."""

    q1: float
    q3: float
    lower: float
    upper: float

    @classmethod
    def around(cls, q1: float, q3: float, k: float) -> "Fence":
        spread = k * (q3 - q1)
        return cls(q1, q3, q1 - spread, q3 + spread)


Fences = dict[str, Fence]


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def numeric_columns(df: DataFrame, exclude: Iterable[str | None] = ()) -> list[str]:
    """Columns of a numeric type in column order."""
    skip = set(exclude)
    return [f.name for f in df.schema
            if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def text_columns(df: DataFrame, exclude: Iterable[str | None] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema
            if isinstance(f.dataType, T.StringType) and f.name not in skip]


def map_columns(df: DataFrame, change: Mapping[str, Column]) -> DataFrame:
    """Replace the named columns in place, as one projection."""
    return df.select(*[
        change[c].alias(c) if c in change else quoted(c) for c in df.columns])


def unify_missing(df: DataFrame) -> DataFrame:
    """NaN becomes null, so that both are one and the same missing value."""
    return map_columns(df, {
        f.name: nan_to_null(quoted(f.name)) for f in df.schema if is_floating(f.dataType)})


def dedup(df: DataFrame) -> DataFrame:
    """One row per distinct row over all columns.

    Copies are merged inside each map task before the shuffle, so a row that
    makes up much of the table costs one shuffled row per task.
    """
    return unify_missing(df).dropDuplicates()


def _complete(df: DataFrame, ignore: Iterable[str] = ()) -> Column:
    skip, complete = set(ignore), F.lit(True)
    for f in df.schema:
        if f.name not in skip:
            complete = complete & ~is_missing(quoted(f.name), is_floating(f.dataType))
    return complete


def drop_missing(df: DataFrame, ignore: Iterable[str] = ()) -> DataFrame:
    """Keep rows without null or NaN in any column but ``ignore``.  Infinities stay."""
    return df.filter(_complete(df, ignore))


COPIES, COMPLETE = "__copies", "__complete"
Accounting = list[tuple[str, int, int]]


def stage_counted(df: DataFrame, name: str, ignore: Iterable[str] = (),
                  spark: SparkSession | None = None) -> tuple[DataFrame, Accounting]:
    """De-duplicate, null-drop and stage a table, with the row counts of both steps.

    The de-duplicating aggregate also counts copies, and the table it writes keeps that
    count and the incomplete rows, so the counts are read off two of its columns; the input
    is not read again and a task that runs twice counts once.
    """
    data = unify_missing(df)
    counted = data.groupBy(*[quoted(c) for c in data.columns]).agg(
        F.count(F.lit(1)).alias(COPIES))
    table = stage(counted.withColumn(COMPLETE, _complete(data, ignore)), name, spark)
    row = table.agg(F.coalesce(F.sum(COPIES), F.lit(0)).alias("read"),
                    F.count(F.lit(1)).alias("kept"),
                    F.count_if(COMPLETE).alias("complete")).first()
    steps = [("input", row["read"], 0), ("dedup", row["kept"], row["read"] - row["kept"]),
             ("drop_missing", row["complete"], row["kept"] - row["complete"])]
    return table.filter(COMPLETE).drop(COPIES, COMPLETE), steps


def accounting_table(spark: SparkSession, steps: Accounting) -> DataFrame:
    return spark.createDataFrame(list(map(tuple, steps)), "step string, rows long, removed long")


def clean_report(df: DataFrame) -> DataFrame:
    """Rows and removed rows after each step: ``(step, rows, removed)``."""
    data = unify_missing(df)
    complete = F.lit(True)
    for c in data.columns:
        complete = complete & quoted(c).isNotNull()
    distinct = data.groupBy(*[quoted(c) for c in data.columns]).agg(F.count(F.lit(1)).alias("__n"))
    totals = distinct.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("read"),
        F.count(F.lit(1)).alias("kept"),
        F.count_if(complete).alias("complete"),
    )
    steps = F.array(
        F.struct(F.lit("input").alias("step"), F.col("read").alias("rows"),
                 F.lit(0).cast("long").alias("removed")),
        F.struct(F.lit("dedup").alias("step"), F.col("kept").alias("rows"),
                 (F.col("read") - F.col("kept")).alias("removed")),
        F.struct(F.lit("drop_missing").alias("step"), F.col("complete").alias("rows"),
                 (F.col("kept") - F.col("complete")).alias("removed")),
    )
    return totals.select(F.inline(steps))


def column_modes(df: DataFrame, cols: list[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest on ties; nulls do not count.

    Values are counted by key first, so no task holds all values of a column.
    """
    modes: dict[str, object] = {}
    for c in cols:
        top = (
            df.select(quoted(c).alias("value")).filter(F.col("value").isNotNull())
            .groupBy("value").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("value")).limit(1).first()
        )
        if top is not None:
            modes[c] = top["value"]
    return modes


def impute_mode(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Fill missing text values with the column's most frequent value."""
    cols = text_columns(df, [resolve_label(df.columns)]) if cols is None else cols
    if not cols:
        return df
    holes = df.agg(*[F.count_if(quoted(c).isNull()).alias(f"h{i}")
                     for i, c in enumerate(cols)]).first()
    modes = column_modes(df, [c for i, c in enumerate(cols) if holes[f"h{i}"]])
    return map_columns(df, {c: F.coalesce(quoted(c), F.lit(v)) for c, v in modes.items()})


def iqr_fences(df: DataFrame, cols: list[str] | None = None, k: float = FENCE_MULTIPLIER,
               approx: bool = False, exclude: Iterable[str] = ()) -> Fences:
    """``[q1 - k*iqr, q3 + k*iqr]`` per numeric column.

    Exact by default, in four passes that each count a digit of all columns;
    ``approx=True`` reads the data once with quantile sketches.  A column without
    values has no fence.
    """
    if cols is None:
        cols = numeric_columns(df, [resolve_label(df.columns)])
    cols = [c for c in cols if c not in set(exclude)]
    quantiles = (approx_quantiles if approx else radix_quantiles)(df, cols, [0.25, 0.75])
    return {c: Fence.around(q1, q3, k) for c, (q1, q3) in quantiles.items() if q1 is not None}


def fence_table(spark: SparkSession, fences: Fences) -> DataFrame:
    """The fences as a small report, one row per column."""
    rows = [(c, f.q1, f.q3, f.lower, f.upper) for c, f in fences.items()]
    return spark.createDataFrame(rows, FENCE_SCHEMA)


def clip(c: Column, lower: float, upper: float) -> Column:
    """Limit a number; null and NaN pass through, a NaN limit does nothing."""
    limited = None
    if not math.isnan(lower):
        limited = F.when(c < F.lit(float(lower)), F.lit(float(lower)))
    if not math.isnan(upper):
        above = (c > F.lit(float(upper))) & ~F.isnan(c)
        limited = (F if limited is None else limited).when(above, F.lit(float(upper)))
    return c if limited is None else limited.otherwise(c)


def clip_to(df: DataFrame, fences: Fences) -> DataFrame:
    """Winsorise every fenced column that is present."""
    return map_columns(df, {
        c: clip(quoted(c).cast("double"), f.lower, f.upper)
        for c, f in fences.items() if c in df.columns})


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text to double; what is no number becomes missing."""
    return map_columns(df, {c: to_double(quoted(c)) for c in cols})


def zero_nonfinite(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null, NaN and infinities become 0."""
    return map_columns(df, {c: finite_or_zero(quoted(c).cast("double")) for c in cols})


def clean(df: DataFrame, fences: Fences | None = None, k: float = FENCE_MULTIPLIER,
          approx: bool = False, exclude: Iterable[str] = (),
          staged: bool = True) -> tuple[DataFrame, Fences]:
    """Duplicates, then missing values, then outliers.

    Mode imputation sits between the last two in the order of steps, but no
    value can be missing there any more, so it is not run.  Without ``fences``
    they are measured on this table, which reads it several times; ``staged``
    keeps the de-duplication shuffle from being repeated by those passes.
    """
    kept = drop_missing(dedup(df))
    if fences is None:
        if staged:
            kept = stage(kept, "clean")
        fences = iqr_fences(kept, k=k, approx=approx, exclude=exclude)
    return clip_to(kept, fences), fences
