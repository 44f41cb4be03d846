"""Exact order statistics of many columns by digits of their bit patterns.

A double's bits, turned so that they sort as the numbers do, are a 64-bit code.  Each pass
counts one 16-bit digit of the codes of all columns, of those rows whose digits so far are
the ones being looked for; running counts give the digit in which each wanted rank lies.
After four passes the code is complete, whatever the number of rows and however the values
are spread or repeated.

A task holds one array of 65,536 counts per column and digits looked for, and emits the
counts that are not zero; nothing is sampled, sorted or gathered.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowcascade.functions import quoted
from flowcascade.session import discard_stage, stage

# functions of this module travel to the executors by value, which need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIGIT_BITS = 16
PASSES = 64 // DIGIT_BITS
COLUMNS_AT_ONCE = 64        # bounds a task's counts; wider tables take several rounds

_SIGN = np.uint64(1 << 63)
_LAST_DIGIT = np.uint64((1 << DIGIT_BITS) - 1)
COUNTS = "search int, digit int, n long"


def codes_of(values: np.ndarray) -> np.ndarray:
    """Unsigned codes that sort as the numbers do; both zeros have one code."""
    bits = (values + 0.0).view(np.int64)
    flipped = (bits >> 63).view(np.uint64) | _SIGN      # all bits of negative numbers, else one
    return bits.view(np.uint64) ^ flipped


def values_of(codes: Sequence[int]) -> np.ndarray:
    codes = np.array(codes, np.uint64)
    return np.where(codes & _SIGN, codes ^ _SIGN, ~codes).view(np.float64)


def digit_counts(batches: Iterator[pa.RecordBatch], step: int,
                 searches: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Counts of digit ``step`` per search, a column and the digits before this one."""
    counts: dict[int, np.ndarray] = {}
    shift = np.uint64(64 - DIGIT_BITS * (step + 1))
    above = np.uint64(64 - DIGIT_BITS * step) if step else None
    by_column: dict[int, list[tuple[int, int]]] = {}
    for number, (column, prefix) in enumerate(searches):
        by_column.setdefault(column, []).append((number, prefix))
    for batch in batches:
        for column, wanted in by_column.items():
            values = batch.column(column).to_numpy(zero_copy_only=False)
            nan = np.isnan(values)
            codes = codes_of(values[~nan] if nan.any() else values)
            before = None if above is None else codes >> above
            for number, prefix in wanted:
                own = codes if before is None else codes[before == np.uint64(prefix)]
                if len(own):
                    digits = ((own >> shift) & _LAST_DIGIT).view(np.int64)
                    if number not in counts:
                        counts[number] = np.zeros(1 << DIGIT_BITS, np.int64)
                    np.add.at(counts[number], digits, 1)
    for number, found in counts.items():
        digits = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(digits), number, np.int32)),
             pa.array(digits.astype(np.int32)), pa.array(found[digits])],
            ["search", "digit", "n"])


def _pick(table: DataFrame, ranks: dict[int, list[int]]) -> dict[tuple[int, int], tuple[int, int]]:
    """For each search and rank in it: the digit, and the rows of smaller digits."""
    upto = F.sum("n").over(Window.partitionBy("search").orderBy("digit"))   # 65,536 rows at most
    wanted = F.create_map(*[x for s, own in ranks.items()
                            for x in (F.lit(s), F.array(*[F.lit(r).cast("long") for r in own]))])
    rows = table.withColumn("upto", upto).filter(F.exists(
        F.try_element_at(wanted, F.col("search")),
        lambda r: (F.col("upto") - F.col("n") <= r) & (r < F.col("upto")))).collect()
    return {(row["search"], r): (row["digit"], row["upto"] - row["n"])
            for row in rows for r in ranks[row["search"]]
            if row["upto"] - row["n"] <= r < row["upto"]}


def _positions(n: int, shares: Sequence[float]) -> list[int]:
    """The ranks that linear interpolation needs, without repeats."""
    found = set()
    for p in shares:
        low = math.floor(p * (n - 1))
        found |= {low, min(low + 1, n - 1)}
    return sorted(found)


def interpolate(share: float, n: int, value_at: dict[int, float]) -> float:
    """Linear interpolation between two ranks, evaluated the way numpy evaluates it."""
    position = share * (n - 1)
    low = math.floor(position)
    a, b = value_at[low], value_at[min(low + 1, n - 1)]
    t = position - low
    return b - (b - a) * (1 - t) if t >= 0.5 else a + (b - a) * t


def _some_columns(df: DataFrame, cols: list[str],
                  shares: Sequence[float]) -> dict[str, list[float | None]]:
    data = df.select(*[quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    # per wanted rank of a column: the digits found, and the rank among rows that have them
    searches: list[tuple[int, int]] = [(i, 0) for i in range(len(cols))]
    sizes: dict[int, int] = {}
    open_ranks: dict[tuple[int, int], tuple[int, int]] = {}
    for step in range(PASSES):
        table = stage(
            data.mapInArrow(lambda batches, at=step, of=searches: digit_counts(batches, at, of),
                            COUNTS)
            .groupBy("search", "digit").agg(F.sum("n").alias("n")), "digits")
        if step == 0:
            sizes = {r["search"]: r["n"] for r in
                     table.groupBy("search").agg(F.sum("n").alias("n")).collect()}
            open_ranks = {(i, r): (0, r) for i, n in sizes.items()
                          for r in _positions(n, shares)}
        number = {search: k for k, search in enumerate(searches)}
        ranks: dict[int, list[int]] = {}
        for (column, _), (prefix, rank) in open_ranks.items():
            ranks.setdefault(number[column, prefix], []).append(rank)
        found = _pick(table, ranks) if ranks else {}
        discard_stage(table)
        for key, (prefix, rank) in open_ranks.items():
            digit, below = found[number[key[0], prefix], rank]
            open_ranks[key] = (prefix << DIGIT_BITS | digit, rank - below)
        searches = sorted({(column, prefix) for (column, _), (prefix, _) in open_ranks.items()})
    keys = list(open_ranks)
    exact = dict(zip(keys, values_of([open_ranks[k][0] for k in keys]).tolist()))
    result: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        n = sizes.get(i, 0)
        at = {r: v for (column, r), v in exact.items() if column == i}
        result[c] = [interpolate(p, n, at) if n else None for p in shares]
    return result


def radix_quantiles(df: DataFrame, cols: list[str],
                    shares: Sequence[float]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of whole columns; nulls and NaN are ignored.

    Four passes over the columns.  A column without values gets ``None`` for every share.
    """
    found: dict[str, list[float | None]] = {}
    for at in range(0, len(cols), COLUMNS_AT_ONCE):
        found |= _some_columns(df, cols[at:at + COLUMNS_AT_ONCE], shares)
    return found
