"""A bounded sample per class that does not depend on how rows are partitioned.

Every row has a priority, a hash of its key.  The rows of a class with the least priorities
are its sample: samples of parts can be joined, and any partitioning gives the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowcascade.functions import quoted

PRIORITY, WEIGHT = "__priority", "weight"
HASH_DIGITS = 15                        # hexadecimal digits of the hash that are used
HASH_RANGE = float(16 ** HASH_DIGITS)
SLACK = 8.0                             # standard deviations above the wanted number of rows


def priority(columns: Iterable[Column]) -> Column:
    """A whole number below ``HASH_RANGE`` that follows from the values alone."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\0")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("long")


def _under(n: int, rows: int, tries: int) -> int:
    """A priority below which ``rows`` of ``n`` rows are expected, with some to spare."""
    share = (rows + SLACK * math.sqrt(rows) + 2 * SLACK) * 4 ** tries / n
    return int(HASH_RANGE * min(share, 1.0))


def _limits(df: DataFrame, per: str, sizes: dict, rows: int) -> dict:
    """Per class a priority under which the wanted rows certainly are.

    One counting pass is enough unless rows of equal key make up much of a class; then the
    limits of those classes are raised and counted again.
    """
    limits = {c: _under(n, rows, 0) for c, n in sizes.items()}
    tries = 0
    while True:
        found = {r[per]: r["n"] for r in df.filter(_below(per, limits)).groupBy(quoted(per)).agg(
            F.count(F.lit(1)).alias("n")).collect()}
        short = [c for c, n in sizes.items() if found.get(c, 0) < min(rows, n)]
        if not short:
            return limits
        tries += 1
        limits |= {c: _under(sizes[c], rows, tries) for c in short}


def _below(per: str, limits: dict) -> Column:
    pairs = F.create_map(*[F.lit(x) for c, t in limits.items() for x in (c, t)])
    return F.col(PRIORITY) < F.try_element_at(pairs, quoted(per))


def priority_sample(df: DataFrame, per: str, rows: int,
                    key: Iterable[str] | None = None) -> DataFrame:
    """At most ``rows`` rows of each value of ``per``, and a column ``weight``.

    ``key`` are the columns whose values decide, by default all of them.  The weights of a
    class add up to its rows, so means over a class and shares of classes stay right on
    average.  Rows that are equal in all columns come as one row with their joint weight.
    Rows whose ``per`` is null are left out.  No task gets more rows of a class than about
    ``rows``: all others are filtered where they are read.
    """
    if rows < 1:
        raise ValueError("a sample needs at least one row per class")
    columns = list(df.columns)
    data = df.filter(quoted(per).isNotNull()).withColumn(
        PRIORITY, priority([quoted(c) for c in (columns if key is None else key)]))
    sizes = {r[per]: r["n"] for r in data.groupBy(quoted(per)).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return df.limit(0).withColumn(WEIGHT, F.lit(1.0))
    near = data.filter(_below(per, _limits(data, per, sizes, rows)))
    merged = near.groupBy(*[quoted(c) for c in columns], PRIORITY).agg(
        F.count(F.lit(1)).alias("__copies"))
    order = Window.partitionBy(quoted(per)).orderBy(PRIORITY, *[quoted(c) for c in columns])
    before = F.coalesce(F.sum("__copies").over(
        order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, n / min(n, rows))])
    taken = F.least(F.col("__copies"), F.lit(rows) - F.col("__before"))
    return (merged.withColumn("__before", before).filter(F.col("__before") < rows)
            .select(*[quoted(c) for c in columns],
                    (taken * F.element_at(share, quoted(per))).alias(WEIGHT)))
