"""Joining the states that partitions keep, a few at a time, on executors."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from flowcascade.session import discard_stage, stage

JOINED = 8          # states that one task joins


def join_states(states: DataFrame, name: str, join: Callable[[list[dict]], dict],
                joined: int = JOINED) -> Row | None:
    """One state out of all of them, none if there is none.

    ``states`` has a column ``id`` and one row per partition; ``join`` makes one row of up to
    ``joined`` rows, in the order of their ids.  Every round is written, so a lost executor
    repeats one round at most, and the driver only ever gets the last row.
    """
    schema = states.schema

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["id"])
        return pa.Table.from_pylist([join(rows) | {"id": rows[0]["id"] // joined}],
                                    schema=table.schema)

    table = stage(states, name)
    while table.agg(F.count("*")).first()[0] > 1:
        group = F.floor(F.col("id") / joined).alias("group")
        fewer = stage(table.groupBy(group).applyInArrow(merge, schema), name)
        discard_stage(table)
        table = fewer
    row = table.first()
    discard_stage(table)
    return row
