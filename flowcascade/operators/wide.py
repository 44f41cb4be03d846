"""Columns of very many categories: numbered tables that are joined, and sparse vectors.

Nothing is collected: the sorted distinct values are numbered by ranges, the numbering is a
table, and coding a column is a join with it, which Spark broadcasts only if it knows the
table to be small and else splits where a value is frequent.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowcascade.functions import quoted
from flowcascade.schema import UNRESOLVED
from flowcascade.session import stage

# functions of this module travel to the executors by value, which need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def number_values(df: DataFrame, column: str) -> DataFrame:
    """``(value, code)``: the distinct values of a column, numbered from 0 in their order.

    The values are range-partitioned and written; each range numbers its own and starts
    after the values of the ranges before it.  Nulls get no code.
    """
    distinct = df.select(quoted(column).alias("value")).filter(
        F.col("value").isNotNull()).distinct()
    placed = stage(distinct.repartitionByRange("value").withColumn(
        "part", F.spark_partition_id()), "values")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(  # a row per range
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
    numbered = placed.withColumn("own", own).join(starts, "part").select(
        "value", (F.col("start") + F.col("own")).cast("long").alias("code"))
    return stage(numbered, "codes")


def encode_by_table(df: DataFrame, column: str, table: DataFrame,
                    out: str = "label_code") -> DataFrame:
    """The code of each row's value; a value that the table has not, or null, gets -1."""
    codes = table.select(F.col("value").alias("__value"), F.col("code").alias("__code"))
    joined = df.join(codes, quoted(column) == F.col("__value"), "left")
    return joined.withColumn(out, F.coalesce("__code", F.lit(UNRESOLVED).cast("long"))).drop(
        "__value", "__code")


def decode_by_table(df: DataFrame, code: str, table: DataFrame, out: str = "label") -> DataFrame:
    """Code back to value; an unknown code becomes null."""
    values = table.select(F.col("value").alias(out), F.col("code").alias("__code"))
    return df.join(values, quoted(code) == F.col("__code"), "left").drop("__code")


def one_hot_sparse(df: DataFrame, column: str, table: DataFrame, out: str) -> DataFrame:
    """A sparse vector per row with a 1 at its value's code; all zeros for unknown values.

    Its length is the number of values in the table, its memory that of one entry.  The column
    has no names of its places: Spark's encoder keeps one per value in the schema, on the driver.
    """
    size = table.count()

    def hot(codes: pa.Array) -> pa.Array:
        codes = codes.to_numpy(zero_copy_only=False)
        known = codes >= 0
        ends = np.concatenate([[0], np.cumsum(known)]).astype("int32")
        return pa.StructArray.from_arrays([
            pa.array(np.zeros(len(codes), "int8")), pa.array(np.full(len(codes), size, "int32")),
            pa.ListArray.from_arrays(ends, codes[known].astype("int32")),
            pa.ListArray.from_arrays(ends, np.ones(ends[-1]))],
            ["type", "size", "indices", "values"])

    coded = encode_by_table(df, column, table, "__code_of")
    return coded.withColumn(out, F.arrow_udf(hot, VectorUDT())("__code_of")).drop("__code_of")


def sum_vectors(df: DataFrame, vectors: str, size: int) -> DataFrame:
    """``(code, total)``: the sum of a column of vectors of this size, one row per place.

    The entries are added up by place, so no task holds a vector of sums.  Places without
    entries have 0; null vectors are left out.
    """
    parts = F.col("__parts")
    places = F.coalesce(parts["indices"], F.transform(parts["values"], lambda _, i: i))
    entries = df.select(F.unwrap_udt(quoted(vectors)).alias("__parts")).select(
        F.inline(F.arrays_zip(places.alias("code"), parts["values"].alias("value"))))
    zeros = df.sparkSession.range(size).select(
        F.col("id").cast("int").alias("code"), F.lit(0.0).alias("value"))
    return entries.unionByName(zeros).groupBy("code").agg(F.sum("value").alias("total"))
