"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowcascade.session import stage

# A batch handed to Python holds at most so many rows and about so many bytes.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20


def prepare_session(spark: SparkSession) -> None:
    """Bound what one Arrow batch brings into a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare_session(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (null: empty), so no other column can clash."""
    return df.select(named(id_col).cast("long").alias("doc_id"),
                     F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))


def map_whole_rows(df: DataFrame, fn) -> DataFrame:
    """``df.mapInArrow(fn)`` with the schema of ``df``, whatever its columns are called."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(fn, plain.schema).toDF(*df.columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only_ids(docs: DataFrame, ids: DataFrame, id_col: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose id is (``left_semi``) or is not (``left_anti``) in ``ids.doc_id``."""
    keys = ids.select(F.col("doc_id").alias("__id"))
    return docs.join(keys, named(id_col).cast("long").eqNullSafe(F.col("__id")), how)


def number_rows(df: DataFrame, group: list[str], order: list[str], name: str,
                numbered: str = "nth", counted: str | None = None,
                sized: str | None = None) -> DataFrame:
    """``df`` with a number from 0, without gaps, in each group, in the order given.

    With ``counted``, a column of 0 and 1, the number of earlier rows of the group that have 1;
    with any column of whole numbers, its sum over them.  ``sized`` names a column for the
    size of the group.

    No task numbers a whole group: the rows are range-partitioned by group and order and
    written, each partition numbers its own part of a group, and the counts per partition
    give the offsets.  ``order`` must not contain ties that matter.
    """
    placed = stage(df.withColumn("__tie", F.monotonically_increasing_id())
                   .repartitionByRange(*group, *order, "__tie")
                   .withColumn("__part", F.spark_partition_id()), name)
    size = F.count("*") if counted is None else F.sum(named(counted))
    counts = placed.groupBy(*group, "__part").agg(size.alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(
        Window.unboundedPreceding, -1)
    renamed = {c: f"__{c}" for c in group}
    known = {"__first": F.coalesce(F.sum("__n").over(before), F.lit(0))}
    if sized:
        known[sized] = F.sum("__n").over(Window.partitionBy(*group))
    offsets = counts.withColumns(known).drop("__n").withColumnsRenamed(
        renamed | {"__part": "__at"})
    inside = Window.partitionBy(*group, "__part").orderBy(*order, "__tie")
    earlier = F.row_number().over(inside) - 1 if counted is None else F.coalesce(
        F.sum(named(counted)).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = F.col("__part") == F.col("__at")
    for c, other in renamed.items():
        same &= named(c).eqNullSafe(named(other))
    return (placed.withColumn("__nth", earlier)
            .join(offsets, same)
            .withColumn(numbered, (F.col("__first") + F.col("__nth")).cast("long"))
            .drop("__tie", "__part", "__at", "__first", "__nth", *renamed.values()))
