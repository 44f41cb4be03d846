"""Label codes and the hierarchical labels derived from a leaf label."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowcascade.functions import quoted
from flowcascade.schema import (
    LEAVES,
    LEVEL_COLUMNS,
    NODES,
    UNRESOLVED,
    Node,
    leaves_of_class,
    leaves_of_node,
    node_of,
)
from flowcascade.session import stage

LabelMap = dict[str, int]

LEAF_FOLDER = "leaf_folder"     # partition column of tables laid out by leaf
OTHER_FOLDER = "other"          # rows of no known leaf


def fit_label_map(df: DataFrame, label: str) -> LabelMap:
    """Sorted distinct labels -> 0 .. n-1.  The class list is model state, kept on the driver."""
    found = (
        df.select(quoted(label).alias("label")).filter(F.col("label").isNotNull())
        .distinct().orderBy("label").collect()
    )
    return {row["label"]: code for code, row in enumerate(found)}


def lookup(c: Column, mapping: Mapping, default=None) -> Column:
    """Constant dictionary lookup as a ``when`` chain, which stays in generated code."""
    chain = None
    for key, value in mapping.items():
        hit = c == F.lit(key)
        chain = F.when(hit, F.lit(value)) if chain is None else chain.when(hit, F.lit(value))
    fallback = F.lit(default)
    return fallback if chain is None else chain.otherwise(fallback)


def _map_column(df: DataFrame, column: str, out: str, mapping: Mapping,
                key_type: str, value_type: str, default) -> DataFrame:
    """Map a column by a constant map, which Spark folds into one literal of the projection."""
    fallback = F.lit(default).cast(value_type)
    if not mapping:
        return df.withColumn(out, fallback)
    entries = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    typed = entries.cast(f"map<{key_type},{value_type}>")
    value = F.try_element_at(typed, quoted(column).cast(key_type))
    return df.withColumn(out, F.coalesce(value, fallback))


def encode_label(df: DataFrame, label: str, mapping: LabelMap, out: str = "label_code") -> DataFrame:
    """Label text to its stored code; a label outside the map becomes -1."""
    return _map_column(df, label, out, mapping, "string", "int", UNRESOLVED)


def decode_label(df: DataFrame, code: str, mapping: LabelMap, out: str = "label") -> DataFrame:
    """Code back to label text; an unknown code becomes null."""
    names = {v: k for k, v in mapping.items()}
    return _map_column(df, code, out, names, "int", "string", None)


def label_is_numeric(df: DataFrame, label: str) -> bool:
    return isinstance(df.schema[label].dataType, T.NumericType)


def resolve_leaf(df: DataFrame, label: str, mapping: LabelMap | None,
                 leaf: str = "leaf", code: str = "label_code") -> DataFrame:
    """Add the leaf name and its code, whether the label column is text or numeric."""
    if label_is_numeric(df, label):
        if not mapping:
            raise ValueError("a numeric label column needs a stored label map")
        coded = df.withColumn(code, quoted(label).cast("int"))
        return decode_label(coded, code, mapping, leaf)
    mapping = fit_label_map(df, label) if mapping is None else mapping
    return encode_label(df, label, mapping, code).withColumn(leaf, quoted(label))


def level_code(leaf: Column, node: Node) -> Column:
    """Class code of a leaf at one node; -1 where the node does not apply."""
    chain = None
    for code in range(node.width):
        hit = leaf.isin(*leaves_of_class(node, code))
        chain = F.when(hit, F.lit(code)) if chain is None else chain.when(hit, F.lit(code))
    return chain.otherwise(F.lit(UNRESOLVED)).cast("int")


def hierarchical_labels(df: DataFrame, leaf: str) -> DataFrame:
    """Add ``level1`` .. ``level5`` in one projection."""
    return df.withColumns({n.label_column: level_code(quoted(leaf), n) for n in NODES})


def present_levels(df: DataFrame) -> DataFrame:
    """``(level, node, present)``: does any row have a class at that level?

    Level 1 is always defined; its codes are -1 when no row is of a known class.
    """
    flags = df.agg(*[
        F.coalesce(F.max(c) > UNRESOLVED, F.lit(False)).alias(c) for c in LEVEL_COLUMNS])
    return flags.select(F.inline(F.array(*[
        F.struct(F.lit(n.level).alias("level"), F.lit(n.name).alias("node"),
                 F.col(n.label_column).alias("present"))
        for n in NODES])))


def present_level_ids(df: DataFrame) -> list[int]:
    """Levels that apply to any row; of a table laid out by leaf only folder names are read."""
    if LEAF_FOLDER in df.columns:
        found = {r[LEAF_FOLDER] for r in df.select(LEAF_FOLDER).distinct().collect()}
        return [n.level for n in NODES if found.intersection(leaves_of_node(n))]
    return [r["level"] for r in present_levels(df).collect() if r["present"]]


def stage_by_leaf(df: DataFrame, name: str, leaf: str = "leaf") -> DataFrame:
    """Stage a labelled table with a folder per known leaf and one for all other rows.

    A level is a list of leaves, so reading one level opens only the folders of its leaves.
    """
    known = F.when(quoted(leaf).isin(*LEAVES), quoted(leaf)).otherwise(F.lit(OTHER_FOLDER))
    return stage(df.withColumn(LEAF_FOLDER, known), name, by=LEAF_FOLDER)


def select_level(df: DataFrame, level: int | str) -> DataFrame:
    """Rows to which a level applies; of a table laid out by leaf only those folders are read."""
    node = node_of(level)
    if LEAF_FOLDER in df.columns:
        return df.filter(F.col(LEAF_FOLDER).isin(*leaves_of_node(node)))
    return df.filter(F.col(node.label_column) != UNRESOLVED)


def level_distribution(df: DataFrame) -> DataFrame:
    """``(level, node, class_code, class_name, rows)`` for every class seen.

    Rows are counted once per combination of codes (at most one per leaf), and
    only those few combinations are spread over the levels.
    """
    combos = df.groupBy(*LEVEL_COLUMNS).agg(F.count(F.lit(1)).alias("__n"))
    entries = F.array(*[
        F.struct(
            F.lit(n.level).alias("level"), F.lit(n.name).alias("node"),
            F.col(n.label_column).alias("class_code"),
            lookup(F.col(n.label_column), dict(enumerate(n.classes))).alias("class_name"),
            F.col("__n").alias("n"))
        for n in NODES])
    return (
        combos.select(F.inline(entries)).filter(F.col("class_code") != UNRESOLVED)
        .groupBy("level", "node", "class_code", "class_name").agg(F.sum("n").alias("rows"))
    )


def level_sizes(df: DataFrame) -> DataFrame:
    """``(level, node, rows, classes)``: rows used and classes seen per level."""
    return level_distribution(df).groupBy("level", "node").agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("classes"))
