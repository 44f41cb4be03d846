"""Flow-shaped views over the driver tables, in Spark and in SQL.

``flows`` reads every line item as one flow: a protocol code, four statistics
(one heavy-tailed, one with missing values), a text timestamp and a leaf label.
``scored`` adds per-node score arrays from fixed linear weights, so that cascade
and evaluation results can be compared value by value.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcascade.functions import linear_scores
from flowcascade.operators.labels import hierarchical_labels
from flowcascade.schema import LEAVES, NODES, Node, leaves_of_class

IDS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
STATISTICS = ["FlowDuration", "FlowBytes/s", "FwdIATMean", "FwdIATStd"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey")
    leaf = F.element_at(F.array(*[F.lit(x) for x in LEAVES]), (part % 13 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        *IDS,
        F.when(part % 3 == 0, 0).when(part % 3 == 1, 6).otherwise(17).alias("Protocol"),
        F.col("l_quantity").alias("FlowDuration"),
        F.when(part % 50 == 0, F.col("l_extendedprice") * 100)
        .otherwise(F.col("l_extendedprice")).alias("FlowBytes/s"),
        F.col("l_discount").alias("FwdIATMean"),
        F.nullif("l_tax", F.lit(0.0)).alias("FwdIATStd"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("Timestamp"),
        F.when(F.col("l_suppkey") % 97 == 0, "OTHER").otherwise(leaf).alias("Label"),
    )


def labelled_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchical_labels(flows(spark, sf_dir), "Label")


def _strings(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


FLOWS_SQL = f"""
select l_orderkey, l_partkey, l_suppkey, l_linenumber,
       case l_partkey % 3 when 0 then 0 when 1 then 6 else 17 end as "Protocol",
       l_quantity as "FlowDuration",
       case when l_partkey % 50 = 0 then l_extendedprice * 100
            else l_extendedprice end as "FlowBytes/s",
       l_discount as "FwdIATMean",
       nullif(l_tax, 0.0) as "FwdIATStd",
       strftime(l_shipdate, '%Y-%m-%d') as "Timestamp",
       case when l_suppkey % 97 = 0 then 'OTHER'
            else [{_strings(LEAVES)}][l_partkey % 13 + 1] end as "Label"
from lineitem
"""


def _level_sql(node: Node) -> str:
    whens = " ".join(
        f"when \"Label\" in ({_strings(leaves_of_class(node, code))}) then {code}"
        for code in range(node.width))
    return f"case {whens} else -1 end as {node.label_column}"


LABELLED_SQL = (
    'select *, ' + ", ".join(_level_sql(n) for n in NODES) + " from flows")


# --- learnable rows --------------------------------------------------------
# Three inputs as components, and a leaf that follows from quantity and discount but for
# every seventh order.  Every fourth order is for validation.
COMPONENTS = ["pca_component_1", "pca_component_2", "pca_component_3"]


def learnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("l_orderkey") % 7 == 0, F.col("l_partkey")).otherwise(F.lit(0))
    index = (F.floor(F.col("l_quantity") / 8) * 2
             + F.when(F.col("l_discount") > 0.05, 1).otherwise(0) + moved) % 13
    leaf = F.element_at(F.array(*[F.lit(x) for x in LEAVES]), (index + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(
        *IDS,
        (F.col("l_quantity") / 10).alias(COMPONENTS[0]),
        (F.col("l_discount") * 20).alias(COMPONENTS[1]),
        (F.col("l_extendedprice") / 20000).alias(COMPONENTS[2]),
        leaf.alias("leaf"), (F.col("l_orderkey") % 4 == 0).alias("held_out"))
    return hierarchical_labels(rows, "leaf")


def split_learnable(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = learnable(spark, sf_dir)
    return (rows.filter(~F.col("held_out")).drop("held_out"),
            rows.filter("held_out").drop("held_out"))


LEARNABLE_SQL = f"""
select row_number() over () as row_id, l_quantity as quantity, l_orderkey, l_partkey, l_suppkey, l_linenumber,
       (l_quantity / 10)::float::double as x1, (l_discount * 20)::float::double as x2,
       (l_extendedprice / 20000)::float::double as x3,
       [{_strings(LEAVES)}][((floor(l_quantity / 8) * 2
         + case when l_discount > 0.05 then 1 else 0 end
         + case when l_orderkey % 7 = 0 then l_partkey else 0 end) % 13 + 1)::int] as "Label",
       l_orderkey % 4 = 0 as held_out
from lineitem
"""
LEARNABLE_PARTS = [("rows", LEARNABLE_SQL), (
    "labelled", "select *, " + ", ".join(_level_sql(n) for n in NODES) + " from rows")]


# --- fifty statistics ------------------------------------------------------
WIDE = [f"s{i}" for i in range(50)]


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third one whole numbers, every seventh with missing values, every fifth rare."""
    price, quantity, tax = F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_tax")
    cols = []
    for i, name in enumerate(WIDE):
        c = price * (i + 1) - quantity * (49 * i)
        if i % 3 == 0:
            c = F.floor(c / 1000).cast("double")
        if i % 5 == 4:
            c = F.when(F.col("l_partkey") % 50 == i, c).otherwise(0.0)
        if i % 7 == 6:
            c = F.when(tax > 0, c)
        cols.append(c.alias(name))
    return table(spark, sf_dir, "lineitem").select(*cols)


def _wide_sql() -> str:
    cols = []
    for i, name in enumerate(WIDE):
        c = f"(l_extendedprice * {i + 1} - l_quantity * {49 * i})"
        if i % 3 == 0:
            c = f"floor({c} / 1000)"
        if i % 5 == 4:
            c = f"case when l_partkey % 50 = {i} then {c} else 0.0 end"
        if i % 7 == 6:
            c = f"case when l_tax > 0 then {c} end"
        cols.append(f"({c})::double as {name}")
    return f"select {', '.join(cols)} from lineitem"


WIDE_SQL = _wide_sql()


# --- fixed linear scores ---------------------------------------------------
# Inputs of the scores, scaled to about one.
SCORE_INPUTS = [("FlowDuration", 50.0), ("FlowBytes/s", 100000.0), ("FwdIATMean", 0.1)]


def fixed_weights(node: Node) -> tuple[list[list[float]], list[float]]:
    """Weights and intercepts by rule.

    The classes of a node point in evenly spread directions from the centre of
    the scaled inputs, so each of them wins somewhere.
    """
    weights, intercepts = [], []
    for code in range(node.width):
        angle = 2 * math.pi * (code + 0.3 * node.level) / node.width
        row = [round(4 * w, 9) for w in
               (math.cos(angle), math.sin(angle), 0.5 * math.cos(2 * angle))]
        weights.append(row)
        intercepts.append(round(-0.5 * sum(row), 9))
    return weights, intercepts


SCORES = {n.name: f"scores_{n.name}" for n in NODES}


def scored_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled flows with one score array per node."""
    inputs = [F.col(f"`{c}`") / F.lit(scale) for c, scale in SCORE_INPUTS]
    return labelled_flows(spark, sf_dir).withColumns({
        SCORES[n.name]: linear_scores(inputs, *fixed_weights(n)) for n in NODES})


def _score_sql(node: Node) -> str:
    items = []
    for row, intercept in zip(*fixed_weights(node)):
        terms = " + ".join(
            f"(\"{c}\" / '{scale!r}'::double) * '{w!r}'::double"
            for (c, scale), w in zip(SCORE_INPUTS, row))
        items.append(f"{terms} + '{intercept!r}'::double")
    return f"[{', '.join(items)}] as scores_{node.name}"


SCORED_SQL = "select *, " + ", ".join(_score_sql(n) for n in NODES) + " from labelled"


def _node_sql(node: Node) -> str:
    """Probabilities and own prediction of a node, before routing."""
    s = f"scores_{node.name}"
    return (
        f"list_transform({s}, lambda x: exp(x - list_max({s}))) as e_{node.name}, "
        f"list_position({s}, list_max({s})) - 1 as own_{node.name}")


OWN_SQL = "select *, " + ", ".join(_node_sql(n) for n in NODES) + " from scored"


def _routed_sql(node: Node) -> str:
    if node.parent is None:
        return f"own_{node.name} as pred_{node.name}"
    conditions, at = [], node
    while at.parent is not None:
        parent = next(n for n in NODES if n.name == at.parent)
        conditions.append(f"own_{parent.name} = {parent.classes.index(at.parent_class)}")
        at = parent
    return (f"case when {' and '.join(conditions)} then own_{node.name} "
            f"else -1 end as pred_{node.name}")


ROUTED_SQL = "select *, " + ", ".join(_routed_sql(n) for n in NODES) + " from own"

_flat_whens = " ".join(
    f"when pred_{n.name} = {code} then {LEAVES.index(cls)}"
    for n in NODES for code, cls in enumerate(n.classes) if cls in LEAVES)
FLAT_SQL = f"select *, case {_flat_whens} else -1 end as flat_pred from routed"

_PARTS = [
    ("flows", FLOWS_SQL), ("labelled", LABELLED_SQL), ("scored", SCORED_SQL),
    ("own", OWN_SQL), ("routed", ROUTED_SQL), ("predicted", FLAT_SQL),
]


def with_views(upto: str, body: str, extra: str = "") -> str:
    """``with <views up to this one>[, extra] body``."""
    parts = []
    for name, sql in _PARTS:
        parts.append(f"{name} as ({sql})")
        if name == upto:
            break
    if extra:
        parts.append(extra)
    return "with " + ",\n".join(parts) + "\n" + body
