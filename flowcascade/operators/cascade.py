"""Cascade scoring: from per-node score arrays to routed predictions.

Every step is a row-wise expression over the five score arrays; nothing is
shuffled.  A node's record is ``struct<logits, probs, pred>``; a row that was not
routed to the node gets pred -1, probabilities 0 and logits -1000.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowcascade.functions import argmax, quoted, with_softmax
from flowcascade.operators.labels import lookup
from flowcascade.schema import (
    LEAVES,
    MASKED_LOGIT,
    NODES,
    UNRESOLVED,
    Node,
    leaf_paths,
    node_of,
)

Scores = Mapping[str, str]      # node name -> name of its score-array column

ROOT = "Root"


def own_column(node: Node) -> str:
    """A node's decision from its own scores, whether or not the row gets there."""
    return f"__own_{node.name}"


def pred_column(node: Node) -> str:
    return f"pred_{node.name}"


def _probs_column(node: Node) -> str:
    return f"__probs_{node.name}"


def routed(node: Node) -> Column:
    """Do all decisions above ``node`` lead to it?  True for the root."""
    here = F.lit(True)
    while node.parent is not None:
        parent = node_of(node.parent)
        code = parent.classes.index(node.parent_class)
        here = here & (F.col(own_column(parent)) == F.lit(code))
        node = parent
    return here


def with_routed_predictions(df: DataFrame, scores: Scores) -> DataFrame:
    """Add ``pred_<node>`` for every node and ``flat_pred``; -1 where not routed."""
    own = df.withColumns({
        own_column(n): argmax(quoted(scores[n.name])) if n.name in scores else F.lit(UNRESOLVED)
        for n in NODES})
    preds = own.withColumns({
        pred_column(n): F.when(routed(n), F.col(own_column(n))).otherwise(F.lit(UNRESOLVED))
        for n in NODES})
    flat = preds.withColumn("flat_pred", flat_prediction())
    return flat.drop(*[own_column(n) for n in NODES])


def _record(node: Node, scores: Scores) -> Column:
    """Logits, probabilities and prediction, with the fixed fill where not routed."""
    no_logits = F.array(*[F.lit(MASKED_LOGIT)] * node.width)
    no_probs = F.array(*[F.lit(0.0)] * node.width)
    pred = F.col(pred_column(node))
    logits, probs = no_logits, no_probs
    if node.name in scores:
        here = pred != UNRESOLVED
        logits = F.when(here, quoted(scores[node.name])).otherwise(no_logits)
        probs = F.when(here, F.col(_probs_column(node))).otherwise(no_probs)
    return F.struct(logits.alias("logits"), probs.alias("probs"), pred.alias("pred"))


def cascade(df: DataFrame, scores: Scores, flat_probs: bool = False) -> DataFrame:
    """Add one record per node, the flat leaf index and, if asked, leaf probabilities.

    A node without scores resolves nothing: its rows keep -1 below it.  What is
    not read later (probabilities, say) is not computed.
    """
    preds = with_routed_predictions(df, scores)
    probs = with_softmax(preds, {
        _probs_column(n): (scores[n.name], n.width) for n in NODES if n.name in scores})
    extra = {"flat_probs": leaf_probabilities(scores)} if flat_probs else {}
    out = probs.withColumns({**{n.record: _record(n, scores) for n in NODES}, **extra})
    return out.drop(*[c for n in NODES for c in (pred_column(n), _probs_column(n))])


def flat_prediction() -> Column:
    """Leaf index 0..12 of the routed decisions; -1 where they end early.

    Only the last decision of a leaf's path has to be tested: a node's prediction
    is -1 unless all decisions above it led there.
    """
    chain = None
    for leaf, path in leaf_paths().items():
        node, code = path[-1]
        hit = F.col(pred_column(node)) == F.lit(code)
        value = F.lit(LEAVES.index(leaf))
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain.otherwise(F.lit(UNRESOLVED)).cast("int")


def leaf_probabilities(scores: Scores) -> Column:
    """Product of the node probabilities along each leaf's path, in leaf order.

    The nodes' own probabilities are used, whether or not the row was routed to
    them, so the 13 values sum to 1 when every node has scores.
    """
    paths = leaf_paths()
    products = []
    for leaf in LEAVES:
        product = None
        for node, code in paths[leaf]:
            p = F.col(_probs_column(node))[code] if node.name in scores else F.lit(0.0)
            product = p if product is None else product * p
        products.append(product)
    return F.array(*products)


def leaf_name(index: Column) -> Column:
    return lookup(index, dict(enumerate(LEAVES)))


def prediction_columns(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Flat table: carried columns, ``pred_<node>`` for each node, ``flat_pred``."""
    return df.select(
        *[quoted(c) for c in keep],
        *[F.col(n.record)["pred"].alias(pred_column(n)) for n in NODES],
        F.col("flat_pred"))


def _display_name(node: Node, pred: Column) -> Column:
    return lookup(pred, {code: node.display(cls) for code, cls in enumerate(node.classes)})


def path_steps() -> Column:
    """``Level n: class`` texts of the decisions taken, root first (at most 3)."""
    steps = []
    for node in NODES:
        name = _display_name(node, F.col(node.record)["pred"])
        steps.append(F.when(name.isNotNull(), F.concat(F.lit(f"Level {node.depth}: "), name)))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def decision_path(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Carried columns plus ``steps``, ``n_steps`` and the joined ``path`` text."""
    return df.select(*[quoted(c) for c in keep], path_steps().alias("steps")).select(
        *[quoted(c) for c in keep],
        F.col("steps"), F.size("steps").alias("n_steps"),
        F.concat_ws(" -> ", F.col("steps")).alias("path"))


def tree_nodes() -> list[tuple[str, str | None, int]]:
    """(name, parent, depth) of the 18 nodes of the decision tree, root first."""
    found: list[tuple[str, str | None, int]] = [(ROOT, None, 0)]
    for node in NODES:
        parent = node.parent_class or ROOT
        found += [(node.display(cls), parent, node.depth) for cls in node.classes]
    return found


def node_counts(df: DataFrame) -> DataFrame:
    """``(node, parent, depth, n, size)`` over the decision tree, zero counts included.

    ``size`` is 1000 * (n + 1) / (rows + 1).  Rows are first counted per
    combination of decisions (a few hundred at most), so only those counts are
    spread over the tree.
    """
    preds = {n.name: pred_column(n) for n in NODES}
    combos = (
        df.select(*[F.col(n.record)["pred"].alias(preds[n.name]) for n in NODES])
        .groupBy(*preds.values()).agg(F.count(F.lit(1)).alias("__n"))
    )
    aggs = [F.coalesce(F.sum("__n"), F.lit(0)).alias("c0")]
    entries = [F.struct(F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"),
                        F.lit(0).alias("depth"), F.col("c0").alias("n"))]
    for node in NODES:
        for code, cls in enumerate(node.classes):
            name = f"c{len(entries)}"
            hit = F.when(F.col(preds[node.name]) == code, F.col("__n"))
            aggs.append(F.coalesce(F.sum(hit), F.lit(0)).alias(name))
            entries.append(F.struct(
                F.lit(node.display(cls)).alias("node"),
                F.lit(node.parent_class or ROOT).alias("parent"),
                F.lit(node.depth).alias("depth"), F.col(name).alias("n")))
    counted = combos.agg(*aggs)
    return counted.select(F.col("c0").alias("__rows"), F.inline(F.array(*entries))).select(
        "node", "parent", "depth", "n",
        (F.lit(1000.0) * (F.col("n") + 1) / (F.col("__rows") + 1)).alias("size"))
