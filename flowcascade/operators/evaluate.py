"""Evaluation tables: loss, accuracy, confusion matrices, reports.

Rows are reduced to counts per (true, predicted) pair first; everything else
works on those few counts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowcascade.functions import argmax, logsumexp, quoted
from flowcascade.operators.labels import lookup
from flowcascade.schema import LEAVES, NODES, UNRESOLVED, Node
from flowcascade.session import stage

ROW_NORMALISER = 1e-10      # keeps an empty row of the matrix from dividing by zero


def cross_entropy(logits: Column, target: Column, width: int | None = None,
                  peak: Column | None = None) -> Column:
    """-log softmax(logits)[target], from the logits."""
    return logsumexp(logits, width, peak) - F.get(logits, target)


def log_loss(df: DataFrame, logits: str, target: str, width: int | None = None) -> DataFrame:
    """One row ``(rows, loss)``: the mean over rows, 0 for an empty table."""
    loss = cross_entropy(quoted(logits), quoted(target), width)
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.coalesce(F.avg(loss), F.lit(0.0)).alias("loss"))


def accuracy(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """One row ``(rows, correct, accuracy)``, accuracy in percent, 0 when empty."""
    hits = F.count_if(quoted(y_true) == quoted(y_pred))
    return df.agg(F.count(F.lit(1)).alias("rows"), hits.alias("correct")).select(
        "rows", "correct", _percent(F.col("correct"), F.col("rows")).alias("accuracy"))


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(F.lit(100.0) * part, whole), F.lit(0.0))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


# --- confusion matrix ------------------------------------------------------
def confusion(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Long form ``(y_true, y_pred, n)`` over the pairs that occur."""
    return df.groupBy(quoted(y_true).alias("y_true"), quoted(y_pred).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_normalised(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Long form with ``share``: the count over its row's total."""
    per_row = Window.partitionBy("y_true")      # at most one row per predicted class
    pairs = confusion(df, y_true, y_pred)
    return pairs.withColumn(
        "share", F.col("n") / (F.sum("n").over(per_row) + F.lit(ROW_NORMALISER)))


def confusion_matrix(df: DataFrame, y_true: str, y_pred: str,
                     classes: list | None = None, normalise: bool = False) -> DataFrame:
    """Wide form: one row and one column ``p_<class>`` per class.

    The classes are those named, then the other values of both columns, sorted, so that
    every pair without a null is counted.
    """
    pairs = confusion(df, y_true, y_pred)
    seen = pairs.select(F.explode(F.array("y_true", "y_pred")).alias("c")).distinct()
    found = [r["c"] for r in seen.filter(F.col("c").isNotNull()).orderBy("c").collect()]
    classes = list(classes or [])
    classes += [c for c in found if c not in classes]
    if not classes:
        return pairs.select("y_true").limit(0)
    wide = pairs.groupBy("y_true").pivot("y_pred", classes).agg(F.sum("n")).toDF(
        "__true", *[f"__n{i}" for i in range(len(classes))])
    kind = pairs.schema["y_true"].dataType.simpleString()
    rows = df.sparkSession.createDataFrame(
        list(enumerate(classes)), f"__at int, y_true {kind}")
    cells = [F.coalesce(F.col(f"__n{i}"), F.lit(0)) for i in range(len(classes))]
    if normalise:
        total = sum(cells[1:], cells[0]) + F.lit(ROW_NORMALISER)
        cells = [x / total for x in cells]
    return rows.join(wide, F.col("y_true") == F.col("__true"), "left").orderBy("__at").select(
        "y_true", *[x.alias(f"p_{p}") for x, p in zip(cells, classes)])


# --- classification report -------------------------------------------------
def _report_row(name: str, precision: Column, recall: Column, f1: Column,
                support: Column) -> Column:
    return F.struct(F.lit(name).alias("class"), precision.alias("precision"),
                    recall.alias("recall"), f1.alias("f1"),
                    support.cast("double").alias("support"))


def classification_report(df: DataFrame, y_true: str, y_pred: str,
                          names: list[str]) -> DataFrame:
    """``(class, precision, recall, f1, support)``, then three summary rows.

    All named classes are listed; a class that never occurs has support 0, and a
    ratio over nothing is 0.  A prediction outside the names (-1) only counts as
    wrong.  The accuracy row repeats its value in all four columns.  An empty
    input gives an empty report.
    """
    return report_of_counts(confusion(df, y_true, y_pred), names)


def report_of_counts(pairs: DataFrame, names: list[str]) -> DataFrame:
    """The same report from the counts ``(y_true, y_pred, n)``."""
    n, same = F.col("n"), F.col("y_true") == F.col("y_pred")
    zero = F.lit(0).cast("long")
    aggs = [F.coalesce(F.sum(n), zero).alias("rows"),
            F.coalesce(F.sum(F.when(same, n)), zero).alias("correct")]
    for code in range(len(names)):
        is_true, is_pred = F.col("y_true") == code, F.col("y_pred") == code
        aggs += [
            F.coalesce(F.sum(F.when(is_true & is_pred, n)), zero).alias(f"hit{code}"),
            F.coalesce(F.sum(F.when(is_pred, n)), zero).alias(f"pred{code}"),
            F.coalesce(F.sum(F.when(is_true, n)), zero).alias(f"true{code}")]
    counts = pairs.agg(*aggs).filter(F.col("rows") > 0)
    measured = counts.select("rows", "correct", *[
        F.struct(
            F.lit(name).alias("name"),
            _ratio(F.col(f"hit{c}"), F.col(f"pred{c}")).alias("precision"),
            _ratio(F.col(f"hit{c}"), F.col(f"true{c}")).alias("recall"),
            _ratio(F.lit(2) * F.col(f"hit{c}"),
                   F.col(f"pred{c}") + F.col(f"true{c}")).alias("f1"),
            F.col(f"true{c}").alias("support")).alias(f"m{c}")
        for c, name in enumerate(names)])
    marks = [F.col(f"m{c}") for c in range(len(names))]
    support = sum((m["support"] for m in marks[1:]), marks[0]["support"])

    def macro(part: str) -> Column:
        return sum((m[part] for m in marks[1:]), marks[0][part]) / F.lit(float(len(names)))

    def weighted(part: str) -> Column:
        terms = [m[part] * m["support"] for m in marks]
        return _ratio(sum(terms[1:], terms[0]), support)

    accuracy_value = _ratio(F.col("correct"), F.col("rows"))
    rows = [_report_row(name, m["precision"], m["recall"], m["f1"], m["support"])
            for name, m in zip(names, marks)]
    rows += [
        _report_row("accuracy", accuracy_value, accuracy_value, accuracy_value, accuracy_value),
        _report_row("macro avg", macro("precision"), macro("recall"), macro("f1"), support),
        _report_row("weighted avg", weighted("precision"), weighted("recall"),
                    weighted("f1"), support)]
    return measured.select(F.inline(F.array(*rows)))


# --- per level, end to end -------------------------------------------------
def level_pairs(df: DataFrame, scores: dict[str, str], keep: Iterable[str] = ()) -> DataFrame:
    """One row per row and applicable level: ``(level, node, y_true, y_pred, loss)``.

    Each node predicts from its own scores for every row whose true label
    belongs to it, whichever way the cascade would have routed that row.
    """
    entries = []
    for node in NODES:
        if node.name not in scores:
            continue
        pred, loss = _node_result(node, scores)
        entries.append(F.when(F.col(node.label_column) != UNRESOLVED, F.struct(
            F.lit(node.level).alias("level"), F.lit(node.name).alias("node"),
            F.col(node.label_column).alias("y_true"), pred.alias("y_pred"),
            loss.alias("loss"))))
    applicable = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return _with_peaks(df, scores).select(*[quoted(c) for c in keep], F.inline(applicable))


def _node_result(node: Node, scores: dict[str, str]) -> tuple[Column, Column]:
    logits = quoted(scores[node.name])
    return (argmax(logits),
            cross_entropy(logits, F.col(node.label_column), node.width,
                          F.col(_peak_column(node))))


def _peak_column(node: Node) -> str:
    return f"__peak_{node.name}"


def _with_peaks(df: DataFrame, scores: dict[str, str]) -> DataFrame:
    return df.withColumns({_peak_column(n): F.array_max(quoted(scores[n.name]))
                           for n in NODES if n.name in scores})


def evaluate_levels(df: DataFrame, scores: dict[str, str]) -> DataFrame:
    """``(level, node, rows, loss, accuracy)`` for every scored node.

    All levels are measured side by side in one aggregate over the table; rows
    are not multiplied.
    """
    aggs, rows = [], []
    for node in NODES:
        if node.name not in scores:
            continue
        pred, loss = _node_result(node, scores)
        applies = F.col(node.label_column) != UNRESOLVED
        i = node.level
        aggs += [F.count_if(applies).alias(f"rows{i}"),
                 F.avg(F.when(applies, loss)).alias(f"loss{i}"),
                 F.count_if(applies & (pred == F.col(node.label_column))).alias(f"hits{i}")]
        rows.append(F.struct(
            F.lit(i).alias("level"), F.lit(node.name).alias("node"),
            F.col(f"rows{i}").alias("rows"),
            F.coalesce(F.col(f"loss{i}"), F.lit(0.0)).alias("loss"),
            _percent(F.col(f"hits{i}"), F.col(f"rows{i}")).alias("accuracy")))
    return _with_peaks(df, scores).agg(*aggs).select(F.inline(F.array(*rows)))


def level_report(df: DataFrame, scores: dict[str, str], node: Node) -> DataFrame:
    """Classification report of one node on the rows its level applies to."""
    pred = argmax(quoted(scores[node.name]))
    pairs = df.filter(F.col(node.label_column) != UNRESOLVED).select(
        F.col(node.label_column).alias("y_true"), pred.alias("y_pred"))
    return classification_report(pairs, "y_true", "y_pred", list(node.classes))


def level_reports(df: DataFrame, scores: dict[str, str]) -> DataFrame:
    """Reports of all scored nodes, with ``level`` and ``node``, from one pass over the rows."""
    counts = stage(
        level_pairs(df, scores).groupBy("level", "y_true", "y_pred").agg(
            F.count(F.lit(1)).alias("n")), "report-counts")
    found = []
    for node in NODES:
        if node.name in scores:
            report = report_of_counts(
                counts.filter(F.col("level") == node.level), list(node.classes))
            found.append(report.select(F.lit(node.level).alias("level"),
                                       F.lit(node.name).alias("node"), *report.columns))
    return functools.reduce(DataFrame.unionByName, found)


def leaf_index(leaf: Column) -> Column:
    """Leaf name to its index; -1 for a name that is no leaf."""
    index = {name: i for i, name in enumerate(LEAVES)}
    return lookup(leaf, index, UNRESOLVED).cast("int")


def known_leaves(df: DataFrame, leaf: str) -> DataFrame:
    """``y_true`` (leaf index) beside the other columns, for rows of a known class."""
    return df.withColumn("y_true", leaf_index(quoted(leaf))).filter(
        F.col("y_true") != UNRESOLVED)


def end_to_end_report(df: DataFrame, leaf: str, flat_pred: str = "flat_pred") -> DataFrame:
    """Report of the flat prediction over the 13 leaves; an unresolved row is wrong."""
    return classification_report(known_leaves(df, leaf), "y_true", flat_pred, LEAVES)
