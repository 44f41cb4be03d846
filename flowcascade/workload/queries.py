"""Every registered query: one callable ``(spark, sf_dir) -> DataFrame`` each.

Row-level results carry the line item's four id columns.  Doubles are rounded
here, not in the operators, so that both engines print the same digits.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcascade.functions import quoted, with_softmax
from flowcascade.operators import cascade as C
from flowcascade.operators import clean as K
from flowcascade.operators import evaluate as E
from flowcascade.operators import features as P
from flowcascade.operators import labels as L
from flowcascade.operators import roc as R
from flowcascade.operators import wide as W
from flowcascade.operators.bayes import GaussianBayes
from flowcascade.operators.sample import priority_sample
from flowcascade.plans import fit as T
from flowcascade.plans import scoring as S
from flowcascade.plans.prepare import level_datasets, prepare
from flowcascade.schema import LEAVES, NODES, node_of
from flowcascade.session import stage, stage_path, tune
from flowcascade.sources import (
    infer_numeric,
    load_models,
    load_state,
    read_flows,
    save_models,
    save_state,
    write_report,
)
from flowcascade.workload.views import (
    IDS,
    SCORES,
    STATISTICS,
    flows,
    labelled_flows,
    scored_flows,
    split_learnable,
    table,
    wide,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

DEDUP_COLUMNS = ["FlowDuration", "FwdIATMean", "FwdIATStd", "Label"]
CONSTANT = "Constant"


def query(run: Query) -> Query:
    @functools.wraps(run)
    def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        return run(spark, sf_dir)

    QUERIES[run.__name__] = tuned
    return run


def digits(c: Column, n: int) -> Column:
    """Round to ``n`` places in plain double arithmetic (``round`` goes through decimals)."""
    scale = F.lit(float(10 ** n))
    return F.floor(c * scale + F.lit(0.5)) / scale


def rounded(df: DataFrame, cols: list[str], n: int = 6) -> DataFrame:
    return K.map_columns(df, {c: digits(quoted(c), n) for c in cols})


# --- sources ---------------------------------------------------------------
@query
def flow_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the flows as CSV with padded names and an extra column; read them back."""
    path = stage_path(spark, "csv")
    padded = {"FlowDuration": " Flow Duration", "FlowBytes/s": "Flow Bytes/s",
              "FwdIATMean": " Fwd IAT Mean", "FwdIATStd": " Fwd IAT Std", "Label": " Label"}
    source = flows(spark, sf_dir).withColumn("Flow ID", F.lit("unread"))
    source.select(*[quoted(c).alias(padded.get(c, c)) for c in source.columns]).write.csv(
        path, header=True)
    read = read_flows(spark, path, keep=IDS)
    types = {c: "int" if c in ("l_linenumber", "Protocol") else "long" for c in [*IDS, "Protocol"]}
    return K.map_columns(read, {c: quoted(c).cast(t) for c, t in types.items()})


@query
def csv_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as CSV: quotes, commas and line breaks inside fields come back unchanged."""
    path = stage_path(spark, "breaks")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias(" Flow Duration"), F.col("text").alias("Note"),
        F.col("source").alias("Label"))
    docs.write.csv(path, header=True, escape='"', quoteAll=True,
                   ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    read = read_flows(spark, path, keep=["Note"], multi_line=True)
    return read.select("FlowDuration", F.md5("Note").alias("note"), "Label")


@query
def csv_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are too long are cut, short ones padded, missing texts are missing."""
    path = stage_path(spark, "malformed")
    key = F.col("event_id")
    lines = table(spark, sf_dir, "events").select(F.concat_ws(
        ",", key, F.when(key % 3 == 0, "NA").otherwise(F.col("user_id").cast("string")),
        F.when(key % 5 != 0, F.col("event_type")),
        F.when(key % 7 == 0, F.lit("extra"))).alias("line"))
    lines.write.text(f"{path}/body")
    body = spark.read.text(f"{path}/body").select("value")
    header = spark.range(1).select(F.lit(" Flow Duration,Fwd IAT Mean, Label").alias("value"))
    header.unionByName(body).coalesce(1).write.text(f"{path}/csv")
    return read_flows(spark, f"{path}/csv")


@query
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root's report, written as one CSV file and read again."""
    path = stage_path(spark, "report")
    write_report(E.level_report(scored_flows(spark, sf_dir), SCORES, NODES[0]), path)
    read = spark.read.csv(path, header=True, inferSchema=True)
    return rounded(read.withColumnRenamed("f1-score", "f1"), REPORT_DOUBLES)


@query
def flow_numeric_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which line-item and part columns are numeric, judged by their text alone."""
    found = []
    for name in ("lineitem", "part"):
        data = table(spark, sf_dir, name)
        text = data.select(*[quoted(c).cast("string").alias(c) for c in data.columns])
        numeric = set(infer_numeric(text))
        found += [(name, c, c in numeric) for c in data.columns]
    return spark.createDataFrame(found, "source string, column_name string, is_numeric boolean")


@query
def flow_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event payload texts as numbers: what is no number is missing, then 0."""
    text = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", F.col("event_type"))
        .otherwise(F.get_json_object("props", "$.k")).alias("payload"),
        F.when(F.col("event_type") == "view", "inf")
        .otherwise(F.col("value").cast("string")).alias("amount"))
    numbers = K.coerce_numeric(text, ["payload", "amount"])
    filled = K.zero_nonfinite(numbers, ["payload", "amount"]).withColumnsRenamed(
        {"payload": "payload_filled", "amount": "amount_filled"})
    both = filled.withColumns({"payload_missing": F.col("payload_filled") == 0.0})
    return both


@query
def flow_coerce_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What coercing made missing, before anything is filled."""
    text = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") == "click", F.col("event_type"))
        .otherwise(F.col("user_id").cast("string")).alias("number"))
    return K.coerce_numeric(text, ["number"]).withColumn("missing", F.col("number").isNull())


# --- cleaning --------------------------------------------------------------
@query
def flow_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.dedup(flows(spark, sf_dir).select(*DEDUP_COLUMNS))


@query
def flow_drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.drop_missing(flows(spark, sf_dir)).select(*IDS, "FwdIATStd", "Label")


@query
def flow_clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.clean_report(flows(spark, sf_dir).select(*DEDUP_COLUMNS))


@query
def prepare_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row counts that a preparation run brings with it."""
    _, state = prepare(spark, flows(spark, sf_dir).select(*DEDUP_COLUMNS), components=2,
                       accounting=True)
    return K.accounting_table(spark, state.accounting)


@query
def flow_impute_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are taken to be unknown and get the most frequent other type."""
    events = table(spark, sf_dir, "events").select(
        "event_id", F.nullif("event_type", F.lit("click")).alias("event_type"))
    return K.impute_mode(events, ["event_type"])


@query
def flow_iqr_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    fences = K.iqr_fences(flows(spark, sf_dir), ["Protocol", *STATISTICS])
    return rounded(K.fence_table(spark, fences), ["q1", "q3", "lower", "upper"])


@query
def wide_iqr_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences of fifty columns at a time."""
    return rounded(K.fence_table(spark, K.iqr_fences(wide(spark, sf_dir))),
                   ["q1", "q3", "lower", "upper"])


@query
def flow_winsorise(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = flows(spark, sf_dir)
    clipped = K.clip_to(data, K.iqr_fences(data, STATISTICS))
    return rounded(clipped.select(*IDS, *[quoted(c) for c in STATISTICS]), STATISTICS)


@query
def flow_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cleaning steps in order; the numeric ``Protocol`` is limited as well."""
    data = flows(spark, sf_dir).select("Protocol", *[quoted(c) for c in STATISTICS], "Label")
    cleaned, _ = K.clean(data)
    return rounded(cleaned, ["Protocol", *STATISTICS])


# --- features --------------------------------------------------------------
def _with_protocol_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = flows(spark, sf_dir)
    return P.one_hot(data, "Protocol", P.fit_one_hot(data, "Protocol"))


@query
def flow_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_protocol_flags(spark, sf_dir).select(
        *IDS, "Protocol_0", "Protocol_6", "Protocol_17")


@query
def flow_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = flows(spark, sf_dir).withColumn(CONSTANT, F.lit(5.0))
    cols = [*STATISTICS, CONSTANT]
    scaled = P.minmax_apply(data, P.fit_ranges(data, cols))
    return rounded(scaled.select(*IDS, *[quoted(c) for c in cols]), cols)


def _complete_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows without missing values, ids kept, so that every row stays identifiable."""
    return K.drop_missing(flows(spark, sf_dir)).drop("Timestamp")


@query
def flow_pca_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared length of every row in component space; all components are kept,
    so it equals the squared length of the centred scaled features."""
    data = _complete_flows(spark, sf_dir)
    width = len(STATISTICS) + 3
    state = P.fit_features(data, components=width, ignore=IDS)
    out = P.apply_features(data, state, keep=IDS)
    energy = sum((quoted(c) * quoted(c) for c in state.output_columns[1:]),
                 quoted(state.output_columns[0]) * quoted(state.output_columns[0]))
    return out.select(*IDS, digits(energy, 5).alias("energy"))


@query
def embedding_pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance of all components of the 64 embedding dimensions, and their share."""
    width = 64
    data = table(spark, sf_dir, "embeddings").select(
        *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(width)])
    ranges = P.fit_ranges(data, data.columns)
    unscaled = {c: P.Range(0.0, 1.0, r.mean) for c, r in ranges.items()}
    state = P.FeatureState({}, data.columns, unscaled, width)
    state.projection, state.explained = P.fit_projection(data, state.order, unscaled, width)
    out = P.apply_features(data, state, keep=[])
    total = sum((F.var_samp(c) for c in state.output_columns[1:]),
                F.var_samp(state.output_columns[0]))
    return out.agg(
        digits(total, 5).alias("total_variance"),
        F.lit(len(state.explained)).alias("components"),
        digits(F.lit(sum(state.explained)), 6).alias("ratio_sum"))


PAIR = ["FlowDuration", "FlowBytes/s"]


def _pair_state(spark: SparkSession, sf_dir: str, components: int) -> tuple[DataFrame, P.FeatureState]:
    data = _complete_flows(spark, sf_dir).select(*IDS, *[quoted(c) for c in PAIR], "Label")
    return data, P.fit_features(data, components, ignore=IDS)


@query
def flow_pca_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loadings and variance shares of both components of two features."""
    _, state = _pair_state(spark, sf_dir, 2)
    shares = P.explained_variance(state, table(spark, sf_dir, "region"))
    return rounded(P.loadings(state, spark).join(shares, "component"),
                   ["loading", "ratio", "cumulative"])


@query
def flow_pca_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of two components of every row; fewer are kept than there are features."""
    data, state = _pair_state(spark, sf_dir, 1)
    return rounded(P.apply_features(data, state, keep=IDS), state.output_columns)


@query
def flow_pca_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the components' variances and of their squares, for all seven features.

    Only in the eigenvectors' basis do the squares add up to those of the covariance matrix.
    """
    data = _complete_flows(spark, sf_dir)
    state = P.fit_features(data, components=len(STATISTICS) + 3, ignore=IDS)
    return _spectrum(P.apply_features(data, state, keep=IDS), state)


def _spectrum(out: DataFrame, state: P.FeatureState) -> DataFrame:
    variances = out.agg(F.array(*[F.var_samp(c) for c in state.output_columns]).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda t, x: t + x)
    squares = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    return variances.select(digits(total, 6).alias("variance"), digits(squares, 6).alias("squares"),
                            F.size("v").alias("components"))


@query
def embedding_pca_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of 64 min-max scaled embedding dimensions."""
    data = table(spark, sf_dir, "embeddings").select(
        *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    state = P.fit_features(data, components=64)
    return _spectrum(P.apply_features(data, state, keep=[]), state)


@query
def feature_state_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features fitted on three quarters of the orders, saved, loaded, applied to the rest."""
    data = _complete_flows(spark, sf_dir).select(*IDS, *[quoted(c) for c in PAIR], "Label")
    held_out = F.col("l_orderkey") % 4 == 0
    path = stage_path(spark, "state")
    save_state(spark, P.fit_features(data.filter(~held_out), 2, ignore=IDS), path)
    state = load_state(spark, path)
    return rounded(P.apply_features(data.filter(held_out), state, keep=[*IDS, "Label"]),
                   state.output_columns)


@query
def feature_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components as one float array per row, doubled by the caller's transform."""
    data, state = _pair_state(spark, sf_dir, 2)
    out = P.apply_features(data, state, keep=IDS, as_array=True,
                           transform=lambda c: F.transform(c, lambda x: x * 2))
    exact = F.col("features").cast("array<double>")
    return out.select(*IDS, F.typeof("features").alias("kind"),
                      *[digits(exact[i], 4).alias(f"f{i}") for i in range(2)])


@query
def flow_prepare_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of preparation on two features: distinct rows, limits, scaling, components, labels."""
    data = flows(spark, sf_dir).select(*[quoted(c) for c in PAIR], "Label")
    features, state = prepare(spark, data, components=2)
    return rounded(features, state.output_columns)


# --- labels ----------------------------------------------------------------
@query
def wide_label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order numbers as text labels: coded by a joined table and decoded again."""
    data = table(spark, sf_dir, "lineitem").select(
        *IDS, F.nullif(F.col("l_orderkey").cast("string"), F.lit("1")).alias("Label"))
    known = W.number_values(data.filter(F.col("l_linenumber") < 7), "Label")
    coded = W.encode_by_table(data, "Label", known)
    return W.decode_by_table(coded, "label_code", known, "decoded").drop("Label")


@query
def wide_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per order number, added up over sparse one-hot vectors."""
    data = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    known = W.number_values(data.filter(F.col("l_linenumber") < 7), "l_orderkey")
    vectors = W.one_hot_sparse(data, "l_orderkey", known, "v")
    return W.sum_vectors(vectors, "v", known.count()).withColumnRenamed("total", "rows")


@query
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = flows(spark, sf_dir).select(*IDS, "Label")
    mapping = L.fit_label_map(data, "Label")
    coded = L.encode_label(data, "Label", mapping)
    return L.decode_label(coded, "label_code", mapping, "decoded").drop("Label")


@query
def label_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric label column: codes come with a stored map and go through the leaf name."""
    data = table(spark, sf_dir, "lineitem").select(
        *IDS, (F.col("l_partkey") % 15).alias("Label"))
    stored = {leaf: i for i, leaf in enumerate(LEAVES)}
    named = L.resolve_leaf(data, "Label", stored)
    return L.hierarchical_labels(named, "leaf").drop("Label")


@query
def level_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_flows(spark, sf_dir).select(*IDS, "Label", *[n.label_column for n in NODES])


@query
def level_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.level_distribution(labelled_flows(spark, sf_dir))


@query
def level_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.level_sizes(labelled_flows(spark, sf_dir))


@query
def present_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.present_levels(labelled_flows(spark, sf_dir))


@query
def select_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.select_level(labelled_flows(spark, sf_dir), "3_drdos").select(
        *IDS, "Label", "level4")


# --- cascade ---------------------------------------------------------------
def _cascaded(spark: SparkSession, sf_dir: str, flat_probs: bool = False) -> DataFrame:
    return C.cascade(scored_flows(spark, sf_dir), SCORES, flat_probs)


@query
def cascade_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.prediction_columns(_cascaded(spark, sf_dir), IDS).drop("flat_pred")


@query
def cascade_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascaded(spark, sf_dir).select(
        *IDS, "flat_pred", C.leaf_name(F.col("flat_pred")).alias("flat_class"))


@query
def cascade_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits and probabilities of a routed node, masked where not routed."""
    record = F.col("node_2_dos")
    return _cascaded(spark, sf_dir).select(
        *IDS,
        *[digits(record["logits"][i], 6).alias(f"logit_{i}") for i in range(2)],
        *[digits(record["probs"][i], 6).alias(f"prob_{i}") for i in range(2)],
        record["pred"].alias("pred"))


@query
def cascade_records_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over logits and probabilities, and the decision, of every node's record."""
    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda t, x: t + x)
    return _cascaded(spark, sf_dir).select(*IDS, *[
        part for n in NODES for part in (
            digits(total(F.col(n.record)["logits"]), 5).alias(f"logits_{n.name}"),
            digits(F.element_at(F.col(n.record)["probs"], -1), 6).alias(f"last_{n.name}"),
            digits(total(F.col(n.record)["probs"]), 6).alias(f"probs_{n.name}"),
            F.col(n.record)["pred"].alias(f"pred_{n.name}"))])


@query
def cascade_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of every leaf."""
    return _cascaded(spark, sf_dir, flat_probs=True).select(
        *IDS, *[digits(F.col("flat_probs")[i], 6).alias(f"p{i}") for i in range(len(LEAVES))])


@query
def node_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node on all rows: true class, prediction and probabilities."""
    node = node_of(4)
    probs = F.col("probs")
    rows = L.select_level(scored_flows(spark, sf_dir), node.level)
    return with_softmax(rows, {"probs": (SCORES[node.name], node.width)}).select(
        *IDS, F.col(node.label_column).alias("y_true"),
        *[digits(probs[i], 6).alias(f"p{i}") for i in range(node.width)])


@query
def decision_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.decision_path(_cascaded(spark, sf_dir), IDS).drop("steps")


@query
def node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.node_counts(_cascaded(spark, sf_dir)), ["size"], 4)


# --- evaluation ------------------------------------------------------------
@query
def evaluate_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.evaluate_levels(scored_flows(spark, sf_dir), SCORES), ["loss", "accuracy"], 5)


@query
def level_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True and predicted class and loss of every row at every level that applies."""
    return rounded(E.level_pairs(scored_flows(spark, sf_dir), SCORES, IDS), ["loss"], 5)


@query
def log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = NODES[0]
    rows = L.select_level(scored_flows(spark, sf_dir), root.level)
    return rounded(E.log_loss(rows, SCORES["1"], root.label_column, root.width), ["loss"], 5)


@query
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.accuracy(table(spark, sf_dir, "labels"), "quality", "toxic"), ["accuracy"])


@query
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = E.known_leaves(_cascaded(spark, sf_dir), "Label")
    return E.confusion(known, "y_true", "flat_pred")


@query
def confusion_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = E.known_leaves(_cascaded(spark, sf_dir), "Label")
    return rounded(E.confusion_normalised(known, "y_true", "flat_pred"), ["share"])


@query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion_matrix(table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1])


@query
def confusion_matrix_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = E.confusion_matrix(
        table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1], normalise=True)
    return rounded(wide, ["p_0", "p_1"])


REPORT_DOUBLES = ["precision", "recall", "f1", "support"]


@query
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of the root node on its own predictions."""
    report = E.level_report(scored_flows(spark, sf_dir), SCORES, NODES[0])
    return rounded(report, REPORT_DOUBLES)


@query
def class_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all nodes on their own predictions."""
    return rounded(E.level_reports(scored_flows(spark, sf_dir), SCORES), REPORT_DOUBLES)


@query
def end_to_end_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.end_to_end_report(_cascaded(spark, sf_dir), "Label"), REPORT_DOUBLES)


def _root_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = NODES[0]
    probs = F.col("probs")
    rows = L.select_level(scored_flows(spark, sf_dir), root.level)
    # equal scores must be equal in both engines, so they are rounded before grouping
    return with_softmax(rows, {"probs": (SCORES["1"], root.width)}).select(
        F.col(root.label_column).alias("y_true"),
        F.array(*[digits(probs[i], 6) for i in range(root.width)]).alias("probs"))


@query
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = R.roc_points(_root_probabilities(spark, sf_dir), "y_true", "probs",
                          list(NODES[0].classes))
    return rounded(points, ["fpr", "tpr"])


@query
def roc_points_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = R.roc_points(_root_probabilities(spark, sf_dir), "y_true", "probs",
                          list(NODES[0].classes), drop_intermediate=False)
    return rounded(points, ["fpr", "tpr"])


@query
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = R.auc(_root_probabilities(spark, sf_dir), "y_true", "probs", list(NODES[0].classes))
    return rounded(areas, ["auc"])


@query
def roc_auc_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of the root with the true class as an array that has a 1 there."""
    rows = _root_probabilities(spark, sf_dir)
    encoded = F.array(*[(F.col("y_true") == i).cast("int") for i in range(NODES[0].width)])
    areas = R.auc(rows.withColumn("y_true", encoded), "y_true", "probs", list(NODES[0].classes))
    return rounded(areas, ["auc"])


def _all_probabilities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, str]]:
    """Probabilities of all nodes, rounded like those of the root alone."""
    rows = with_softmax(scored_flows(spark, sf_dir), {
        f"probs_{n.name}": (SCORES[n.name], n.width) for n in NODES})
    probs = {n.name: f"probs_{n.name}" for n in NODES}
    return rows.select(*[n.label_column for n in NODES], *[
        F.array(*[digits(F.col(c)[i], 6) for i in range(n.width)]).alias(c)
        for n, c in zip(NODES, probs.values())]), probs


@query
def roc_auc_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact areas of all classes of all nodes."""
    return rounded(R.auc_all(*_all_probabilities(spark, sf_dir)), ["auc"])


@query
def roc_auc_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds from histograms, and whether the exact area lies between them."""
    rows, probs = _all_probabilities(spark, sf_dir)
    rows = stage(rows, "probabilities")
    exact = R.auc_all(rows, probs).select("level", "class_code", "auc")
    bounds = R.auc_bounds(rows, probs, bins=64).join(exact, ["level", "class_code"])
    inside = F.col("auc").between(F.col("auc_low") - 1e-12, F.col("auc_high") + 1e-12)
    return rounded(bounds.withColumn("inside", inside).drop("auc"), ["auc_low", "auc_high"])


# --- fitting ---------------------------------------------------------------
@query
def fit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 500 rows per root class of the training rows, by hashed ids."""
    train, _ = split_learnable(spark, sf_dir)
    taken = priority_sample(train.select(*IDS, "level1"), "level1", 500, key=IDS)
    return rounded(taken, ["weight"])


@query
def level_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every node's training and validation table, read from the leaf folders."""
    found = []
    for level, tables in level_datasets(*split_learnable(spark, sf_dir)).items():
        for part, rows in zip(("train", "valid"), tables):
            found.append(rows.groupBy(
                F.lit(level).alias("level"), F.lit(part).alias("part"),
                F.col(f"level{level}").alias("class_code")).agg(
                F.count(F.lit(1)).alias("rows"), digits(F.sum("pca_component_1"), 3).alias("total")))
    return functools.reduce(DataFrame.unionByName, found)


@query
def bayes_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node fitted on its true rows; class and probabilities of the held-out ones."""
    train, valid = split_learnable(spark, sf_dir)
    model = T.fit_node(train, "3_drdos", GaussianBayes())
    found = S.predict(valid, {"3_drdos": model}, "3_drdos", with_probs=True, keep=IDS)
    probs = F.col("probs")
    return found.select(*IDS, "y_true", "y_pred",
                        *[digits(probs[i], 6).alias(f"p{i}") for i in range(8)])


@query
def bayes_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes fitted, saved, loaded again and run as a cascade over the held-out rows."""
    train, valid = split_learnable(spark, sf_dir)
    fitted = T.fit_bayes(train)
    path = stage_path(spark, "models")
    save_models(spark, fitted.models, path)
    out = S.predict_hierarchical(valid, load_models(spark, path), keep=IDS)
    return out.drop(*S.component_columns(out))


@query
def bayes_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss and accuracy of every fitted node on the held-out rows of its level."""
    train, valid = split_learnable(spark, sf_dir)
    scored, columns = S.score_all(valid, T.fit_bayes(train).models)
    return rounded(E.evaluate_levels(scored, columns), ["loss", "accuracy"], 5)


SMOOTHINGS = [0.5, 0.001, 0.01, 1e-9, 1e-6, 0.1]


@query
def bayes_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of choosing the smoothing of every node, measured side by side."""
    chosen = T.fit_cascade(level_datasets(*split_learnable(spark, sf_dir)),
                           [GaussianBayes(s) for s in SMOOTHINGS], patience=2)
    return rounded(T.history_table(spark, chosen.history),
                   ["train_loss", "val_loss", "train_acc", "val_acc"], 5)


# --- whole jobs (no SQL form) ----------------------------------------------
def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = flows(spark, sf_dir).select("Protocol", *[quoted(c) for c in STATISTICS], "Label")
    features, _ = prepare(spark, data, components=5)
    return stage(features, "prepared")


@query
def flow_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir)


@query
def prepared_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared rows per leaf, label code and level codes."""
    return _prepared(spark, sf_dir).groupBy(
        "leaf", "label_code", *[n.label_column for n in NODES]).agg(
        F.count(F.lit(1)).alias("rows"))


@query
def cascade_fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit all nodes on the prepared flows and score them."""
    data = _prepared(spark, sf_dir)
    fitted = T.fit_cascade(level_datasets(data, data, staged=False), [(0.001, 5)])
    return S.predict_hierarchical(data, fitted.models)


@query
def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of choosing the root classifier on the embeddings, read as leaf classes."""
    leaf = F.element_at(F.array(*[F.lit(x) for x in LEAVES]), F.col("label") + 1)
    data = table(spark, sf_dir, "embeddings").select(
        *[F.col("embedding")[i].cast("double").alias(f"pca_component_{i + 1}") for i in range(64)],
        leaf.alias("leaf"))
    rows = L.hierarchical_labels(data, "leaf")
    chosen = T.select_model(rows, rows, 1, [(0.001, 5), (0.001, 20), (0.1, 20)], patience=2)
    return T.history_table(spark, chosen.history)
