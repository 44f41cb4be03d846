"""SQL counterpart of every query that has one, for DuckDB on the same tables."""

from __future__ import annotations

from flowcascade.schema import LEAVES, NODES, Node, leaf_paths, node_of
from flowcascade.workload.views import LEARNABLE_PARTS, WIDE, WIDE_SQL, with_views

IDS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
STATISTICS = ["FlowDuration", "FlowBytes/s", "FwdIATMean", "FwdIATStd"]
ALL_LEAVES = ", ".join(f"'{x}'" for x in LEAVES)


def q(name: str) -> str:
    return f'"{name}"'


def union(parts: list[str]) -> str:
    return "\nunion all ".join(parts)


def case_names(column: str, names) -> str:
    whens = " ".join(f"when {i} then '{n}'" for i, n in enumerate(names))
    return f"case {column} {whens} end"


# --- cleaning --------------------------------------------------------------
def fence_columns(cols: list[str], source: str) -> str:
    parts = []
    for c in cols:
        parts.append(f"quantile_cont({q(c)}::double, 0.25) as {q('a_' + c)}, "
                     f"quantile_cont({q(c)}::double, 0.75) as {q('b_' + c)}")
    return f"fences as (select {', '.join(parts)} from {source})"


def clipped(c: str) -> str:
    a, b = q("a_" + c), q("b_" + c)
    return (f"round(case when {q(c)} is null then null else least(greatest({q(c)}::double, "
            f"{a} - 3 * ({b} - {a})), {b} + 3 * ({b} - {a})) end, 6) as {q(c)}")


DEDUP = '"FlowDuration", "FwdIATMean", "FwdIATStd", "Label"'

_fence_rows = union([
    f"select '{c}' as feature, round(q1, 6) as q1, round(q3, 6) as q3, "
    f"round(q1 - 3 * (q3 - q1), 6) as lower, round(q3 + 3 * (q3 - q1), 6) as upper from "
    f"(select quantile_cont({q(c)}::double, 0.25) as q1, "
    f"quantile_cont({q(c)}::double, 0.75) as q3 from flows)"
    for c in ["Protocol", *STATISTICS]])

_inference = union([
    f"select '{source}' as source, '{c}' as column_name, "
    f"count(*) filter (where try_cast({c}::varchar as double) is null and {c} is not null) = 0 "
    f"as is_numeric from {source}"
    for source, cols in {
        "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                     "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                     "l_shipdate"],
        "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    }.items() for c in cols])

# --- features --------------------------------------------------------------
_minmax = ", ".join(
    f"round(({q(c)} - min({q(c)}) over ()) / (case when max({q(c)}) over () = min({q(c)}) over () "
    f"then 1 else max({q(c)}) over () - min({q(c)}) over () end), 6) as {q(c)}"
    for c in [*STATISTICS, "Constant"])

_flags = [f"case when \"Protocol\" = {v} then 1.0::double else 0.0::double end as p{v}"
          for v in (0, 6, 17)]
_energy_inputs = [*[q(c) for c in STATISTICS], "p0", "p6", "p17"]
_energy = " + ".join(
    f"pow(({c} - avg({c}) over ()) / (case when max({c}) over () = min({c}) over () then 1 "
    f"else max({c}) over () - min({c}) over () end), 2)" for c in _energy_inputs)

# --- cascade ---------------------------------------------------------------
def softmax_item(node: Node, i: int) -> str:
    return f"e_{node.name}[{i + 1}] / list_sum(e_{node.name})"


_leaf_probs = ", ".join(
    "round(" + " * ".join(f"({softmax_item(n, code)})" for n, code in leaf_paths()[leaf])
    + f", 6) as p{i}" for i, leaf in enumerate(LEAVES))


def level_text(node: Node) -> str:
    names = case_names(f"pred_{node.name}", [node.display(c) for c in node.classes])
    return f"'Level {node.depth}: ' || {names}"


_path = "concat_ws(' -> ', " + ", ".join(level_text(n) for n in NODES) + ")"
_n_steps = " + ".join(f"(pred_{n.name} >= 0)::int" for n in NODES)

_tree = [("Root", None, 0, "true")] + [
    (n.display(c), n.parent_class or "Root", n.depth, f"pred_{n.name} = {code}")
    for n in NODES for code, c in enumerate(n.classes)]
_node_counts = union([
    f"select '{name}' as node, {'null::varchar' if parent is None else repr(parent)} as parent, "
    f"{depth} as depth, count(*) filter (where {hit}) as n, "
    f"round(1000.0::double * (count(*) filter (where {hit}) + 1) / (count(*) + 1), 4) as size "
    f"from predicted" for name, parent, depth, hit in _tree])

# --- evaluation ------------------------------------------------------------
def node_loss(n: Node) -> str:
    s = f"scores_{n.name}"
    return f"(list_max({s}) + ln(list_sum(e_{n.name})) - {s}[{n.label_column} + 1])"


_levels = union([
    f"select {n.level} as level, '{n.name}' as node, count(*) as rows, "
    f"round(coalesce(avg({node_loss(n)}), 0), 5) as loss, "
    f"round(coalesce(100.0 * count(*) filter (where own_{n.name} = {n.label_column}) "
    f"/ nullif(count(*), 0), 0)::double, 5) as accuracy "
    f"from own where {n.label_column} <> -1" for n in NODES])

_known = (f"known as (select list_position([{ALL_LEAVES}], \"Label\") - 1 as y_true, flat_pred "
          f"from predicted where \"Label\" in ({ALL_LEAVES}))")


def report(pairs: str, names) -> str:
    """Report over ``pairs(y_true, y_pred)``; per-class counts, then summary rows."""
    table = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
    return f"""
, classes(code, name) as (values {table}),
counts as (
  select code, name,
         (select count(*) from {pairs} where y_true = code and y_pred = code)::double as hit,
         (select count(*) from {pairs} where y_pred = code)::double as predicted_n,
         (select count(*) from {pairs} where y_true = code)::double as support
  from classes),
measures as (
  select name, support, hit,
         coalesce(hit / nullif(predicted_n, 0), 0) as p,
         coalesce(hit / nullif(support, 0), 0) as r,
         coalesce(2 * hit / nullif(predicted_n + support, 0), 0) as f
  from counts),
overall as (select count(*) filter (where y_true = y_pred)::double / count(*) as acc from {pairs})
select name as class, round(p, 6) as precision, round(r, 6) as recall, round(f, 6) as f1,
       support from measures
union all select 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), round(acc, 6)
  from overall
union all select 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(support)
  from measures
union all select 'weighted avg', round(sum(p * support) / sum(support), 6),
  round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6),
  sum(support) from measures
"""


_root = node_of(1)
_per_score = f"""
rooted as (select level1 as y_true, [{', '.join(
    f'round({softmax_item(_root, i)}, 6)' for i in range(_root.width))}] as probs
  from own where level1 <> -1),
per_score as (
  select class_code, score, count(*) filter (where y_true = class_code) as pos,
         count(*) filter (where y_true <> class_code) as neg
  from (select y_true, unnest([0, 1, 2]) as class_code, unnest(probs) as score from rooted)
  group by all),
curve as (
  select *, sum(pos) over falling as tp, sum(neg) over falling as fp,
         sum(pos) over whole as positives, sum(neg) over whole as negatives,
         lead(pos) over falling as next_pos, lead(neg) over falling as next_neg,
         row_number() over falling as nth
  from per_score
  window falling as (partition by class_code order by score desc),
         whole as (partition by class_code))
"""
_class = case_names("class_code", _root.classes)


def _points(condition: str) -> str:
    return f"""
select class_code, {_class} as class, score as threshold,
       round(fp::double / negatives, 6) as fpr, round(tp::double / positives, 6) as tpr
from curve where {condition}
union all select class_code, {_class}, 'inf'::double, 0.0::double, 0.0::double
from curve where nth = 1
"""


ORACLE: dict[str, str] = {
    # sources
    "flow_csv_scan": with_views("flows", "select * from flows"),
    "flow_numeric_inference": _inference,
    "flow_coerce": """
        select event_id,
               case when event_type = 'error' then 0.0
                    else coalesce(try_cast(json_extract_string(props, '$.k') as double), 0.0) end
                 as payload_filled,
               case when event_type = 'view' then 0.0 else value end as amount_filled,
               payload_filled = 0 as payload_missing
        from events""",
    # cleaning
    "flow_dedup": with_views("flows", f"select distinct {DEDUP} from flows"),
    "flow_drop_missing": with_views(
        "flows", f"select {IDS}, \"FwdIATStd\", \"Label\" from flows where \"FwdIATStd\" is not null"),
    "flow_clean_report": with_views("flows", """
        select 'input' as step, (select count(*) from flows) as rows, 0::bigint as removed
        union all select 'dedup', (select count(*) from unique_flows),
          (select count(*) from flows) - (select count(*) from unique_flows)
        union all select 'drop_missing',
          (select count(*) from unique_flows where "FwdIATStd" is not null),
          (select count(*) from unique_flows where "FwdIATStd" is null)""",
        f"unique_flows as (select distinct {DEDUP} from flows)"),
    "flow_impute_mode": """
        with kept as (select event_id, nullif(event_type, 'click') as event_type from events)
        select event_id, coalesce(event_type, (
          select event_type from kept where event_type is not null
          group by event_type order by count(*) desc, event_type limit 1)) as event_type
        from kept""",
    "flow_iqr_fences": with_views("flows", _fence_rows),
    "flow_winsorise": with_views(
        "flows", f"select {IDS}, {', '.join(clipped(c) for c in STATISTICS)} "
                 "from flows, fences", fence_columns(STATISTICS, "flows")),
    "flow_clean": with_views(
        "flows",
        f"select {', '.join(clipped(c) for c in ['Protocol', *STATISTICS])}, \"Label\" "
        "from kept, fences",
        "kept as (select distinct \"Protocol\", "
        + ", ".join(q(c) for c in STATISTICS)
        + ", \"Label\" from flows where \"FwdIATStd\" is not null),\n"
        + fence_columns(["Protocol", *STATISTICS], "kept")),
    # features
    "flow_one_hot": with_views("flows", f"""
        select {IDS}, ("Protocol" = 0)::int::double as "Protocol_0",
               ("Protocol" = 6)::int::double as "Protocol_6",
               ("Protocol" = 17)::int::double as "Protocol_17" from flows"""),
    "flow_minmax": with_views(
        "flows", f"select {IDS}, {_minmax} from (select *, 5.0::double as \"Constant\" from flows)"),
    "flow_pca_energy": with_views(
        "flows", f"select {IDS}, round({_energy}, 5) as energy from complete",
        f"complete as (select *, {', '.join(_flags)} from flows where \"FwdIATStd\" is not null)"),
    "embedding_pca_variance": """
        select round(sum(v), 5) as total_variance, 64::int as components, 1.0::double as ratio_sum
        from (select i, var_samp(x) as v from (
          select unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i
          from embeddings) group by i)""",
    # labels
    "label_encode": with_views("flows", f"""
        select {IDS}, (dense_rank() over (order by "Label") - 1)::int as label_code,
               "Label" as decoded from flows"""),
    "label_numeric": None,      # filled in below
    "level_labels": with_views(
        "labelled", f"select {IDS}, \"Label\", level1, level2, level3, level4, level5 from labelled"),
    "level_distribution": with_views("labelled", union([
        f"select {n.level} as level, '{n.name}' as node, {n.label_column} as class_code, "
        f"{case_names(n.label_column, n.classes)} as class_name, count(*) as rows "
        f"from labelled where {n.label_column} <> -1 group by all" for n in NODES])),
    "level_sizes": with_views("labelled", union([
        f"select {n.level} as level, '{n.name}' as node, count(*) as rows, "
        f"count(distinct {n.label_column}) as classes "
        f"from labelled where {n.label_column} <> -1" for n in NODES])),
    "present_levels": with_views("labelled", union([
        f"select {n.level} as level, '{n.name}' as node, max({n.label_column}) > -1 as present "
        "from labelled" for n in NODES])),
    "select_level": with_views(
        "labelled", f"select {IDS}, \"Label\", level4 from labelled where level4 <> -1"),
    # cascade
    "cascade_preds": with_views(
        "routed", f"select {IDS}, {', '.join('pred_' + n.name for n in NODES)} from routed"),
    "cascade_flat": with_views(
        "predicted", f"select {IDS}, flat_pred, {case_names('flat_pred', LEAVES)} as flat_class "
                     "from predicted"),
    "cascade_records": with_views("routed", f"""
        select {IDS},
               case when pred_2_dos = -1 then -1000.0 else round(scores_2_dos[1], 6) end as logit_0,
               case when pred_2_dos = -1 then -1000.0 else round(scores_2_dos[2], 6) end as logit_1,
               case when pred_2_dos = -1 then 0.0
                    else round({softmax_item(node_of(2), 0)}, 6) end as prob_0,
               case when pred_2_dos = -1 then 0.0
                    else round({softmax_item(node_of(2), 1)}, 6) end as prob_1,
               pred_2_dos as pred
        from routed"""),
    "cascade_probs": with_views("own", f"select {IDS}, {_leaf_probs} from own"),
    "node_softmax": with_views(
        "own", f"select {IDS}, level4 as y_true, "
        + ", ".join(f"round({softmax_item(node_of(4), i)}, 6) as p{i}" for i in range(8))
        + " from own where level4 <> -1"),
    "decision_paths": with_views(
        "routed", f"select {IDS}, {_n_steps} as n_steps, {_path} as path from routed"),
    "node_counts": with_views("predicted", _node_counts),
    # evaluation
    "evaluate_levels": with_views("own", _levels),
    "level_pairs": with_views("own", union([
        f"select {IDS}, {n.level} as level, '{n.name}' as node, {n.label_column} as y_true, "
        f"own_{n.name} as y_pred, round({node_loss(n)}, 5) as loss "
        f"from own where {n.label_column} <> -1" for n in NODES])),
    "log_loss": with_views(
        "own", f"select count(*) as rows, round(avg({node_loss(_root)}), 5) as loss "
               "from own where level1 <> -1"),
    "accuracy": """
        select count(*) as rows, count(*) filter (where quality = toxic) as correct,
               round(100.0::double * count(*) filter (where quality = toxic) / count(*), 6)
                 as accuracy from labels""",
    "confusion_counts": with_views(
        "predicted", "select y_true, flat_pred as y_pred, count(*) as n from known group by all",
        _known),
    "confusion_normalised": with_views("predicted", """
        select y_true, y_pred, n, round(n / (sum(n) over (partition by y_true) + 1e-10), 6) as share
        from (select y_true, flat_pred as y_pred, count(*) as n from known group by all)""",
        _known),
    "confusion_matrix": """
        select c as y_true, (select count(*) from labels where quality = c and toxic = 0) as p_0,
               (select count(*) from labels where quality = c and toxic = 1) as p_1
        from (select unnest([0, 1]) as c)""",
    "confusion_matrix_normalised": """
        select c as y_true, round(p0 / (p0 + p1 + 1e-10), 6) as p_0,
               round(p1 / (p0 + p1 + 1e-10), 6) as p_1
        from (select c,
                (select count(*) from labels where quality = c and toxic = 0)::double as p0,
                (select count(*) from labels where quality = c and toxic = 1)::double as p1
              from (select unnest([0, 1]) as c))""",
    "class_report": with_views("own", report("pairs", _root.classes),
                               "pairs as (select level1 as y_true, own_1 as y_pred from own "
                               "where level1 <> -1)"),
    "end_to_end_report": with_views("predicted", report("pairs", LEAVES),
                                    _known + ",\npairs as (select y_true, flat_pred as y_pred "
                                             "from known)"),
    "roc_points": with_views("own", _points(
        "nth = 1 or next_pos is null or next_pos <> pos or next_neg <> neg"), _per_score),
    "roc_points_all": with_views("own", _points("true"), _per_score),
    "roc_auc": with_views("own", f"""
        select class_code, {_class} as class, max(positives)::bigint as positives,
               max(negatives)::bigint as negatives,
               round(sum(neg * (tp - pos / 2.0::double)) / (max(positives)::double
                 * max(negatives)::double), 6) as auc
        from curve group by class_code""", _per_score),
}


def _numeric_label() -> str:
    code = "(l_partkey % 15)::int"
    levels = []
    for n in NODES:
        whens = " ".join(
            f"when {LEAVES.index(leaf)} then {dict(path)[n]}"
            for leaf, path in leaf_paths().items() if n in dict(path))
        levels.append(f"case {code} {whens} else -1 end as {n.label_column}")
    return (f"select {IDS}, {code} as label_code, {case_names(code, LEAVES)} as leaf, "
            f"{', '.join(levels)} from lineitem")


ORACLE["label_numeric"] = _numeric_label()
ORACLE["prepared_labels"] = with_views(
    "labelled", """
    select "Label" as leaf, (dense_rank() over (order by "Label") - 1)::int as label_code,
           level1, level2, level3, level4, level5, count(*) as rows
    from (select distinct "Protocol", "FlowDuration", "FlowBytes/s", "FwdIATMean", "FwdIATStd",
                 "Label", level1, level2, level3, level4, level5
          from labelled where "FwdIATStd" is not null)
    group by "Label", level1, level2, level3, level4, level5""")


# --- fitting ---------------------------------------------------------------
INPUTS = ("x1", "x2", "x3")
SMOOTHINGS = (0.5, 0.001, 0.01, 1e-9, 1e-6, 0.1)     # in the order in which they are tried


def learnable(extra: list[tuple[str, str]], body: str) -> str:
    return "with " + ",\n".join(
        f"{name} as ({sql})" for name, sql in [*LEARNABLE_PARTS, *extra]) + "\n" + body


def bayes_parts(node: Node, smoothing: str = "1e-9") -> list[tuple[str, str]]:
    """Moments per class of the training rows, and scores of all classes on every row."""
    k, c = node.level, node.label_column
    moments = ", ".join(f"avg({x}) as m_{x}, var_pop({x}) as v_{x}" for x in INPUTS)
    widest = ", ".join(f"var_pop({x})" for x in INPUTS)
    terms = " + ".join(
        f"-0.5 * (ln(2 * pi() * (v_{x} + s)) + (r.{x} - m_{x}) * (r.{x} - m_{x}) / (v_{x} + s))"
        for x in INPUTS)
    fitted = f"from labelled where not held_out and {c} >= 0"
    return [
        (f"class{k}", f"select {c} as code, count(*) as n, {moments} {fitted} group by 1"),
        (f"all{k}", f"select count(*) as total, {smoothing} * greatest({widest}) as s {fitted}"),
        (f"parts{k}", f"""
  select r.row_id, code, ln(n / total) + {terms} as score
  from labelled r, class{k}, all{k}"""),
        (f"scores{k}", f"""
  select row_id, list(score order by code) as score, list(code order by code) as codes
  from parts{k} group by row_id"""),
    ]


def own_class(k: int) -> str:
    return f"s{k}.codes[list_position(s{k}.score, list_max(s{k}.score))]"


_drdos = node_of("3_drdos")
_shares = ", ".join(
    f"round(e[{i + 1}] / list_sum(e), 6) as p{i}" for i in range(_drdos.width))
_classified = [part for n in NODES for part in bayes_parts(n)] + [("own", "select l.*, " + ", ".join(
    f"{own_class(n.level)} as own_{n.name}" for n in NODES) + " from labelled l " + " ".join(
    f"join scores{n.level} s{n.level} using (row_id)" for n in NODES) + " where held_out")]


def _routed() -> list[tuple[str, str]]:
    from flowcascade.workload.views import FLAT_SQL, ROUTED_SQL
    return [("routed", ROUTED_SQL), ("predicted", FLAT_SQL)]


def _measured(node: Node, smoothing: str = "1e-9") -> str:
    """Loss and hits per row of one node, on all rows of its level."""
    k, c = node.level, node.label_column
    peak = f"list_max(s{k}.score)"
    return f"""
select held_out, {peak} + ln(list_sum(list_transform(s{k}.score, lambda x: exp(x - {peak}))))
       - s{k}.score[list_position(s{k}.codes, {c})] as loss, {own_class(k)} = {c} as hit
from labelled join scores{k} s{k} using (row_id) where {c} >= 0"""


def _selection(patience: int = 2) -> str:
    """All rounds of all nodes, cut where ``patience`` rounds in a row were no better."""
    found = []
    for node in NODES:
        for number, smoothing in enumerate(SMOOTHINGS, 1):
            inner = ",\n".join(f"{name} as ({sql})"
                               for name, sql in bayes_parts(node, repr(smoothing)))
            found.append(f"""
select * from (with {inner}
select {node.level} as level, {number} as round,
       avg(loss) filter (not held_out) as train_loss, avg(loss) filter (held_out) as val_loss,
       100.0 * avg(hit::int) filter (not held_out) as train_acc,
       100.0 * avg(hit::int) filter (held_out) as val_acc
from ({_measured(node)}))""")
    before = "over (partition by level order by round rows between unbounded preceding and 1 preceding)"
    return learnable([
        ("tried", union(found)),
        ("ranked", f"select *, coalesce(val_loss < min(val_loss) {before}, true) as better from tried"),
        ("runs", "select *, round - coalesce(max(case when better then round end) over "
                 "(partition by level order by round), 0) as stale from ranked"),
        ("ended", f"select level, min(round) as last from runs where stale >= {patience} "
                  "group by level")],
        "select r.level, round, " + ", ".join(
            f"round({c}, 5) as {c}" for c in ("train_loss", "val_loss", "train_acc", "val_acc"))
        + " from runs r left join ended e on r.level = e.level "
          "where round <= coalesce(last, 1000000)")


ORACLE |= {
    "level_tables": learnable([], union([
        f"select {n.level} as level, case when held_out then 'valid' else 'train' end as part, "
        f"{n.label_column} as class_code, count(*) as rows, round(sum(x), 3) as total "
        f"from (select *, quantity / 10 as x from labelled) where {n.label_column} >= 0 group by all" for n in NODES])),
    "bayes_predict": learnable(bayes_parts(_drdos), f"""
select {IDS}, level4 as y_true, {own_class(4)} as y_pred, {_shares}
from (select l.*, score, codes, list_transform(score, lambda x: exp(x - list_max(score))) as e
      from labelled l join scores4 using (row_id) where held_out and level4 >= 0) s4"""),
    "bayes_cascade": learnable(_classified + _routed(), f"""
select {IDS}, "Label" as leaf, {', '.join(f'pred_{n.name}' for n in NODES)}, flat_pred
from predicted"""),
    "bayes_evaluation": learnable([part for n in NODES for part in bayes_parts(n)], union([
        f"select {n.level} as level, '{n.name}' as node, count(*) as rows, "
        f"round(avg(loss), 5) as loss, round(100.0 * avg(hit::int), 5) as accuracy "
        f"from ({_measured(n)}) where held_out" for n in NODES])),
    "bayes_selection": _selection(),
}


# --- principal components --------------------------------------------------
def pair_parts(source: str, fit: str = "true") -> list[tuple[str, str]]:
    """Two scaled features ``x`` and ``y``, and the closed form of their components.

    ``source`` gives columns ``a`` and ``b``; components are fitted on its rows ``fit``.
    """
    return [
        ("source", source),
        ("extent", "select " + ", ".join(
            f"min({c}) as lo_{c}, coalesce(nullif(max({c}) - min({c}), 0), 1) as d_{c}, "
            f"avg({c}) as m_{c}" for c in "ab") + f" from source where {fit}"),
        ("scaled", "select s.*, (a - m_a) / d_a as x, (b - m_b) / d_b as y from source s, extent"),
        ("cov", "select var_samp(x) as p, covar_samp(x, y) as q, var_samp(y) as r "
                f"from scaled where {fit}"),
        ("roots", "select *, (p + r + sqrt((p - r) * (p - r) + 4 * q * q)) / 2 as e1, "
                  "(p + r - sqrt((p - r) * (p - r) + 4 * q * q)) / 2 as e2 from cov"),
        ("raw", "select *, q / sqrt(q * q + (e1 - p) * (e1 - p)) as u, "
                "(e1 - p) / sqrt(q * q + (e1 - p) * (e1 - p)) as v from roots"),
        # the largest absolute loading of a component is positive
        ("turned", "select *, case when (abs(u) >= abs(v) and u < 0) or (abs(u) < abs(v) and v < 0) "
                   "then -1 else 1 end as s1, case when (abs(v) >= abs(u) and -v < 0) or "
                   "(abs(v) < abs(u) and u < 0) then -1 else 1 end as s2 from raw"),
        ("axes", "select *, s1 * u as u1, s1 * v as v1, s2 * -v as u2, s2 * u as v2 from turned"),
    ]


def pair_query(source: str, body: str, fit: str = "true",
               before: list[tuple[str, str]] = ()) -> str:
    parts = ", ".join(f"{n} as ({sql})" for n, sql in [*before, *pair_parts(source, fit)])
    return with_views("flows", body, parts)


def spectrum_query(values: list[str], source: str) -> str:
    """Trace and squared entries of the covariance of min-max scaled columns."""
    n = range(len(values))
    extent = ", ".join(f"min({v}) as lo{i}, coalesce(nullif(max({v}) - min({v}), 0), 1) as d{i}"
                       for i, v in zip(n, values))
    scaled = ", ".join(f"({v} - lo{i}) / d{i} as x{i}" for i, v in zip(n, values))
    trace = f"list_sum([{', '.join(f'var_samp(x{i})' for i in n)}])"
    entries = ", ".join(f"{1 if i == j else 2} * power(covar_samp(x{i}, x{j}), 2)"
                        for i in n for j in n if j >= i)
    squares = f"list_sum([{entries}])"
    return (f"select round({trace}, 6) as variance, round({squares}, 6) as squares, "
            f"{len(values)} as components from (select {scaled} from {source}, "
            f"(select {extent} from {source}))")


_complete = 'from flows where "FwdIATStd" is not null'
_pair = f'select {IDS}, "Label", "FlowDuration"::double as a, "FlowBytes/s"::double as b {_complete}'
_both = 'round(x * u1 + y * v1, 6) as pca_component_1, round(x * u2 + y * v2, 6) as pca_component_2'
_leaf_levels = ", ".join(
    "case " + " ".join(f"when \"Label\" = '{leaf}' then {code}"
                       for leaf, path in leaf_paths().items() for m, code in path if m == n)
    + f" else -1 end as {n.label_column}" for n in NODES)

ORACLE |= {
    "flow_pca_loadings": pair_query(_pair, "select component, feature, round(loading, 6) as loading, "
        "round(ratio, 6) as ratio, round(cumulative, 6) as cumulative from (" + union([
            f"select {k} as component, '{f}' as feature, {w}{k} as loading, "
            f"e{k} / (e1 + e2) as ratio, {'1.0' if k == 2 else 'e1 / (e1 + e2)'} as cumulative from axes"
            for k in (1, 2) for f, w in (("FlowDuration", "u"), ("FlowBytes/s", "v"))]) + ")"),
    "flow_pca_first": pair_query(
        _pair, f"select {IDS}, round(x * u1 + y * v1, 6) as pca_component_1 from scaled, axes"),
    "flow_pca_spectrum": with_views("flows", spectrum_query(
        [q(c) for c in STATISTICS] + [f'("Protocol" = {p})::int' for p in (0, 6, 17)],
        f"(select * {_complete})")),
    "embedding_pca_spectrum": spectrum_query(
        [f"embedding[{i + 1}]::double" for i in range(64)], "embeddings"),
    "feature_state_round_trip": pair_query(
        _pair, f'select {IDS}, "Label", {_both} from scaled, axes where l_orderkey % 4 = 0',
        "l_orderkey % 4 <> 0"),
    "flow_prepare_pair": pair_query(
        'select "Label", least(greatest(o, o1 - 3 * (o3 - o1)), o3 + 3 * (o3 - o1)) as a, '
        "least(greatest(t, t1 - 3 * (t3 - t1)), t3 + 3 * (t3 - t1)) as b from kept, limits",
        f"""
select {_both}, "Label" as leaf, label_code, {_leaf_levels}
from scaled join codes using ("Label"), axes""",
        before=[
            ("kept", 'select distinct "FlowDuration"::double as o, "FlowBytes/s"::double as t, '
                     '"Label" from flows'),
            ("limits", "select " + ", ".join(
                f"quantile_cont({c}, {p}) as {c}{i}" for c in "ot" for i, p in ((1, 0.25), (3, 0.75)))
             + " from kept"),
            ("codes", 'select "Label", (row_number() over (order by "Label") - 1)::int as label_code '
                      'from (select distinct "Label" from kept)')]),
}

_wide_limits = ", ".join(f"quantile_cont({c}, {p}) as {c}_{i}"
                         for c in WIDE for i, p in ((1, 0.25), (3, 0.75)))
ORACLE["wide_iqr_fences"] = f"with w as ({WIDE_SQL}), z as (select {_wide_limits} from w)\n" + union([
    f"select '{c}' as feature, round({c}_1, 6) as q1, round({c}_3, 6) as q3, "
    f"round({c}_1 - 3 * ({c}_3 - {c}_1), 6) as lower, "
    f"round({c}_3 + 3 * ({c}_3 - {c}_1), 6) as upper from z" for c in WIDE])


# --- all nodes, samples ----------------------------------------------------
_every_score = union([
    f"select {n.level} as level, '{n.name}' as node, {code} as class_code, '{cls}' as class, "
    f"{n.label_column} = {code} as hit, "
    f"round(e_{n.name}[{code + 1}] / list_sum(e_{n.name}), 6) as score "
    f"from own where {n.label_column} >= 0" for n in NODES for code, cls in enumerate(n.classes)])
_totals = """totals as (
    select level, node, class_code, class, count(*) filter (hit) as positives,
           count(*) filter (not hit) as negatives from every group by all)"""
_exact = """exact as (
    select level, class_code,
           sum(case when hit then mid end) as ranks, count(*) filter (hit) as p,
           count(*) filter (not hit) as n
    from (select *, rank() over (partition by level, class_code order by score)
                 + (count(*) over (partition by level, class_code, score) - 1) / 2.0::double as mid
          from every)
    group by all)"""
_area = "(ranks - p * (p + 1) / 2.0::double) / nullif(p::double * n::double, 0)"
_bins = """binned as (
    select level, class_code, least(floor(score * 64), 63) as bin,
           count(*) filter (hit) as pos, count(*) filter (not hit) as neg
    from every group by all),
stacked as (
    select *, coalesce(sum(neg) over (partition by level, class_code order by bin
                       rows between unbounded preceding and 1 preceding), 0) as under
    from binned),
bounds as (
    select level, class_code, sum(pos::double * under) as sure, sum(pos::double * neg) as unsure,
           sum(pos)::double * sum(neg)::double as pairs
    from stacked group by all)"""
ORACLE |= {
    "roc_auc_nodes": with_views("own", f"""
select t.*, round({_area}, 6) as auc from totals t join exact using (level, class_code)""",
        f"every as ({_every_score}), {_totals}, {_exact}"),
    "roc_auc_bounds": with_views("own", """
select t.*, round(sure / nullif(pairs, 0), 6) as auc_low,
       round((sure + unsure) / nullif(pairs, 0), 6) as auc_high,
       case when pairs > 0 then true end as inside
from totals t join bounds using (level, class_code)""",
        f"every as ({_every_score}), {_totals}, {_bins}"),
    "fit_sample": learnable([
        ("ranked", f"""
  select {IDS}, level1, copies, sum(copies) over (partition by level1) as n,
         coalesce(sum(copies) over (partition by level1 order by
           ('0x' || substr(md5(concat_ws('|', {IDS})), 1, 15))::bigint
           rows between unbounded preceding and 1 preceding), 0) as before
  from (select {IDS}, level1, count(*) as copies from labelled where not held_out group by all)
  """)], f"""
select {IDS}, level1, round(least(copies, 500 - before) * n / least(n, 500), 6) as weight
from ranked where before < 500"""),
}

ORACLE |= {
    "prepare_accounting": ORACLE["flow_clean_report"],
    "wide_label_codes": f"""
with l as (select {IDS}, nullif(l_orderkey::varchar, '1') as label from lineitem),
codes as (select label, row_number() over (order by label) - 1 as code
          from (select distinct label from l where l_linenumber < 7 and label is not null))
select {IDS}, coalesce(code, -1) as label_code, c.label as decoded
from l left join codes c using (label)""",
    "wide_one_hot": """
with known as (select l_orderkey, row_number() over (order by l_orderkey) - 1 as code
               from (select distinct l_orderkey from lineitem where l_linenumber < 7))
select code::int as code, count(*)::double as rows
from lineitem join known using (l_orderkey) group by code""",
}


# --- rows for what had unit tests only -------------------------------------
def _records() -> str:
    parts = []
    for n in NODES:
        off = f"pred_{n.name} = -1"
        parts += [
            f"case when {off} then {-1000.0 * n.width} else round(list_sum(scores_{n.name}), 5) end "
            f"as logits_{n.name}",
            f"case when {off} then 0.0 else round({softmax_item(n, n.width - 1)}, 6) end as last_{n.name}",
            f"case when {off} then 0.0 else 1.0 end as probs_{n.name}", f"pred_{n.name}"]
    return f"select {IDS}, {', '.join(parts)} from routed"


ORACLE |= {
    "csv_line_breaks": """
select doc_id::double as "FlowDuration", md5(nullif(text, '')) as note, source as "Label"
from documents""",
    "csv_malformed": """
with lines as (
  select list_filter([event_id::varchar, case when event_id % 3 = 0 then 'NA' else user_id::varchar end,
                      case when event_id % 5 <> 0 then event_type end,
                      case when event_id % 7 = 0 then 'extra' end], lambda x: x is not null) as f
  from events)
select f[1]::double as "FlowDuration", try_cast(nullif(f[2], 'NA') as double) as "FwdIATMean",
       f[3] as "Label"
from lines""",
    "report_round_trip": ORACLE["class_report"],
    "flow_coerce_missing": """
select event_id, case when event_type <> 'click' then user_id::double end as number,
       event_type = 'click' as missing from events""",
    "feature_arrays": pair_query(_pair, f"""
select {IDS}, 'array<float>' as kind, round((2 * (x * u1 + y * v1))::float::double, 4) as f0,
       round((2 * (x * u2 + y * v2))::float::double, 4) as f1 from scaled, axes"""),
    "cascade_records_all": with_views("routed", _records()),
    "class_reports": union([
        f"select {n.level} as level, '{n.name}' as node, * from (" + with_views(
            "own", report("pairs", n.classes),
            f"pairs as (select {n.label_column} as y_true, own_{n.name} as y_pred from own "
            f"where {n.label_column} <> -1)") + ")" for n in NODES]),
    "roc_auc_one_hot": ORACLE["roc_auc"],
}
