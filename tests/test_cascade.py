import numpy as np
import pytest
from pyspark.sql import functions as F

from flowcascade.functions import argmax, logsumexp, pad_scores, softmax
from flowcascade.operators import cascade as C
from flowcascade.schema import LEAVES, NODES, NODE_BY_NAME, leaf_paths

SCORES = {n.name: f"s_{n.name}" for n in NODES}


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(2)
    rows = [[i, *[rng.normal(size=n.width).tolist() for n in NODES]] for i in range(400)]
    schema = "id int, " + ", ".join(f"s_{n.name} array<double>" for n in NODES)
    return rows, spark.createDataFrame(rows, schema)


def by_hand(row):
    """Follow one row through the tree."""
    own = {n.name: int(np.argmax(s)) for n, s in zip(NODES, row[1:])}
    preds = dict.fromkeys(own, -1)
    node = NODES[0]
    while True:
        preds[node.name] = own[node.name]
        cls = node.classes[own[node.name]]
        nxt = [n for n in NODES if n.parent == node.name and n.parent_class == cls]
        if not nxt:
            return preds, LEAVES.index(cls)
        node = nxt[0]


def soft(s):
    e = np.exp(np.array(s) - max(s))
    return e / e.sum()


def test_softmax_argmax_logsumexp(spark):
    df = spark.createDataFrame([([0.7, 0.7, -1.0],), ([1000.0, 0.0, -1000.0],)], "s array<double>")
    for width in (None, 3):
        rows = df.select(softmax(F.col("s"), width).alias("p"), argmax(F.col("s")).alias("a"),
                         logsumexp(F.col("s"), width).alias("l")).collect()
        np.testing.assert_allclose(rows[0]["p"], soft([0.7, 0.7, -1.0]))
        assert [r["a"] for r in rows] == [0, 0]
        assert rows[1]["l"] == pytest.approx(1000.0)
        assert sum(rows[1]["p"]) == pytest.approx(1.0)
    padded = df.select(pad_scores(F.col("s"), 5).alias("s")).first()["s"]
    assert padded == [0.7, 0.7, -1.0, -1000.0, -1000.0]


def test_routing_fill_and_flat_index(scored):
    rows, df = scored
    out = C.cascade(df, SCORES, flat_probs=True).orderBy("id").collect()
    reached = set()
    for row, got in zip(rows, out):
        preds, leaf = by_hand(row)
        reached.add(leaf)
        assert got["flat_pred"] == leaf
        for node, scores in zip(NODES, row[1:]):
            record = got[node.record]
            assert record["pred"] == preds[node.name]
            if preds[node.name] == -1:
                assert record["probs"] == [0.0] * node.width
                assert record["logits"] == [-1000.0] * node.width
            else:
                assert record["logits"] == scores
                np.testing.assert_allclose(record["probs"], soft(scores))
        probs = {n.name: soft(s) for n, s in zip(NODES, row[1:])}
        want = [np.prod([probs[n.name][c] for n, c in leaf_paths()[leaf]]) for leaf in LEAVES]
        np.testing.assert_allclose(got["flat_probs"], want)
        assert sum(got["flat_probs"]) == pytest.approx(1.0)
    assert reached == set(range(13))


def test_node_without_scores_resolves_nothing(scored):
    rows, df = scored
    part = {k: v for k, v in SCORES.items() if k != "3_drdos"}
    out = C.cascade(df, part).orderBy("id").collect()
    for row, got in zip(rows, out):
        preds, leaf = by_hand(row)
        assert got["node_3_drdos"]["pred"] == -1
        assert got["flat_pred"] == (-1 if preds["2_dos"] == 0 else leaf)


def test_scoring_never_shuffles(scored):
    _, df = scored
    plan = C.cascade(df, SCORES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_predictions_do_not_compute_probabilities(scored):
    _, df = scored
    plan = C.prediction_columns(C.cascade(df, SCORES))._jdf.queryExecution()
    assert "EXP" not in plan.optimizedPlan().toString().upper()


def test_decision_paths(scored):
    rows, df = scored
    paths = C.decision_path(C.cascade(df, SCORES), ["id"]).orderBy("id").collect()
    for row, got in zip(rows, paths):
        _, leaf = by_hand(row)
        want = [f"Level {n.depth}: {n.display(n.classes[c])}" for n, c in leaf_paths()[LEAVES[leaf]]]
        assert got["steps"] == want and got["n_steps"] == len(want)
        assert got["path"] == " -> ".join(want)


def test_node_counts(scored):
    rows, df = scored
    counts = {r["node"]: r for r in C.node_counts(C.cascade(df, SCORES)).collect()}
    assert len(counts) == 18 and counts["Root"]["n"] == len(rows)
    for parent in ("Root", "DoS", "Protocol", "DrDoS", "Generic-DoS"):
        below = sum(r["n"] for r in counts.values() if r["parent"] == parent)
        assert below == counts[parent]["n"]
    leaf = sum(by_hand(r)[1] == LEAVES.index("NTP") for r in rows)
    assert counts["DrDoS_NTP"]["n"] == leaf
    assert counts["DrDoS_NTP"]["size"] == pytest.approx(1000 * (leaf + 1) / (len(rows) + 1))
    empty = C.node_counts(C.cascade(df.limit(0), SCORES)).collect()
    assert len(empty) == 18 and {r["n"] for r in empty} == {0} and empty[0]["size"] == 1000.0


def test_tree_shape():
    nodes = C.tree_nodes()
    assert len(nodes) == 18
    assert [sum(d == k for _, _, d in nodes) for k in range(4)] == [1, 3, 4, 10]
    assert NODE_BY_NAME["3_drdos"].display("UDP") == "DrDoS_UDP"
