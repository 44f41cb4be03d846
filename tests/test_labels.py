import pytest

from flowcascade.operators import labels as L
from flowcascade.schema import LEAVES, LEVEL_COLUMNS, NODES, leaf_paths


@pytest.fixture(scope="module")
def leaves(spark):
    rows = [(leaf,) for leaf in LEAVES] + [("OTHER",), (None,), ("Syn",)]
    return spark.createDataFrame(rows, "leaf string")


def test_hierarchical_labels(leaves):
    for row in L.hierarchical_labels(leaves, "leaf").collect():
        want = dict.fromkeys(LEVEL_COLUMNS, -1)
        want.update({n.label_column: c for n, c in leaf_paths().get(row["leaf"], [])})
        assert {c: row[c] for c in LEVEL_COLUMNS} == want


def test_label_map_round_trip(leaves, spark):
    mapping = L.fit_label_map(leaves, "leaf")
    assert list(mapping) == sorted([*LEAVES, "OTHER"])
    coded = L.encode_label(leaves, "leaf", mapping)
    back = L.decode_label(coded, "label_code", mapping, "back")
    assert all(r["leaf"] == r["back"] for r in back.collect())
    unseen = spark.createDataFrame([("new",)], "leaf string")
    assert L.encode_label(unseen, "leaf", mapping).first()["label_code"] == -1


@pytest.mark.parametrize("n", [3, 500])
def test_label_maps_of_any_size(spark, n):
    df = spark.range(n).selectExpr("concat('c', lpad(id, 4, '0')) as name")
    mapping = L.fit_label_map(df, "name")
    rows = L.encode_label(df, "name", mapping).collect()
    assert len(rows) == n and all(r["label_code"] == int(r["name"][1:]) for r in rows)
    back = L.decode_label(L.encode_label(df, "name", mapping), "label_code", mapping, "back")
    assert all(r["name"] == r["back"] for r in back.collect())


def test_empty_label_map(spark):
    df = spark.createDataFrame([("x",), (None,)], "name string")
    assert [r["label_code"] for r in L.encode_label(df, "name", {}).collect()] == [-1, -1]
    coded = L.encode_label(df, "name", {"x": 0})
    assert [r["label_code"] for r in coded.collect()] == [0, -1]


def test_numeric_label_needs_a_map(spark):
    df = spark.createDataFrame([(9.0,), (99.0,)], "y double")
    with pytest.raises(ValueError, match="stored label map"):
        L.resolve_leaf(df, "y", None)
    mapping = {leaf: i for i, leaf in enumerate(LEAVES)}
    rows = L.resolve_leaf(df, "y", mapping).collect()
    assert [(r["leaf"], r["label_code"]) for r in rows] == [("Syn", 9), (None, 99)]


def test_present_and_selected_levels(spark, leaves):
    some = L.hierarchical_labels(
        spark.createDataFrame([("Syn",), ("BENIGN",)], "leaf string"), "leaf")
    assert L.present_level_ids(some) == [1, 2, 5]
    assert [r["leaf"] for r in L.select_level(some, "3_generic_dos").collect()] == ["Syn"]
    assert L.present_level_ids(some.limit(0)) == []


def test_distribution_and_sizes(leaves):
    df = L.hierarchical_labels(leaves, "leaf")
    dist = {(r["node"], r["class_name"]): r["rows"] for r in L.level_distribution(df).collect()}
    assert dist["1", "DoS"] == 11 and dist["3_generic_dos", "Syn"] == 2
    assert len(dist) == sum(n.width for n in NODES)
    sizes = {r["level"]: (r["rows"], r["classes"]) for r in L.level_sizes(df).collect()}
    assert sizes == {1: (14, 3), 2: (11, 2), 3: (2, 2), 4: (8, 8), 5: (3, 2)}
