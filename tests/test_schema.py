import pytest

from flowcascade import schema as S


def test_label_resolution():
    assert S.resolve_label(["a", " Label", "label"]) == " Label"
    assert S.resolve_label(["a", "label"]) == "label"
    assert S.resolve_label(["a", "my LABEL 1", "Label2"]) == "my LABEL 1"
    assert S.resolve_label(["a"]) is None
    with pytest.raises(ValueError, match="no label column"):
        S.require_label(["a"])


def test_last_of_equal_names_wins():
    assert S.column_map(["Flow Duration", "x", "FlowDuration"])["FlowDuration"] == "FlowDuration"


def test_leaves_are_sorted_and_all_reachable():
    assert S.LEAVES == sorted(S.LEAVES)
    assert sorted(S.leaf_paths()) == S.LEAVES
    assert [(n.name, c) for n, c in S.leaf_paths()["UDP-lag"]] == [
        ("1", 1), ("2_dos", 1), ("3_generic_dos", 1)]


def test_node_lookup():
    assert S.node_of(1) is S.node_of("1")
    assert S.node_of(4).name == "3_drdos"
    assert S.node_classes("2_protocol") == ["Portmap", "TFTP"]
    for unknown in (0, 6, "2", "x", None):
        with pytest.raises(ValueError):
            S.node_of(unknown)


def test_base_features():
    assert len(S.BASE_FEATURES) == len(set(S.BASE_FEATURES)) == 52
