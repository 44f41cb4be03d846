"""Fixed names of the flow data model and the label hierarchy.

Nothing here touches data: these are the column names, class names and the
shape of the tree that every operator derives its expressions from.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Wanted columns of a flow CSV, names without spaces.
# ---------------------------------------------------------------------------
BASE_FEATURES = [
    "Protocol", "FlowDuration", "TotalFwdPackets", "TotalBackwardPackets",
    "FlowBytes/s", "FlowPackets/s", "FwdPacketLengthMax", "FwdPacketLengthMin",
    "FwdPacketLengthMean", "FwdPacketLengthStd", "BwdPacketLengthMax",
    "BwdPacketLengthMin", "BwdPacketLengthMean", "BwdPacketLengthStd",
    "PacketLengthVariance", "FlowIATMin", "FlowIATMax", "FlowIATMean",
    "FlowIATStd", "FwdIATMean", "FwdIATStd", "FwdIATMax", "FwdIATMin",
    "BwdIATMean", "BwdIATStd", "BwdIATMax", "BwdIATMin", "FwdPSHFlags",
    "BwdPSHFlags", "FwdURGFlags", "BwdURGFlags", "FwdHeaderLength",
    "BwdHeaderLength", "FwdPackets/s", "BwdPackets/s", "Init_Win_bytes_forward",
    "Init_Win_bytes_backward", "min_seg_size_forward", "SubflowFwdBytes",
    "SubflowBwdBytes", "AveragePacketSize", "AvgFwdSegmentSize",
    "AvgBwdSegmentSize", "ActiveMean", "ActiveMin", "ActiveMax", "ActiveStd",
    "IdleMean", "IdleMin", "IdleMax", "IdleStd", "Timestamp",
]

CATEGORICAL_FEATURES = ["Protocol"]
TEXT_FEATURES = ["Timestamp"]

# The 13 leaf classes; a leaf's index is its position.
LEAVES = [
    "BENIGN", "DNS", "LDAP", "MSSQL", "NTP", "NetBIOS", "Portmap", "SNMP",
    "SSDP", "Syn", "TFTP", "UDP", "UDP-lag",
]

DEFAULT_COMPONENTS = 25
UNRESOLVED = -1          # "does not apply" / "no decision" in every int column
MASKED_LOGIT = -1000.0   # logit of a class at a node the row was not routed to


@dataclass(frozen=True)
class Node:
    """One classifier of the cascade.

    ``parent`` and ``parent_class`` say which decision of which node routes a
    row here; the root has neither.  ``display_prefix`` is put before class
    names where a decision is shown to a person.
    """

    level: int
    name: str
    classes: tuple[str, ...]
    parent: str | None = None
    parent_class: str | None = None
    depth: int = 1
    display_prefix: str = ""

    @property
    def width(self) -> int:
        return len(self.classes)

    @property
    def label_column(self) -> str:
        return f"level{self.level}"

    @property
    def record(self) -> str:
        """Name of the struct column holding this node's scores."""
        return f"node_{self.name}"

    def display(self, cls: str) -> str:
        return self.display_prefix + cls


# The five nodes, their classes in code order, and the routes.
NODES = (
    Node(1, "1", ("BENIGN", "DoS", "Protocol")),
    Node(2, "2_dos", ("DrDoS", "Generic-DoS"), "1", "DoS", 2),
    Node(3, "2_protocol", ("Portmap", "TFTP"), "1", "Protocol", 2),
    Node(4, "3_drdos",
         ("DNS", "LDAP", "MSSQL", "NTP", "NetBIOS", "SNMP", "SSDP", "UDP"),
         "2_dos", "DrDoS", 3, "DrDoS_"),
    Node(5, "3_generic_dos", ("Syn", "UDP-lag"), "2_dos", "Generic-DoS", 3),
)

NODE_BY_NAME = {n.name: n for n in NODES}
NODE_BY_LEVEL = {n.level: n for n in NODES}
LEVEL_COLUMNS = [n.label_column for n in NODES]
PREDICTION_COLUMNS = [f"pred_{n.name}" for n in NODES]


def node_of(key: int | str) -> Node:
    """Node by level id (``1`` .. ``5``) or by name (``'1'``, ``'2_dos'`` ...)."""
    if isinstance(key, int) and key in NODE_BY_LEVEL:
        return NODE_BY_LEVEL[key]
    if isinstance(key, str) and key in NODE_BY_NAME:
        return NODE_BY_NAME[key]
    raise ValueError(f"unknown node: {key!r}")


def children(node: Node) -> list[Node]:
    return [n for n in NODES if n.parent == node.name]


def child_for(node: Node, cls: str) -> Node | None:
    """The node that refines class ``cls`` of ``node``, if any."""
    return next((n for n in children(node) if n.parent_class == cls), None)


def leaf_paths(node: Node = NODES[0]) -> dict[str, list[tuple[Node, int]]]:
    """For each leaf below ``node``: the (node, class code) decisions leading to it."""
    paths: dict[str, list[tuple[Node, int]]] = {}
    for code, cls in enumerate(node.classes):
        nxt = child_for(node, cls)
        if nxt is None:
            paths[cls] = [(node, code)]
        else:
            for leaf, rest in leaf_paths(nxt).items():
                paths[leaf] = [(node, code), *rest]
    return paths


def leaves_of_class(node: Node, code: int) -> list[str]:
    """Leaves that carry class ``code`` at ``node``."""
    return [leaf for leaf, path in leaf_paths().items() if (node, code) in path]


def leaves_of_node(node: Node) -> list[str]:
    """Leaves that have any class at ``node``, in leaf order."""
    return [leaf for leaf, path in leaf_paths().items() if any(n == node for n, _ in path)]


def node_classes(key: int | str) -> list[str]:
    return list(node_of(key).classes)


# ---------------------------------------------------------------------------
# Column-name rules
# ---------------------------------------------------------------------------
def strip_spaces(name: str) -> str:
    return name.replace(" ", "")


def column_map(columns: list[str]) -> dict[str, str]:
    """Space-free name -> actual name; the last of several equal names wins."""
    return {strip_spaces(c): c for c in columns}


def resolve_label(columns: list[str]) -> str | None:
    """``Label``, else ``label``, else the first name containing "label"."""
    by_name = column_map(columns)
    for exact in ("Label", "label"):
        if exact in by_name:
            return by_name[exact]
    return next((c for c in columns if "label" in c.lower()), None)


def require_label(columns: list[str]) -> str:
    label = resolve_label(columns)
    if label is None:
        raise ValueError("no label column")
    return label
