"""Merkle manifest of a table: checkpoints are stored, the nodes between them recomputed.

Every row is a leaf, every ``FAN`` consecutive nodes have a parent, and what remains of a
group of rows is its subroot; the subroots, by group, have a root in the same way.

The manifest stores the leaves and then only every ``STRIDE``-th level.  One stored row is
an aligned subtree: the up to ``FAN ** STRIDE`` stored nodes under one stored (or last)
node.  Proof extraction goes from the root down: of each subtree it recomputes the levels
that were not stored, emits every stored node's siblings in them, and drops them again.

All hashing is done by DataFrame functions.  A group of any size is cut into subtrees, so no
task sees more than some hundred nodes of it at once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcascade.llm.common import named, number_rows
from flowcascade.session import discard_stage, stage, stage_path

FAN = 16            # children of a node
STRIDE = 2          # levels from one stored level to the next
PATH = "array<struct<before:string,after:string>>"


def field(c: Column) -> Column:
    """A value in a leaf: ``-`` if null, else its length in UTF-8 bytes, ``:`` and itself."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text),
                      F.lit("-"))


def leaf_hash(columns: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def fold(path: Column, start: Column) -> Column:
    """The root that follows from a leaf and its siblings, lowest level first."""
    return F.aggregate(path, start, lambda node, x: F.sha2(
        F.concat(x["before"], node, x["after"]), 256))


def proof_hash(path: Column) -> Column:
    """Hash of all siblings, level by level upwards, left to right."""
    joined = F.transform(path, lambda x: F.concat(x["before"], x["after"]))
    return F.sha2(F.array_join(joined, ""), 256)


@dataclass
class Manifest:
    """Stored levels, lowest first: of the groups' trees and of the tree over the subroots.

    ``groups`` and ``tops`` hold rows ``(group, total, block, items)``: an item is a stored
    node with its position, and a leaf's item also what was carried along.  ``root`` is one
    row, none for an empty table.
    """

    groups: list[DataFrame]
    tops: list[DataFrame]
    root: DataFrame
    fan: int = FAN
    stride: int = STRIDE


class _Trees:
    """Levels of the trees of all groups of a table, from one stored level to the next."""

    def __init__(self, fan: int, stride: int):
        if fan < 2 or stride < 1:
            raise ValueError("a node needs two children or more, a stride one level or more")
        self.fan, self.stride, self.width = fan, stride, fan ** stride

    def blocks(self, nodes: DataFrame, group: list[str], carried: list[str]) -> DataFrame:
        """Stored rows of ``(group, pos, total, node, carried)``: at most ``width`` in each."""
        item = F.struct("pos", "node", *carried)
        return (nodes.withColumn("block", F.floor(F.col("pos") / self.width))
                .groupBy(*group, "total", "block")
                .agg(F.sort_array(F.collect_list(item)).alias("items")))

    def _parents(self, nodes: Column) -> Column:
        last = F.floor((F.size(nodes) - 1) / self.fan).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda run: F.sha2(F.array_join(
            F.slice(nodes, run * self.fan + 1, self.fan), ""), 256))

    def recomputed(self, blocks: DataFrame) -> DataFrame:
        """Subtrees with all their levels ``l0`` .. and their height.

        In a group of one subtree the levels end where one node remains, in any other at
        the next stored level.
        """
        out = blocks.withColumn("l0", F.col("items.node"))
        for k in range(self.stride):
            out = out.withColumn(f"l{k + 1}", self._parents(F.col(f"l{k}")))
        height = F.lit(self.stride)
        for k in reversed(range(self.stride)):
            height = F.when(F.col("total") <= self.fan ** k, k).otherwise(height)
        return out.withColumn("height", height.cast("int"))

    def above(self, blocks: DataFrame, group: list[str]) -> DataFrame:
        """The nodes over the subtrees, as nodes of the next stored level."""
        levels = F.array(*[F.col(f"l{k}") for k in range(self.stride + 1)])
        return self.recomputed(blocks).select(
            *group, F.col("block").alias("pos"),
            F.ceil(F.col("total") / self.width).alias("total"),
            F.element_at(F.get(levels, F.col("height")), 1).alias("node"))

    def build(self, nodes: DataFrame, group: list[str], carried: list[str],
              folder: str) -> tuple[list[DataFrame], DataFrame]:
        """Write every stored level below ``folder``; also one node per group.

        One number, the size of the largest group, comes to the driver per stored level:
        five of them reach 10 ** 12 rows.
        """
        levels, spark = [], nodes.sparkSession
        while True:
            table = self.blocks(nodes, group, carried)
            path = f"{folder}/level{len(levels)}"
            table.write.parquet(path)
            levels.append(spark.read.schema(table.schema).parquet(path))
            nodes, carried = self.above(levels[-1], group), []
            largest = levels[-1].agg(F.max("total")).first()[0]
            if largest is None or largest <= self.width:
                return levels, nodes.select(*group, "node")

    def _siblings(self, at: Column) -> Column:
        """Siblings of the stored node ``at`` places into its subtree, per level of it."""
        steps = []
        for k in range(self.stride):
            here = F.floor(at / self.fan ** k).cast("int")
            place = here % self.fan
            run = F.slice(F.col(f"l{k}"), here - place + 1, self.fan)
            steps.append(F.struct(
                F.array_join(F.slice(run, F.lit(1), place), "").alias("before"),
                F.array_join(F.slice(run, place + 2, self.fan), "").alias("after")))
        return F.slice(F.array(*steps), F.lit(1), F.col("height"))

    def paths(self, levels: list[DataFrame], group: list[str], heads: DataFrame | None,
              passed: list[str], wanted: Callable[[Column], Column] | None = None) -> DataFrame:
        """The path of every leaf: its item, what ``heads`` passes down, and its siblings.

        ``heads`` has one row ``(group, passed, path)`` per group: the path above its last
        node; a single tree needs none.  Subtrees without a leaf that is ``wanted`` are not
        recomputed at the lowest stored level.
        """
        above = None if heads is None else heads.withColumn("pos", F.lit(0).cast("long"))
        for depth, blocks in reversed(list(enumerate(levels))):
            if depth == 0 and wanted is not None:
                blocks = blocks.filter(F.exists("items", wanted))
            subtrees = self.recomputed(blocks)
            if above is None:
                subtrees = subtrees.withColumn("__path", F.array().cast(PATH))
            else:
                upper = above.select(
                    *[named(c).alias(f"__{c}") for c in group],
                    F.col("pos").alias("__block"), *passed, F.col("path").alias("__path"))
                same = F.col("block") == F.col("__block")
                for c in group:
                    same &= named(c).eqNullSafe(named(f"__{c}"))
                subtrees = subtrees.join(upper, same)
            found = subtrees.select(
                *group, *passed, "__path", F.inline(F.transform("items", lambda x, i: F.struct(
                    x.alias("item"), self._siblings(i).alias("__own")))))
            above = found.select(
                *group, *passed, F.col("item.pos").alias("pos"), "item",
                F.concat("__own", "__path").alias("path"))
        return above


def build_manifest(leaves: DataFrame, group: str = "source", order: str = "doc_id",
                   carried: Iterable[str] = (), folder: str | None = None,
                   fan: int = FAN, stride: int = STRIDE) -> Manifest:
    """Number the leaves of each group, build all trees and write their stored levels.

    ``leaves`` has the columns ``group``, ``order``, ``leaf`` (a hash) and ``carried``.  The
    tables are written below ``folder``, by default a new one in the shared folder.
    """
    spark = leaves.sparkSession
    folder = folder or stage_path(spark, "merkle")
    trees = _Trees(fan, stride)
    carried = list(dict.fromkeys([order, *carried]))
    hashed = stage(leaves, "merkle-hashes")     # texts are hashed once, then only hashes move
    numbered = number_rows(hashed, [group], [order, "leaf"], "merkle-leaves", "pos",
                           sized="total")
    groups, subroots = trees.build(
        numbered.withColumnRenamed("leaf", "node"), [group], carried, f"{folder}/groups")
    discard_stage(hashed)
    discard_stage(numbered)
    ranked = number_rows(subroots, [], [group], "merkle-subroots", "pos", sized="total")
    tops, root = trees.build(ranked, [], [group], f"{folder}/tops")
    discard_stage(ranked)
    spark.createDataFrame(
        [(json.dumps({"groups": len(groups), "tops": len(tops), "fan": fan,
                      "stride": stride}),)], "value string").coalesce(1).write.text(
        f"{folder}/manifest.json")
    root.write.parquet(f"{folder}/root")
    return Manifest(groups, tops, spark.read.schema(root.schema).parquet(f"{folder}/root"),
                    fan, stride)


def open_manifest(spark: SparkSession, folder: str) -> Manifest:
    """A manifest that was written to ``folder``."""
    plain = json.loads(spark.read.text(f"{folder}/manifest.json").first()["value"])

    def levels(kind: str) -> list[DataFrame]:
        return [spark.read.parquet(f"{folder}/{kind}/level{k}") for k in range(plain[kind])]

    return Manifest(levels("groups"), levels("tops"), spark.read.parquet(f"{folder}/root"),
                    plain["fan"], plain["stride"])


def proofs(manifest: Manifest, wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """Per leaf: its group, its item's columns, ``leaf``, ``subroot``, ``root`` and ``path``.

    ``path`` lists, from the lowest level up, the concatenated siblings before and after the
    node.  ``wanted`` gets an item and says whether its leaf is asked for; without it all are.
    """
    trees = _Trees(manifest.fan, manifest.stride)
    group = next(c for c in manifest.groups[0].columns if c not in ("total", "block", "items"))
    root = manifest.root.first()                # one row, none without leaves
    subroots = trees.paths(manifest.tops, [], None, []).select(
        F.col(f"item.{group}").alias(group), F.col("item.node").alias("subroot"),
        F.lit(root and root["node"]).cast("string").alias("root"), "path")
    found = trees.paths(manifest.groups, [group], subroots, ["subroot", "root"], wanted)
    if wanted is not None:
        found = found.filter(wanted(F.col("item")))
    carried = [f.name for f in found.schema["item"].dataType if f.name not in ("pos", "node")]
    return found.select(
        group, *[F.col("item")[c].alias(c) for c in carried if c != group],
        F.col("item.node").alias("leaf"), "subroot", "root", "path")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAMPERED_EVERY = 5


def audit_documents(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """A manifest of ``docs`` and, per row, whether a perhaps tampered copy still fits it.

    Null ids come first in their source; rows of equal id are ordered by their hash, so
    repeated rows are leaves of their own.  A null source is a group of its own and differs
    from an empty one.  Null fields, texts included, are hashed as ``-``; texts of any length
    are hashed whole.  A row without id is never tampered.  A text without A-Z stays as it is
    when tampered and so verifies.  An empty table gives an empty result.  Other columns are
    not read.
    """
    plain = {c: named(c).cast("string") for c in ("source", "lang", "text")}
    plain |= {c: named(c).cast("long") for c in ("doc_id", "n_chars")}
    marked = F.crc32(plain["doc_id"].cast("string").cast("binary")) % TAMPERED_EVERY == 0
    lowered = plain | {"text": F.translate(plain["text"], UPPER, LOWER)}
    leaves = docs.select(
        plain["doc_id"].alias("doc_id"), plain["source"].alias("source"),
        leaf_hash(plain[c] for c in FIELDS).alias("leaf"),
        F.when(marked, leaf_hash(lowered[c] for c in FIELDS)).alias("altered"))
    found = proofs(build_manifest(leaves, carried=["altered"], folder=folder))
    judged = found.select(
        "doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"),
        fold(F.col("path"), F.coalesce("altered", "leaf")).alias("folded_root"))
    return judged.withColumn("verified", F.col("folded_root") == F.col("root"))
