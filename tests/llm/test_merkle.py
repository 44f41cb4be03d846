"""The Merkle manifest against a plain recursive tree, and against its SQL."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from flowcascade.llm import merkle
from flowcascade.llm.common import prepare_session
from flowcascade.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, source string, lang string, n_chars long, text string, "
          "leaf string, item string, pos long, `total` long, block long")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lowered=False):
    doc_id, source, lang, n_chars, text = row
    if lowered and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def tree(nodes, fan):
    """Root of a list of nodes and, per node, the (before, after) of each level above it."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + fan] for i in range(0, len(nodes), fan)]
        for path, at in zip(paths, place):
            run, inside = runs[at // fan], at % fan
            path.append(("".join(run[:inside]), "".join(run[inside + 1:])))
        place = [at // fan for at in place]
        nodes = [sha(*run) for run in runs]
    return nodes[0], paths


def expected(rows, fan=16):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    trees = {}
    for source, members in groups.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[source] = members, *tree([leaf_of(r) for r in members], fan)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, tops = tree([trees[s][1] for s in order], fan)
    found = []
    for source, top in zip(order, tops):
        members, subroot, paths = trees[source]
        for row, path in zip(members, paths):
            path = path + top
            marked = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            folded = leaf_of(row, marked)
            for before, after in path:
                folded = sha(before, folded, after)
            found.append((row[0], leaf_of(row), subroot, root,
                          sha(*(a + b for a, b in path)), folded, folded == root))
    return sorted(found, key=repr)


def table(spark, rows):
    prepare_session(spark)
    wide = [(*r[:2], r[2], r[3], r[4], "x", "y", 1, 2, 3) for r in rows]
    return spark.createDataFrame(wide, SCHEMA).repartition(7)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


LONG = "A long Text " * 20_000
ODD = ([(i, "hot", "en", i % 3, f"Text {i}") for i in range(700)]
       + [(3, "hot", "en", 0, "Text 3")] * 3
       + [(i, f"s{i % 19}", None, None, None if i % 4 else "É Ü a") for i in range(60)]
       + [(None, None, None, None, None)] * 2 + [(None, None, "en", 1, "B"), (-5, "", "", 0, "")]
       + [(77, "long", "en", len(LONG), LONG)])


def test_audit_equals_plain_trees(spark):
    assert got(merkle.audit_documents(table(spark, ODD))) == expected(ODD)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_sizes_at_the_edges(spark, n):
    rows = [(i, "s", "en", 1, f"T{i}") for i in range(n)]
    assert got(merkle.audit_documents(table(spark, rows))) == expected(rows)


def test_empty_table(spark):
    assert merkle.audit_documents(table(spark, [])).collect() == []


@pytest.mark.parametrize("fan, stride", [(2, 1), (2, 3), (3, 2), (16, 1)])
def test_any_fan_and_stride(spark, fan, stride):
    rows = [(i, f"s{i % 5 if i % 2 else 0}", "en", 1, f"t{i}") for i in range(150)]
    leaves = table(spark, rows).select(
        "doc_id", "source", merkle.leaf_hash(F.col(c) for c in merkle.FIELDS).alias("leaf"))
    found = merkle.proofs(merkle.build_manifest(leaves, fan=fan, stride=stride))
    folded = found.select("doc_id", "root", merkle.fold(F.col("path"), F.col("leaf")).alias("f"),
                          merkle.proof_hash(F.col("path")).alias("p")).collect()
    want = {r[0]: (r[3], r[4]) for r in expected(rows, fan)}
    assert {r["doc_id"]: (r["f"], r["p"]) for r in folded} == want


def test_manifest_is_reopened_and_asked_for_some_leaves(spark, tmp_path):
    rows = [(i, "s", "en", 1, f"t{i}") for i in range(600)]
    leaves = table(spark, rows).select(
        "doc_id", "source", merkle.leaf_hash(F.col(c) for c in merkle.FIELDS).alias("leaf"))
    merkle.build_manifest(leaves, folder=str(tmp_path / "m"))
    again = merkle.open_manifest(spark, str(tmp_path / "m"))
    # 600 leaves: they, every second level above and the root are stored, nothing between
    assert [t.count() for t in again.groups] == [3, 1]
    found = merkle.proofs(again, wanted=lambda x: x["doc_id"].isin(5, 599)).collect()
    want = {r[0]: r for r in expected(rows)}
    assert sorted(r["doc_id"] for r in found) == [5, 599]
    for r in found:
        siblings = "".join(p["before"] + p["after"] for p in r["path"])
        assert sha(siblings) == want[r["doc_id"]][4]


def test_query_equals_sql(spark):
    name = "op13_merkle_manifest"
    duckdb.sql(f"create or replace view documents as from '{DATA}/documents.parquet'")
    want = duckdb.sql(ORACLE[name])
    order = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = want.select(*[duckdb.ColumnExpression(c) for c in order]).fetchall()
    assert got(QUERIES[name](spark, DATA)) == sorted(rows, key=repr)
