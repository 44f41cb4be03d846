"""SimHash near-duplicates by vantage-point trees.

Every text gets a 64-bit fingerprint of its word shingles.  The distinct fingerprints are
partitioned by vantage-point trees: each node sends a fingerprint left or right by its
Hamming distance to the node's vantage point.  A fingerprint also visits the leaves that
its ball overlaps (triangle inequality), so every pair within the distance meets in one
leaf.  Inside a leaf the same pruning goes on.  Leaves hand on a spanning forest of their
links, never all pairs, and the components come from that.

Over all 64 bits a ball of 4 bits overlaps most boundaries, for most distances are about
32.  So there is a tree for each of several blocks of bits, whose distances count that
block alone: of two fingerprints that differ in d bits, some block of m has at most d // m
of them, and in that block's tree the ball is that small.  With d + 1 blocks it has radius
0, and a fingerprint goes to one leaf of each tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowcascade.llm.common import named, shuffle_partitions
from flowcascade.llm.graph import components
from flowcascade.session import stage

SEED = 42                # of the shingle hash, a fixed value
SHINGLE_WORDS = 4
MAX_BITS = 4
SAMPLE = 1 << 15         # fingerprints, at least, from which the trees are built
SAMPLED_PER_CHUNK = 32   # of as many fingerprints as a chunk has, so many are sampled
LEAF = 1 << 10           # fingerprints wanted in a leaf
MAX_TREES = 16
CHUNK = 1 << 14          # home fingerprints that one task holds at a time
PAIR_BLOCK = 1 << 20     # distances computed at a time


def fingerprint(text: bytes, size: int = SHINGLE_WORDS) -> int:
    """SimHash of a UTF-8 text: A-Z lower-cased, words between blanks, word shingles."""
    words = text.lower().split()            # bytes: only A-Z and the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    if len(words) > size:
        starts, ends = starts[:len(words) - size + 1], ends[size - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    votes = np.zeros(64, np.int64)
    step = 1 << 16
    for i in range(0, len(starts), step):
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in
                           zip(starts[i:i + step].tolist(), ends[i:i + step].tolist())],
                          "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long); null text: no words."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or b"", size) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))],
                names=["doc_id", "fp"])

    rows = docs.select(named(id_col).cast("long").alias("doc_id"),
                       named(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(apply, "doc_id long, fp long")


def distance(a, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b))


def blocks(n: int) -> list[np.uint64]:
    """Masks that share the 64 bits among ``n`` blocks."""
    return [np.uint64(sum(1 << int(b) for b in part)) for part in np.array_split(range(64), n)]


class VantageTree:
    """A complete binary tree over the bits of ``mask``; node i has the children 2 i + 1
    (inside) and 2 i + 2."""

    def __init__(self, sample: np.ndarray, depth: int, mask: int = 2**64 - 1, seed: int = 0):
        self.depth, self.mask = depth, np.uint64(mask)
        sample = sample & self.mask
        self.points = np.zeros((1 << depth) - 1, np.uint64)
        self.radii = np.full((1 << depth) - 1, 64, np.int64)
        draw = np.random.default_rng(seed)
        members = {0: sample}
        for node in range(len(self.points)):
            here = members.pop(node)
            if len(here):
                self.points[node], self.radii[node] = self._split(here, draw)
            inside = distance(here, self.points[node]) <= self.radii[node]
            members[2 * node + 1], members[2 * node + 2] = here[inside], here[~inside]

    @staticmethod
    def _split(here: np.ndarray, draw) -> tuple[np.uint64, int]:
        """Of a few candidates the point and radius that part the sample most evenly; of
        equal ones that from which distances spread most."""
        best = None
        probe = draw.choice(here, min(len(here), 1000), replace=False)
        for point in draw.choice(here, min(len(here), 16), replace=False):
            away = distance(probe, point).astype(np.int64)
            middle = int(np.median(away))
            for radius in (middle - 1, middle):
                key = (-abs((away <= radius).mean() - 0.5), away.std(), int(point))
                if best is None or key > best[0]:
                    best = (key, point, radius)
        return best[1], best[2]

    def home(self, fps: np.ndarray) -> np.ndarray:
        fps = fps & self.mask
        node = np.zeros(len(fps), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (distance(fps, self.points[node]) > self.radii[node])
        return node - len(self.points)

    def overlaps(self, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaves of all leaves that the balls of the fingerprints reach."""
        fps = fps & self.mask
        row, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        for _ in range(self.depth):
            away = distance(fps[row], self.points[node]).astype(np.int64)
            left, right = away <= self.radii[node] + bits, away > self.radii[node] - bits
            row = np.concatenate([row[left], row[right]])
            node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return row, node - len(self.points)


def near(home: np.ndarray, visitors: np.ndarray, bits: int,
         seed: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (home numbers, visitor numbers, matrix of what lies within ``bits``).

    Each home fingerprint stays on one side of a vantage point, a visitor goes to every
    side its ball reaches, and what cannot match is never compared.
    """
    draw = np.random.default_rng(seed)
    todo = [(np.arange(len(home)), np.arange(len(visitors)))]
    while todo:
        h, v = todo.pop()
        if not len(h) or not len(v):
            continue
        if len(h) > 256 and len(v) > 64:
            point = home[h[draw.integers(len(h))]]
            dh = distance(home[h], point).astype(np.int64)
            dv = distance(visitors[v], point).astype(np.int64)
            radius = int(np.median(dh))
            inside = dh <= radius
            if not inside.all():
                todo.append((h[inside], v[dv <= radius + bits]))
                todo.append((h[~inside], v[dv > radius - bits]))
                continue
        step = max(1, PAIR_BLOCK // len(h))
        for i in range(0, len(v), step):
            part = v[i:i + step]
            yield h, part, distance(visitors[part][:, None], home[h][None, :]) <= bits


class Links:
    """Components of the fingerprints a task holds; gives out the edges that joined them."""

    def __init__(self, home: np.ndarray):
        self.home = home
        self.label = np.arange(len(home))
        self.edges: list[tuple[int, int]] = []

    def _join(self, fp: int, matched: np.ndarray) -> None:
        labels, first = np.unique(self.label[matched], return_index=True)
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]
        self.edges += [(fp, int(self.home[matched[i]])) for i in first]

    def add(self, visitors: np.ndarray, bits: int, own: bool = False) -> None:
        """Link the visitors; ``own``: they are the home fingerprints themselves."""
        for h, v, match in near(self.home, visitors, bits):
            if own:
                match &= h[None, :] != v[:, None]
            for k in np.flatnonzero(match.any(axis=1)):
                matched = h[match[k]]
                if own and (self.label[matched] == self.label[v[k]]).all():
                    continue
                self._join(int(visitors[v[k]]), np.append(matched, v[k]) if own else matched)


def links(fps: DataFrame, bits: int = MAX_BITS, trees: int | None = None) -> DataFrame:
    """Edges ``a``, ``b`` whose components are those of all pairs within ``bits``.

    ``fps`` has one row per distinct fingerprint (``fp``).  The trees (``bits`` + 1, at
    most 16, if not given) are built from a sample; whatever the sample, every pair within
    the distance meets.  Of two leaves the one with the smaller number does the visiting.
    The sample, and with it the number of leaves, grows with the fingerprints (one in 512,
    eight bytes each, on the driver), so that a leaf holds a quarter of ``CHUNK`` or less on
    average at any size.  A leaf with more than ``CHUNK`` is cut into chunks, each a group of
    its own.
    """
    trees = trees or min(bits + 1, MAX_TREES)
    budget = bits // trees
    spark = fps.sparkSession
    total = fps.count()
    wanted = max(SAMPLE, SAMPLED_PER_CHUNK * total // CHUNK)
    sample = [r[0] for r in fps.sample(min(1.0, wanted / max(total, 1)), seed=1)
              .limit(2 * wanted).collect()]
    sampled = np.sort(np.array(sample, np.int64).view(np.uint64))
    depth = max(0, math.ceil(math.log2(max(total, 1) / LEAF)))
    depth = min(depth, max(0, int(math.log2(max(len(sampled), 1))) - 3))
    forest = [VantageTree(sampled, depth, int(mask)) for mask in blocks(trees)]

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            leaf = np.concatenate([tree.home(fp) + (i << depth) for i, tree in enumerate(forest)])
            at, n = np.unique(leaf, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["leaf", "n"])

    # one row per leaf of the trees, whose size is bounded by the sample
    sizes = {r["leaf"]: r["n"] for r in fps.mapInArrow(homes, "leaf long, n long")
             .groupBy("leaf").agg(F.sum("n").alias("n")).collect()}
    chunks = np.ones(trees << depth, np.int64)
    for leaf, n in sizes.items():
        chunks[leaf] = -(-n // CHUNK)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            unsigned = fp.view(np.uint64)
            part_of = ((unsigned * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(
                np.int64)
            for i, tree in enumerate(forest):
                home = tree.home(unsigned) + (i << depth)
                own = part_of % chunks[home]
                row, leaf = tree.overlaps(unsigned, budget)
                leaf = leaf + (i << depth)
                wanted = leaf >= home[row]
                row, leaf = row[wanted], leaf[wanted]
                at_home = leaf == home[row]
                # a home fingerprint is dealt to its own chunk and visits the chunks before it
                times = np.where(at_home, own[row] + 1, chunks[leaf])
                again = np.repeat(np.arange(len(row)), times)
                chunk = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
                is_home = at_home[again] & (chunk == own[row[again]])
                for j in range(0, len(again), 1 << 18):
                    part = slice(j, j + (1 << 18))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leaf[again[part]]), pa.array(chunk[part]),
                         pa.array(is_home[part]), pa.array(fp[row[again[part]]])],
                        names=["leaf", "chunk", "home", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come one after the other, home fingerprints first."""
        held: list[np.ndarray] = []
        now, at = None, None

        def edges(found: Links) -> pa.RecordBatch:
            pairs = np.array(found.edges, np.uint64).reshape(-1, 2).view(np.int64)
            found.edges = []
            return pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        def settled() -> Links:
            found = Links(np.concatenate(held) if held else np.zeros(0, np.uint64))
            found.add(found.home, bits, own=True)
            return found

        for batch in batches:
            leaf, chunk = batch.column("leaf").to_numpy(), batch.column("chunk").to_numpy()
            is_home = batch.column("home").to_numpy(zero_copy_only=False)
            fp = batch.column("fp").to_numpy().view(np.uint64)
            cut = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(chunk) != 0)) + 1
            for part in np.split(np.arange(len(fp)), cut):
                if not len(part):
                    continue
                key = (leaf[part[0]], chunk[part[0]])
                if key != at:
                    if at is not None:
                        yield edges(now or settled())
                    held, now, at = [], None, key
                mine, others = part[is_home[part]], part[~is_home[part]]
                if len(mine):
                    held.append(fp[mine])
                if len(others):
                    now = now or settled()
                    now.add(fp[others], bits)
        if at is not None:
            yield edges(now or settled())

    dealt = fps.mapInArrow(deal, "leaf long, chunk long, home boolean, fp long")
    return (dealt.repartition(shuffle_partitions(spark), "leaf", "chunk")
            .sortWithinPartitions("leaf", "chunk", F.desc("home"))
            .mapInArrow(meet, "a long, b long"))


def join_counted(left: DataFrame, right: DataFrame, key: str, parts: int) -> DataFrame:
    """``left`` with the row of ``right`` that has its key; ``right`` counts them in ``n``.

    Keys of more than a task's share of the rows, of which there are fewer than ``parts``, are
    joined where the rows are; only the others are shuffled.
    """
    rows = right.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = F.col("n") > rows / parts
    hot = F.broadcast(right.filter(frequent).drop("n"))         # under ``parts`` rows
    rest = left.join(hot, key, "left_anti").join(right.filter(~frequent).drop("n"), key)
    return left.join(hot, key).unionByName(rest)


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, bits: int = MAX_BITS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Null and empty texts have fingerprint zero, which links like any other.  Repeated rows
    and copies share a fingerprint and so a component.  A null id takes part in linking
    but is never a component's id; a component of null ids only has a null id.  An empty
    table gives an empty result.  Extra columns are not read.
    """
    prints = stage(fingerprints(docs, size, id_col, text_col), "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(
        F.min("doc_id").alias("first_doc"), F.count("*").alias("n")), "distinct")
    stars = stage(components(links(distinct.select("fp"), bits)), "components")
    rooted = stage(distinct.join(stars, distinct["fp"] == stars["node"], "left").select(
        "fp", "first_doc", F.col("n").alias("rows"), F.coalesce("root", "fp").alias("root")),
        "rooted")
    least = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"),
                                       F.count("*").alias("n"))
    parts = shuffle_partitions(docs.sparkSession)
    by_print = stage(join_counted(rooted, stage(least, "least"), "root", parts).select(
        "fp", "component_id", F.col("rows").alias("n")), "by-print")
    return join_counted(prints, by_print, "fp", parts).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
