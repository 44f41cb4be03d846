"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and benchmark items are sequences of words.  The CGK random walk maps a sequence to
one of twice its length so that a small edit distance becomes a small Hamming distance.
Windows of an item's size are embedded with the same random walks as the items, positions
of the embedding are sampled, and windows that agree with an item on one sample are its
candidates.  Candidates are verified by the exact edit distance.

A window within k edits of an item of n words shares a run of (n - k) // (k + 1) words
with it, so windows away from every such run are not embedded; this loses nothing.

The size and number of samples are measured for each item length on edited copies of its
items.  Lengths whose copies the walks do not all meet are not walked: all places that share
enough runs with an item are verified, which loses nothing either.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowcascade.llm.common import id_and_text, map_whole_rows, named

MAX_EDITS = 0.15         # of an item's words
RECALL = 0.99            # wanted chance of meeting a passage with that many edits
SAMPLED = 4              # positions per sample, fewer where these are not enough
RUN = 4                  # longest run of words that is looked up
BLOCK_ITEMS = 2000       # items, and their words, compared in one pass over the texts
BLOCK_WORDS = 400_000
MAX_WALKS = 64           # items of lengths that need more, and longer items, are verified
WALKED_WORDS = 64        # wherever they share runs with a text
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 22
OTHER, PAD = 0, -1       # a word in no item; beyond the end of a window


def words_of(text: str) -> list[str]:
    return text.lower().split()


def allowed_edits(n: int, ratio: float) -> int:
    return int(n * ratio)


def edit_positions(pattern: list, text: list) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of the text, and the first end of one.

    Bit-parallel: one big integer holds a column of the distance table.
    """
    m = len(pattern)
    masks: dict = {}
    for i, word in enumerate(pattern):
        masks[word] = masks.get(word, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, word in enumerate(text):
        eq = masks.get(word, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(xh | plus) & full, plus & xh
        score += bool(up & high) - bool(down & high)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(xv | up) & full, up & xv
        if score < best:
            best, end = score, at + 1
    return best, end


class Items:
    """One block of benchmark items with its random walks and sample tables."""

    def __init__(self, items: list[tuple[int | None, list[str]]], ratio: float = MAX_EDITS,
                 recall: float = RECALL, sampled: int = SAMPLED, seed: int = 1,
                 plan: dict[int, tuple[int, int]] | None = None):
        self.ids = [i for i, _ in items]
        words = sorted({w for _, ws in items for w in ws})
        self.vocabulary = {w: k + 1 for k, w in enumerate(words)}
        self.items = [[self.vocabulary[w] for w in ws] for _, ws in items]
        self.sizes = np.array([len(i) for i in self.items], np.int64)
        self.edits = np.array([allowed_edits(n, ratio) for n in self.sizes], np.int64)
        self.longest = int(self.sizes.max(initial=0))
        draw = np.random.default_rng(seed)
        short = np.unique(self.sizes[(self.sizes > 0) & (self.sizes <= WALKED_WORDS)])
        steps = 2 * int(short.max(initial=1))
        self.coins = draw.integers(0, 1 << 62, (MAX_WALKS, steps), dtype=np.uint64) | np.uint64(1)
        # order in which the steps of a walk are sampled, by item length; a window of n words
        # is walked 2 n steps
        self.order = np.full((MAX_WALKS, WALKED_WORDS + 1, steps), sampled, np.int64)
        for walk in range(MAX_WALKS):
            for n in short:
                picked = draw.choice(2 * n, min(sampled, 2 * n), replace=False)
                self.order[walk, n, picked] = np.arange(len(picked))
        self.positions = np.zeros(WALKED_WORDS + 1, np.int64)
        # item length: (positions per sample, walks); other lengths are not walked
        self.plan = self._plan(short, recall, sampled, draw) if plan is None else plan
        for n, (positions, _) in self.plan.items():
            self.positions[n] = positions
        self.tables = self._tables()
        self.runs, self.exact_runs = self._run_tables()

    def keys(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray,
             walk: int) -> np.ndarray:
        """Hash of the sampled positions of the embedding of each window."""
        at = np.zeros(len(starts), np.int64)
        key = sizes.astype(np.uint64)
        last = int(sizes.max(initial=0)) * 2
        for step in range(last):
            inside = at < sizes
            place = np.clip(starts + np.minimum(at, sizes - 1), 0, len(text) - 1)
            seen = starts + at
            symbol = np.where(inside & (seen >= 0) & (seen < len(text)), text[place], PAD)
            wanted = self.order[walk, sizes, step] < self.positions[sizes]
            code = (symbol + 2).astype(np.uint64)
            key = np.where(wanted, (key * _MIX) ^ (code + (key >> np.uint64(29))), key)
            coin = (code * self.coins[walk, step] * _MIX) >> np.uint64(63)
            at += np.where(inside, coin.astype(np.int64), 0)
        return key

    def _edited(self, item: int, draw) -> list[int]:
        """A copy of an item with as many edits as are allowed, filled up to its length."""
        words = list(self.items[item])
        for _ in range(self.edits[item]):
            kind, place = draw.integers(3), int(draw.integers(len(words)))
            if kind == 0:
                words[place] = OTHER
            elif kind == 1:
                words.insert(place, OTHER)
            elif len(words) > 1:
                del words[place]
        return words + [OTHER] * (len(self.items[item]) - len(words))

    def _plan(self, lengths: np.ndarray, recall: float, sampled: int,
              draw) -> dict[int, tuple[int, int]]:
        """Per item length the most positions whose walks meet the edited copies of its items,
        and twice the walks after which all of them are met.

        If a share of more than 1 - ``recall`` of all copies were still missed, the copies
        drawn would all be met with a chance of less than 5 %.
        """
        if recall >= 1:
            return {}
        plan, left = {}, [int(n) for n in lengths]
        for positions in range(sampled, 1, -1):
            copies = []
            for n in left:
                items = np.flatnonzero(self.sizes == n)
                each = max(4, math.ceil(3 / (1 - recall) / len(items)))
                copies += [i for i in items for _ in range(each if self.edits[i] else 1)]
            if not copies:
                break
            texts = [self._edited(i, draw) for i in copies]
            flat, sizes = np.concatenate(texts).astype(np.int64), self.sizes[copies]
            starts = np.append(0, np.cumsum([len(t) for t in texts])[:-1])
            plain = np.concatenate([self.items[i] for i in copies]).astype(np.int64)
            plain_starts = np.append(0, np.cumsum(sizes)[:-1])
            self.positions[left] = positions
            met = np.zeros(len(copies), np.int64)       # the first walk that met the copy
            for walk in range(MAX_WALKS // 2):
                rest = np.flatnonzero(met == 0)
                same = (self.keys(flat, starts[rest], sizes[rest], walk)
                        == self.keys(plain, plain_starts[rest], sizes[rest], walk))
                met[rest[same]] = walk + 1
            for n in list(left):
                walks = met[sizes == n]
                if walks.all():
                    plan[n] = (positions, 2 * int(walks.max()))
                    left.remove(n)
        return plan

    def _tables(self) -> list[dict[int, list[int]]]:
        text = np.array([w for i in self.items for w in i] or [0], np.int64)
        starts = np.append(0, np.cumsum(self.sizes)[:-1]) if len(self.sizes) else self.sizes
        tables = []
        for walk in range(max((w for _, w in self.plan.values()), default=0)):
            table: dict[int, list[int]] = {}
            walked = self._walked(self.sizes, walk)
            keys = self.keys(text, starts[walked], self.sizes[walked], walk)
            for i, key in zip(walked.tolist(), keys.tolist()):
                table.setdefault(key, []).append(i)
            tables.append(table)
        return tables

    def _walked(self, sizes: np.ndarray, walk: int) -> np.ndarray:
        """Which of the windows take part in a walk."""
        return np.flatnonzero(np.isin(sizes, [n for n, (_, w) in self.plan.items() if walk < w]))

    def _run_tables(self) -> tuple[dict, dict]:
        """By run length: which hashes occur, and what has a run of each hash.

        For walked lengths that is (item length, offset, edits), for the others
        (item number, offset).
        """
        walked: dict[int, tuple[np.ndarray, dict]] = {}
        exact: dict[int, tuple[np.ndarray, dict]] = {}
        for number, item in enumerate(self.items):
            n, k = len(item), int(self.edits[number])
            if not n:
                continue
            q = run_length(n, k)
            marked, places = (walked if n in self.plan else exact).setdefault(
                q, (np.zeros(1 << _TABLE_BITS, bool), {}))
            for offset, h in enumerate(run_hashes(np.array(item, np.int64), q).tolist()):
                marked[h >> (64 - _TABLE_BITS)] = True
                places.setdefault(h, set()).add(
                    (n, offset, k) if n in self.plan else (number, offset))
        return walked, exact

    def windows(self, text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of the windows that may match; none reaches past its text."""
        found: set[tuple[int, int]] = set()
        for at, places in run_hits(self.runs, text):
            for n, offset, k in places:
                found.update((s, n) for s in range(at - offset - k, at - offset + k + 1))
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

    def shared(self, text: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """Starts in the text of the windows of items that are not walked, by (text, item).

        k edits leave n - q + 1 - k q of an item's runs of q words, and move each by at most
        k words, so starts with fewer others around them are left out.
        """
        found: dict[tuple[int, int], list[int]] = {}
        for at, places in run_hits(self.exact_runs, text):
            doc = int(np.searchsorted(first, at, "right")) - 1
            for item, offset in places:
                found.setdefault((doc, item), []).append(at - offset)
        kept = {}
        for (doc, item), places in found.items():
            n, k = int(self.sizes[item]), int(self.edits[item])
            q = run_length(n, k)
            starts = np.sort(np.array(places, np.int64))
            end = np.searchsorted(starts, starts + 2 * k, "right")
            here = np.arange(len(starts))
            enough = np.flatnonzero(end - here >= max(1, n - q + 1 - k * q))
            if len(enough):
                inside = np.zeros(len(starts) + 1, np.int64)
                np.add.at(inside, here[enough], 1)
                np.add.at(inside, end[enough], -1)
                kept[doc, item] = starts[np.cumsum(inside[:-1]) > 0].tolist()
        return kept

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item number, distance, first word, end) of the best place of each
        item in each text that lies within the allowed edits."""
        get = self.vocabulary.get
        split = [[get(w, OTHER) for w in words_of(t)] for t in texts]
        gap = self.longest          # unknown words between texts keep windows apart
        first, flat, at = [], [], 0
        for words in split:
            first.append(at)
            flat += words
            flat += [OTHER] * gap
            at += len(words) + gap
        text = np.array(flat, np.int64)
        ends = np.array([f + len(w) for f, w in zip(first, split)], np.int64)
        starts, sizes = self.windows(text, ends)
        # a window that begins before its text is owned by the text its middle lies in
        owner = np.clip(np.searchsorted(np.array(first), starts + sizes // 2, "right") - 1, 0, None)
        candidates = self.shared(text, np.array(first))
        for walk, table in enumerate(self.tables):
            walked = self._walked(sizes, walk)
            keys = self.keys(text, starts[walked], sizes[walked], walk)
            for n, key in zip(walked.tolist(), keys.tolist()):
                for item in table.get(key, ()):
                    candidates.setdefault((int(owner[n]), item), []).append(int(starts[n]))
        found = []
        for (doc, item), places in sorted(candidates.items()):
            best = self._verify(split[doc], item, sorted({p - first[doc] for p in places}))
            if best:
                found.append((doc, item, *best))
        return found

    def _verify(self, words: list[int], item: int, places: list[int]) -> tuple | None:
        n, k, best = int(self.sizes[item]), int(self.edits[item]), None
        i = 0
        while i < len(places):
            j = i
            while j + 1 < len(places) and places[j + 1] - places[j] <= n:
                j += 1
            low, high = max(0, places[i] - k), places[j] + n + 2 * k
            part = words[low:high]
            i = j + 1
            distance, end = edit_positions(self.items[item], part)
            if distance <= k and (best is None or distance < best[0]):
                # the shortest part with this distance that ends there
                _, back = edit_positions(self.items[item][::-1], part[:end][::-1])
                best = (distance, low + end - back, low + end)
        return best


def run_length(n: int, k: int) -> int:
    """Words of a run that an item of n words shares with all windows within k edits."""
    return min(RUN, max(1, (n - k) // (k + 1)))


def run_hits(runs: dict[int, tuple[np.ndarray, dict]],
             text: np.ndarray) -> Iterator[tuple[int, set[tuple]]]:
    """Where a run of known words is one of the table, and what has that run."""
    known = text > 0
    for q, (marked, places) in runs.items():
        if len(text) < q:
            continue
        hashes = run_hashes(text, q)
        whole = reduce(np.logical_and, [known[i:len(text) - q + 1 + i] for i in range(q)])
        hits = np.flatnonzero(whole & marked[(hashes >> np.uint64(64 - _TABLE_BITS))
                                             .astype(np.int64)])
        for at, h in zip(hits.tolist(), hashes[hits].tolist()):
            if h in places:
                yield at, places[h]


def run_hashes(text: np.ndarray, q: int) -> np.ndarray:
    total = np.zeros(max(0, len(text) - q + 1), np.uint64)
    for i in range(q):
        total = (total + text[i:len(total) + i].astype(np.uint64)) * _MIX
        total ^= total >> np.uint64(31)
    return total * _MIX


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list]:
    """The query set in blocks of bounded size; only one partition is on the driver at a time."""
    block, n = [], 0
    rows = benchmark.select(named(item_col).cast("long"), named(text_col).cast("string"))
    for item, text in rows.toLocalIterator():
        words = words_of(text or "")
        if not words:
            continue
        if block and (len(block) == BLOCK_ITEMS or n + len(words) > BLOCK_WORDS):
            yield block
            block, n = [], 0
        block.append((item, words))
        n += len(words)
    if block:
        yield block


COLUMNS = ("doc_id long, item_id long, item_words long, distance long, first_word long, "
           "end_word long")


def find_leaks(docs: DataFrame, benchmark: DataFrame, ratio: float = MAX_EDITS,
               recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item found in it, at the place of least edit distance.

    Words are lower-cased and split at white space; ``distance`` counts inserted, removed
    and replaced words and is at most ``ratio`` of the item's words.  Null and empty texts
    hold nothing, null and empty items are found nowhere.  Null ids stay null, repeated
    documents and items are reported each.  Empty tables give an empty result.  Other
    columns are not read.

    The items are the query set: every block of them is compared with all documents in a
    pass without a shuffle.
    """
    texts = id_and_text(docs, id_col, text_col)
    results = []
    for block in item_blocks(benchmark, item_col, item_text_col):
        def search(batches: Iterator[pa.RecordBatch], block=block,
                   plan=Items(block, ratio, recall).plan) -> Iterator[pa.RecordBatch]:
            items = Items(block, ratio, recall, plan=plan)
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[d], items.ids[i], int(items.sizes[i]), distance, a, b)
                        for d, i, distance, a, b in
                        items.search(batch.column("text").to_pylist())]
                columns = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns],
                    names=[c.split()[0] for c in COLUMNS.split(", ")])
        results.append(texts.mapInArrow(search, COLUMNS))
    if not results:
        return docs.sparkSession.createDataFrame([], COLUMNS)
    return reduce(DataFrame.unionAll, results)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, ratio: float = MAX_EDITS,
               recall: float = RECALL, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text") -> DataFrame:
    """The documents, all columns as they are, in which no item is found.

    Null and empty texts, and null and empty items, match nothing; repeated rows are judged
    each; an empty table gives an empty result.
    """
    at = docs.columns.index(text_col)
    for block in item_blocks(benchmark, item_col, item_text_col):
        def keep(batches: Iterator[pa.RecordBatch], block=block,
                 plan=Items(block, ratio, recall).plan) -> Iterator[pa.RecordBatch]:
            items = Items(block, ratio, recall, plan=plan)
            for batch in batches:
                texts = [t or "" for t in batch.column(at).to_pylist()]
                leaky = {d for d, *_ in items.search(texts)}
                yield batch.filter(pa.array([i not in leaky for i in range(len(texts))],
                                            pa.bool_()))
        docs = map_whole_rows(docs, keep)
    return docs
