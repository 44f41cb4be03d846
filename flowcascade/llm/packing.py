"""Sum-of-squares online packing of token sequences into windows of fixed length.

Every document is tokenised whole.  Full windows are cut off its front; what remains is
one item for the online packer, which looks at the number of partially filled windows per
fill level and puts the item where the sum of the squares of these numbers grows least.
When a partition ends, the windows still open are emptied into each other, cutting their
items, so that at most one window per partition needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from flowcascade.llm.common import id_and_text
from flowcascade.llm.encoding import PieceEncoder, public_vocabulary, shared_encoder

WINDOW = 1024
END_OF_TEXT = 0


def public_encoder() -> PieceEncoder:
    return shared_encoder(public_vocabulary())


class SumOfSquares:
    """Online packer with a level array.

    ``level[h]`` is the number of open windows filled to ``h``; placing an item of size s
    into one of them changes the sum of squares by
    2 (level[h + s] - level[h]) + 2, a new window by 2 level[s] + 1, closing a window by
    1 - 2 level[h].  Ties go to the fullest window.
    """

    def __init__(self, size: int):
        self.size = size
        self.level = np.zeros(size + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def place(self, item: int) -> tuple[int, int]:
        """The fill level (0: a new window) and the window number (-1: new) for the item."""
        room = self.size - item
        costs = 2 * (self.level[item:self.size + 1] - self.level[:room + 1]) + 2
        costs[room] = 1 - 2 * self.level[room]
        costs[0] = 2 * self.level[item] + 1 if room else 0
        usable = self.level[:room + 1] > 0
        usable[0] = True
        at = room - int(np.argmin(np.where(usable, costs, np.iinfo(np.int64).max)[::-1]))
        if at == 0:
            return 0, -1
        self.level[at] -= 1
        return at, self.open[at].pop()

    def keep(self, window: int, fill: int) -> None:
        if fill < self.size:
            self.level[fill] += 1
            self.open[fill].append(window)

    def left(self) -> list[int]:
        """Open windows, the fullest first."""
        return [w for fill in range(self.size, 0, -1) for w in self.open[fill]]


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
    ("offset", pa.int64())])
COLUMNS = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
           "sequence_id long, offset long")
FLUSH_ROWS = 50_000
MAX_OPEN_IDS = 4_000_000        # ids that a partition may hold in open windows


class Packer:
    """Packs the documents of one partition, in order; sequence ids are its own.

    Open windows hold at most ``max_open_ids`` ids and one rest.  When there are more, all of
    them are emptied into each other as at the end, so each such time pads one window more.
    """

    def __init__(self, size: int, first: int, max_open_ids: int = MAX_OPEN_IDS):
        self.size, self.next, self.max_open_ids = size, first, max_open_ids
        self.rows: list[tuple] = []
        self._reopen()

    def _reopen(self) -> None:
        self.bins = SumOfSquares(self.size)
        self.items: dict[int, list[tuple]] = {}     # open window: (doc, start, ids, total)
        self.held = 0

    def _window(self) -> int:
        self.next += 1
        return self.next - 1

    def _emit(self, window: int, items: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in items:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total,
                              window, at))
            at += len(ids)

    def add(self, doc: int | None, found: np.ndarray) -> None:
        ids = np.append(found, END_OF_TEXT).astype("<u4")
        total, full = len(ids), len(ids) // self.size * self.size
        for start in range(0, full, self.size):
            self._emit(self._window(), [(doc, start, ids[start:start + self.size], total)])
        if full == total:
            return
        rest = (doc, full, ids[full:].copy(), total)
        size = total - full
        fill, window = self.bins.place(size)
        if window < 0:
            window = self._window()
            self.items[window] = []
        self.items[window].append(rest)
        self.held += size
        if fill + size == self.size:
            self._emit(window, self.items.pop(window))
            self.held -= self.size
        else:
            self.bins.keep(window, fill + size)
        if self.held > self.max_open_ids:
            self.close()

    def close(self) -> None:
        """Fill the open windows up with items of the emptiest, cut where they must be."""
        order = self.bins.left()
        fills = {w: sum(len(i[2]) for i in self.items[w]) for w in order}
        kept: dict[int, list[tuple]] = {w: list(self.items[w]) for w in order}
        low = len(order) - 1
        for high, window in enumerate(order):
            while fills[window] < self.size and low > high:
                donor = order[low]
                if not kept[donor]:
                    low -= 1
                    continue
                doc, start, ids, total = kept[donor].pop()
                room = self.size - fills[window]
                kept[window].append((doc, start, ids[:room], total))
                moved = min(room, len(ids))
                fills[window] += moved
                fills[donor] -= moved
                if len(ids) > room:
                    kept[donor].append((doc, start + room, ids[room:], total))
        for window in order:
            if kept[window]:
                self._emit(window, kept[window])
        self._reopen()

    def drain(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(SCHEMA)
        self.rows = []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, SCHEMA.types)], schema=SCHEMA)


def pack_documents(docs: DataFrame, window: int = WINDOW, encoder=public_encoder,
                   id_col: str = "doc_id", text_col: str = "text",
                   max_open_ids: int = MAX_OPEN_IDS) -> DataFrame:
    """One row per piece of a document.

    ``encoder`` is a function without arguments that makes an object whose ``encode`` gives
    the ids of every text of a list.  ``max_open_ids`` bounds the ids that a partition holds
    for windows that are not full; it decides about padding, never about what is packed.
    Null and empty texts are one id (the end mark).  Null ids stay null, repeated rows are
    packed each, an empty table gives an empty result, other columns are not read.  Texts
    are never shortened; a text of any length is cut into whole windows and one rest.

    Partitions pack on their own, so no task sees more than its partition, and a task that
    runs again packs its rows in the same way.  Sequence ids start at partition << 32.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, TaskContext.get().partitionId() << 32, max_open_ids)
        make = encoder()
        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(),
                                make.encode(batch.column("text").to_pylist())):
                packer.add(doc, ids)
                if len(packer.rows) >= FLUSH_ROWS:
                    yield packer.drain()
        packer.close()
        yield packer.drain()

    return id_and_text(docs, id_col, text_col).mapInArrow(pack, COLUMNS)
