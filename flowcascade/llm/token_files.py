"""Token ids as Arrow stream files of equal-length sequences, read back without copying.

Documents are put in order, encoded, and their ids cut into sequences of ``WIDTH``.  A file
is an Arrow stream whose batches all hold ``BATCH`` sequences as fixed-size lists of ids and
of mask bits (0: padding at the end of the file).  As all batches but the last take the same
number of bytes, any sequence is found by arithmetic and read off a memory map as it lies
there; no footer or table of offsets is needed.  A second stream beside it says where each
document starts.

Tasks write under names of their own, and the table of the files names those of the attempt
that counted, so a task that runs again or twice leaves no wrong file in it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowcascade.llm.common import id_and_text
from flowcascade.llm.encoding import public_vocabulary, shared_encoder
from flowcascade.session import stage, stage_path

WIDTH = 1024            # ids of a sequence
BATCH = 64              # sequences of a batch
END = 2                 # id after every document

INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
FILES = "shard int, folder string, name string, documents long, tokens long, sequences long"
FOUND = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _located(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _opened(folder: str, name: str):
    """A memory map of a file in a shared folder, elsewhere a file that reads ranges."""
    files, root = _located(folder)
    if isinstance(files, pafs.LocalFileSystem):
        return pa.memory_map(f"{root}/{name}")
    return files.open_input_file(f"{root}/{name}")


class SequenceWriter:
    """Cuts a run of ids into sequences; holds one batch of them."""

    def __init__(self, sink, kind: np.dtype, width: int = WIDTH, batch: int = BATCH):
        self.width, self.batch = width, batch
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), width)),
                                 ("mask", pa.list_(pa.bool_(), width))])
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.ids = np.zeros(width * batch, kind)
        self.filled = self.tokens = self.sequences = 0

    def add(self, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, len(self.ids) - self.filled)
            self.ids[self.filled:self.filled + n] = ids[at:at + n]
            self.filled, at = self.filled + n, at + n
            if self.filled == len(self.ids):
                self._flush()
        self.tokens += len(ids)

    def _flush(self) -> None:
        rows = -(-self.filled // self.width)
        size = rows * self.width
        self.ids[self.filled:size] = 0
        mask = np.arange(size) < self.filled
        self.out.write_batch(pa.RecordBatch.from_arrays([
            pa.FixedSizeListArray.from_arrays(pa.array(self.ids[:size]), self.width),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.width)], schema=self.schema))
        self.sequences += rows
        self.filled = 0

    def close(self) -> None:
        if self.filled:
            self._flush()
        self.out.close()


class SequenceFile:
    """Random access to the sequences of one file; ids are views of the map, not copies."""

    def __init__(self, source, sequences: int):
        self.source, self.sequences = source, sequences
        self.schema = pa.ipc.read_schema(pa.ipc.read_message(source))
        self.width = self.schema.field("ids").type.list_size
        self.first, self.rows, self.step, self.held = source.tell(), 1, 0, (-1, None)
        if sequences:
            batch = self._read(self.first)
            self.rows, self.step = batch.num_rows, source.tell() - self.first

    def _read(self, place: int) -> pa.RecordBatch:
        self.source.seek(place)
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)

    def __len__(self) -> int:
        return self.sequences

    def _batch(self, number: int) -> pa.RecordBatch:
        if self.held[0] != number:
            self.held = number, self._read(self.first + number * self.step)
        return self.held[1]

    def _column(self, name: str, number: int) -> tuple[pa.Array, int]:
        if not 0 <= number < self.sequences:
            raise IndexError(number)
        batch, row = divmod(number, self.rows)
        return self._batch(batch).column(name).values, row * self.width

    def ids(self, number: int) -> np.ndarray:
        values, at = self._column("ids", number)
        return values.to_numpy(zero_copy_only=True)[at:at + self.width]

    def mask(self, number: int) -> pa.BooleanArray:
        values, at = self._column("mask", number)
        return values.slice(at, self.width)

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """``n`` ids from ``start``, in as many views as batches hold them."""
        size = self.rows * self.width
        while n > 0:
            batch, at = divmod(start, size)
            values = self._batch(batch).column("ids").values.to_numpy(zero_copy_only=True)
            part = values[at:at + n]
            yield part
            start, n = start + len(part), n - len(part)


def write_token_files(docs: DataFrame, vocabulary: Callable[[], str] = public_vocabulary,
                      end: int = END, width: int = WIDTH, batch: int = BATCH,
                      folder: str | None = None, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Encode ``docs`` in ascending order of id and write them; the table of the files.

    Null texts are empty, so the end id alone.  Null ids come first; rows of equal id are
    ordered by a hash of the text and by their place in the input.  An empty table writes no
    file.  The order is made by range partitions over id, hash and place, so that not even
    rows of one id need to be in one task.  A task holds one batch of sequences and one group
    of texts.  ``folder`` must be one that all executors reach; by default it is a new one
    in ``spark.checkpoint.dir``.
    """
    spark = docs.sparkSession
    folder = folder or stage_path(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for data in batches:
            if not data.num_rows:
                continue
            if encoder is None:
                encoder = shared_encoder(vocabulary())
                last = np.array([end], encoder.kind)
                shard = TaskContext.get().partitionId()
                name = f"{shard:06d}-{uuid.uuid4().hex}"
                files, root = _located(folder)
                files.create_dir(root, recursive=True)
                sink = files.open_output_stream(f"{root}/{name}.arrow")
                index_sink = files.open_output_stream(f"{root}/{name}-documents.arrow")
                out = SequenceWriter(sink, encoder.kind, width, batch)
                index, documents = pa.ipc.new_stream(index_sink, INDEX), 0
            starts, sizes = [], []
            for ids in encoder.encode(data.column("text").to_pylist()):
                starts.append(out.tokens)
                sizes.append(len(ids) + 1)
                out.add(ids)
                out.add(last)
            index.write_batch(pa.RecordBatch.from_arrays(
                [data.column("doc_id"), pa.array(starts, pa.int64()),
                 pa.array(sizes, pa.int64())], schema=INDEX))
            documents += len(sizes)
        if encoder is None:
            return
        out.close()
        index.close()
        sink.close()
        index_sink.close()
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int32()), "folder": [folder], "name": [name],
            "documents": [documents], "tokens": [out.tokens], "sequences": [out.sequences]})

    rows = id_and_text(docs, id_col, text_col).withColumns({
        "__hash": F.xxhash64("text"), "__place": F.monotonically_increasing_id()})
    keys = ["doc_id", "__hash", "__place"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stage(ordered.select("doc_id", "text").mapInArrow(write, FILES), "token-files")


def read_documents(files: DataFrame) -> DataFrame:
    """Per document, from the files: its place in the whole run of ids, its ids' number and crc.

    The ids before a file are summed over the table of files, one row per writing task.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entry in (row for data in batches for row in data.to_pylist()):
            stream = SequenceFile(_opened(entry["folder"], entry["name"] + ".arrow"),
                                  entry["sequences"])
            index = pa.ipc.open_stream(
                _opened(entry["folder"], entry["name"] + "-documents.arrow"))
            for rows in index:
                sums = []
                for start, n in zip(rows.column("start").to_pylist(),
                                    rows.column("n_tokens").to_pylist()):
                    crc = 0
                    for part in stream.tokens(start, n):
                        crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                    sums.append(crc)
                starts = rows.column("start").to_numpy() + entry["before"]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(starts), rows.column("n_tokens"),
                     pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("before", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))
    spread = placed.repartitionByRange(max(files.count(), 1), "shard")
    return spread.mapInArrow(read, FOUND)


def encode_documents(docs: DataFrame, **options) -> DataFrame:
    """Write the token files of ``docs`` and read every document back from them.

    Nulls, order, repeated rows, long texts and empty tables as in ``write_token_files``;
    other columns are not read.
    """
    return read_documents(write_token_files(docs, **options))
