"""Removal of long repeated byte strings by prefix-free parsing.

Every text is parsed into phrases by triggers: the 24-byte string with the least rolling
hash among neighbours.  Each string of 50 bytes has exactly one trigger, found from its
bytes alone, so the strings with one trigger form a phrase, neighbouring phrases overlap by
49 bytes, and equal strings lie in phrases of equal triggers.  The dictionary holds each
phrase once.  With this overlap the first 50 bytes of a suffix never reach beyond its
phrase, so the order of the parse is never needed to break a tie.

Documents are dealt into blocks by ranges of their ids, about equal in bytes, so an earlier
document is one in an earlier block or earlier in the same block.  Two rounds follow.

1. Every block sends its dictionary, a trigger and a digest of its phrase per entry.  Where
   all blocks have one phrase for a trigger, its strings are settled at once.
2. Of triggers with several phrases, the suffixes of the dictionary's phrases are sorted;
   each distinct one is sent, and the answer says whether an earlier block has it.

A block sends an entry once however often it holds it, so a passage that many documents
share costs one entry per block.  Strings are compared by 64-bit digests.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowcascade.llm.common import named, shuffle_partitions

LENGTH = 50              # bytes of a repeated string; the digests below are made for it
TRIGGER = 24
NEIGHBOURS = LENGTH - TRIGGER + 1
BLOCK_BYTES = 8 << 20
CHUNK = 1 << 18          # bytes hashed at a time
PLACE_BITS = 20          # of a position in a chunk; a chunk is shorter than 1 << 20
NO_ID = 2**63 - 1        # a null id comes after all others

_A, _B, _C = (np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= _C
    h ^= h >> np.uint64(32)
    return h


def _pair_digests() -> np.ndarray:
    pairs = np.arange(1 << 16, dtype=np.uint64)
    return _mix(_mix((pairs + np.uint64(1)) * _A) * _B)


_PAIRS = _pair_digests()


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = left * _A
    h += right
    h *= _B
    return _mix(h)


def digests(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all strings of 24 bytes and of all strings of 50 bytes of a text."""
    two = _PAIRS[text[:-1].astype(np.uint16) | text[1:].astype(np.uint16) << np.uint16(8)]
    four = _joined(two[:-2], two[2:])
    eight = _joined(four[:-4], four[4:])
    sixteen = _joined(eight[:-8], eight[8:])
    n, m = len(text) - TRIGGER + 1, len(text) - LENGTH + 1
    long = _joined(sixteen[:-16], sixteen[16:])
    return (_joined(sixteen[:n], eight[16:16 + n]),
            _joined(_joined(long[:m], sixteen[32:32 + m]), two[48:48 + m]))


def triggers(short: np.ndarray, n: int) -> np.ndarray:
    """Position of the leftmost least trigger digest of each of the first n windows."""
    place = np.arange(len(short), dtype=np.uint64)
    coded = (short >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | place
    least, width = coded, 1
    while width * 2 <= NEIGHBOURS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = NEIGHBOURS - width
    least = np.minimum(least[:n], least[rest:rest + n])
    return (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)


def pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Chunks of (text number, offset, bytes); long texts are cut so that each string of 50
    bytes lies in one piece."""
    chunk, size = [], 0
    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), CHUNK):
            part = text[at:at + CHUNK + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if chunk and size + len(part) > CHUNK:
                yield chunk
                chunk, size = [], 0
            chunk.append((number, at, part))
            size += len(part)
    if chunk:
        yield chunk


class Block:
    """Parsed documents of one block, in the order of their ids.

    Per phrase occurrence: ``trigger`` and ``phrase`` digests, ``doc`` (rank of the id),
    ``row``, the offset ``start`` of its first string, the number ``count`` of its strings
    and where their digests begin in ``strings``.
    """

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        self.texts = texts
        rank = np.unique(ids, return_inverse=True)[1]
        fields: list[tuple] = []
        strings, done = [], 0
        for chunk in pieces(texts):
            text = np.frombuffer(b"".join(p for _, _, p in chunk), np.uint8)
            ends = np.cumsum([len(p) for _, _, p in chunk])
            begins = np.append(0, ends[:-1])
            short, whole = digests(text)
            trigger = triggers(short, len(whole))
            at = np.arange(len(whole))
            piece = np.searchsorted(ends, at, "right")
            inside = at + LENGTH <= ends[piece]
            at, piece, trigger = at[inside], piece[inside], trigger[inside]
            first = np.flatnonzero(np.append(True, (trigger[1:] != trigger[:-1])
                                             | (piece[1:] != piece[:-1])))
            count = np.diff(np.append(first, len(at)))
            start, last = at[first], at[first + count - 1]
            row = np.array([n for n, _, _ in chunk])[piece[first]]
            offset = np.array([o for _, o, _ in chunk])[piece[first]]
            phrase = _joined(_joined(whole[start], whole[last]),
                             ((last - start) << 8 | (trigger[first] - start)).astype(np.uint64))
            named_trigger = _mix(short[trigger[first]] * _B)
            fields.append((named_trigger, phrase, rank[row], row,
                           start - begins[piece[first]] + offset, count, done + first))
            strings.append(whole[at])
            done += len(at)
        kinds = (np.uint64, np.uint64, *[np.int64] * 5)
        columns = [np.concatenate([f[i] for f in fields]) if fields else np.zeros(0, k)
                   for i, k in enumerate(kinds)]
        (self.trigger, self.phrase, self.doc, self.row, self.start, self.count,
         self.at) = columns
        self.strings = np.concatenate(strings) if strings else np.zeros(0, np.uint64)

    def dictionary(self, buckets: int) -> None:
        """One entry per trigger, by bucket: the digest of its phrase, or that it has several."""
        code = ((self.trigger >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) \
            | self.trigger & np.uint64(0xFFFFFFFF)
        self.code, first, self.entry = np.unique(code, return_index=True, return_inverse=True)
        self.entry_phrase = self.phrase[first]
        self.several = np.zeros(len(self.code), bool)
        self.several[self.entry[self.phrase != self.entry_phrase[self.entry]]] = True

    def suffixes(self, unclear: np.ndarray, buckets: int) -> None:
        """Sorted distinct strings of the phrases whose triggers are ``unclear``."""
        self.open = np.flatnonzero(unclear[self.entry])
        count = self.count[self.open]
        self.open_phrase = np.repeat(np.arange(len(self.open)), count)
        step = np.arange(len(self.open_phrase)) - np.repeat(np.cumsum(count) - count, count)
        self.open_at = self.start[self.open][self.open_phrase] + step
        key = self.strings[self.at[self.open][self.open_phrase] + step]
        bucket = (key >> np.uint64(40)) % np.uint64(buckets)
        order = np.lexsort((key, bucket))
        key, bucket = key[order], bucket[order]
        new = np.append(True, key[1:] != key[:-1])[:len(key)]
        self.key, self.key_bucket = key[new], bucket[new]
        self.open_key = np.empty(len(key), np.int64)
        self.open_key[order] = np.cumsum(new) - 1


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Bucket numbers and where their entries are; ``bucket`` is sorted."""
    found, first = np.unique(bucket, return_index=True)
    for b, i, j in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(bucket)]):
        yield b, slice(i, j)


def least_of(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, group, values)
    return least


SENT = "bucket int, block int, key binary, phrase binary, several binary"
SENT_FIELDS = [c.split()[0] for c in SENT.split(", ")]
ANSWER = "block int, bucket int, turn int, n int, unclear binary, earlier binary"
ANSWER_FIELDS = [c.split()[0] for c in ANSWER.split(", ")]
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _table(rows: list[tuple], names: list[str], kinds: list) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


_SENT_KINDS = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
_ANSWER_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _block_of(table: pa.Table) -> tuple[Block, np.ndarray]:
    ids = table.column("key_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    texts = table.column("text").to_pylist()
    return Block(ids[order], [texts[i] for i in order]), order


def _bits(rows: list[dict], turn: int, field: str, n: int) -> np.ndarray:
    """Answers of a turn, put together in the order of the buckets."""
    parts = [np.unpackbits(np.frombuffer(r[field], np.uint8), count=r["n"])
             for r in sorted(rows, key=lambda r: r["bucket"]) if r["turn"] == turn]
    found = np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)
    if len(found) != n:
        raise ValueError("answers do not fit the block")
    return found


def send_dictionary(table: pa.Table, buckets: int) -> pa.Table:
    block, _ = _block_of(table)
    block.dictionary(buckets)
    number = table.column("block")[0].as_py()
    rows = [(b, number, block.code[s].astype("<u4").tobytes(), block.entry_phrase[s].tobytes(),
             np.packbits(block.several[s]).tobytes())
            for b, s in by_bucket((block.code >> np.uint64(32)).astype(np.int64))]
    return _table(rows, SENT_FIELDS, _SENT_KINDS)


def answer_dictionary(table: pa.Table) -> pa.Table:
    """Which triggers have several phrases, and which phrases an earlier block has."""
    rows = table.to_pylist()
    keys = [np.frombuffer(r["key"], "<u4") for r in rows]
    sizes = [len(k) for k in keys]
    key = np.concatenate(keys)
    phrase = np.concatenate([np.frombuffer(r["phrase"], "<u8") for r in rows])
    several = np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8), count=n)
                              for r, n in zip(rows, sizes)]).astype(bool)
    block = np.repeat(np.array([r["block"] for r in rows]), sizes)
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order][1:] != key[order][:-1])
    group = np.empty(len(key), np.int64)
    group[order] = np.cumsum(new) - 1
    n = int(new.sum())
    one = phrase[order][new][group]
    unclear = np.zeros(n, bool)
    unclear[group[several | (phrase != one)]] = True
    first = least_of(block, group, n)
    return _answers(rows, sizes, 1, unclear[group], block > first[group])


def _answers(rows: list[dict], sizes: list[int], turn: int, unclear: np.ndarray,
             earlier: np.ndarray) -> pa.Table:
    out, at = [], 0
    for row, n in zip(rows, sizes):
        part = slice(at, at + n)
        out.append((row["block"], row["bucket"], turn, n, np.packbits(unclear[part]).tobytes(),
                    np.packbits(earlier[part]).tobytes()))
        at += n
    return _table(out, ANSWER_FIELDS, _ANSWER_KINDS)


def send_suffixes(table: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    block, _ = _block_of(table)
    block.dictionary(buckets)
    block.suffixes(_bits(answers.to_pylist(), 1, "unclear", len(block.code)), buckets)
    number = table.column("block")[0].as_py()
    rows = [(b, number, block.key[s].tobytes(), b"", b"")
            for b, s in by_bucket(block.key_bucket.astype(np.int64))]
    return _table(rows, SENT_FIELDS, _SENT_KINDS)


def answer_suffixes(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    keys = [np.frombuffer(r["key"], "<u8") for r in rows]
    sizes = [len(k) for k in keys]
    block = np.repeat(np.array([r["block"] for r in rows]), sizes)
    found, group = np.unique(np.concatenate(keys), return_inverse=True)
    earlier = block > least_of(block, group, len(found))[group]
    return _answers(rows, sizes, 2, np.zeros(len(block), bool), earlier)


def cut(text: bytes, starts: np.ndarray, counts: np.ndarray) -> tuple[int, int, str]:
    """Bytes and runs removed, and the digest of what stays, for strings to remove given as
    ``counts`` neighbouring strings from ``starts``."""
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + counts + LENGTH - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    spans = int(np.count_nonzero(gone & ~np.append(False, gone[:-1])))
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


def remove(table: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    block, order = _block_of(table)
    replies = answers.to_pylist()
    block.dictionary(buckets)
    unclear = _bits(replies, 1, "unclear", len(block.code))
    earlier = _bits(replies, 1, "earlier", len(block.code))
    block.suffixes(unclear, buckets)
    seen = _bits(replies, 2, "earlier", len(block.key))
    # phrases of triggers that are clear: gone in an earlier block, or in an earlier document
    first = least_of(block.doc, block.entry, len(block.code))
    gone = ~unclear[block.entry] & (earlier[block.entry] | (block.doc > first[block.entry]))
    # the strings of the others, one by one
    doc = block.doc[block.open][block.open_phrase]
    first = least_of(doc, block.open_key, len(block.key))
    single = seen[block.open_key] | (doc > first[block.open_key])
    rows = np.concatenate([block.row[gone], block.row[block.open][block.open_phrase][single]])
    starts = np.concatenate([block.start[gone], block.open_at[single]])
    counts = np.concatenate([block.count[gone], np.ones(int(single.sum()), np.int64)])
    by_row = np.argsort(rows, kind="stable")
    rows, starts, counts = rows[by_row], starts[by_row], counts[by_row]
    bounds = np.searchsorted(rows, np.arange(len(block.texts) + 1))
    ids = table.column("doc_id").to_pylist()
    out = []
    for i, text in enumerate(block.texts):
        part = slice(bounds[i], bounds[i + 1])
        out.append((ids[order[i]], len(text), *cut(text, starts[part], counts[part])))
    return _table(out, [c.split()[0] for c in RESULT.split(", ")],
                  [pa.int64()] * 4 + [pa.string()])


def id_ranges(rows: DataFrame, blocks: int, total: int) -> np.ndarray:
    """Upper ends of all ranges of ``key_id`` but the last, about equal in bytes.

    Taken from a sample in which a row stands in proportion to its bytes.
    """
    step = max(1, total // (blocks * 64))
    drawn = rows.filter(F.pmod(F.xxhash64("key_id"), F.lit(step)) < F.octet_length("text"))
    parts = [i / blocks for i in range(1, blocks)]
    found = drawn.agg(F.percentile_approx("key_id", parts, max(10_000, 20 * blocks))).first()[0]
    return np.unique(np.array(found or [], np.int64))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: bytes, bytes removed, runs removed, digest of what stays.

    A byte goes if it lies in a string of 50 bytes that also starts in a document with a
    smaller id.  Null and empty texts have no bytes.  Rows with equal ids are neither
    smaller than the other; a null id is greater than all others.  An empty table gives an
    empty result.  Extra columns are not read.

    A task holds one block of texts, about ``block_bytes`` (one text at least, and all
    texts of one id), or the entries of one bucket; there are as many buckets as shuffle
    partitions.  The texts are shuffled once; both rounds and the removal read that.
    """
    spark = docs.sparkSession
    rows = docs.select(named(id_col).cast("long").alias("doc_id"),
                       F.coalesce(named(id_col).cast("long"), F.lit(NO_ID)).alias("key_id"),
                       F.coalesce(named(text_col).cast("string"), F.lit("")).cast("binary")
                       .alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = shuffle_partitions(spark)
    blocks = max(math.ceil(total / block_bytes), min(buckets, total >> 16), 1)
    ends = id_ranges(rows, blocks, total) if blocks > 1 else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def block_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield pd.Series(np.searchsorted(ends, ids.to_numpy()).astype(np.int32))

    dealt = rows.withColumn("block", block_of("key_id"))

    def texts():
        return dealt.groupBy("block")

    first = texts().applyInArrow(lambda t: send_dictionary(t, buckets), SENT)
    told = first.groupBy("bucket").applyInArrow(answer_dictionary, ANSWER)
    second = texts().cogroup(told.groupBy("block")).applyInArrow(
        lambda t, a: send_suffixes(t, a, buckets), SENT)
    more = second.groupBy("bucket").applyInArrow(answer_suffixes, ANSWER)
    return texts().cogroup(told.unionAll(more).groupBy("block")).applyInArrow(
        lambda t, a: remove(t, a, buckets), RESULT)
