"""Token files: round trips against the tokenizer, random access, encoding by pieces."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from flowcascade.llm import encoding, token_files
from flowcascade.llm.common import prepare_session
from flowcascade.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, start long, `a.b` string, n_tokens long, shard int"
LONG = " ".join(f"long{i % 7919}" for i in range(60_000))
TEXTS = [(9, "b b"), (1, None), (2, ""), (3, "same"), (3, "same"), (3, "other"), (-4, "é 日本 #"),
         (5, LONG), (6, "x<|endoftext|> y"), (None, "no id"), (7, " \n\t "), (8, "# 2 ###")]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(encoding.public_vocabulary())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, token_files.END]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def table(spark, texts):
    prepare_session(spark)
    return spark.createDataFrame([(i, t, 1, "z", 2, 3) for i, t in texts], SCHEMA)


@pytest.mark.parametrize("partitions", [1, 5])
def test_documents_come_back(spark, tokenizer, partitions):
    found = token_files.encode_documents(table(spark, TEXTS).repartition(partitions)).collect()
    want = sorted((i is not None, i or 0, len(ids_of(tokenizer, t)), crc(ids_of(tokenizer, t)))
                  for i, t in TEXTS)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"])
                  for r in found) == want
    # starts are gapless in ascending order of id, null first
    run = sorted(found, key=lambda r: r["start"])
    assert [r["start"] for r in run] == [0, *np.cumsum([r["n_tokens"] for r in run])[:-1]]
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in run]
    assert keys == sorted(keys)


def test_empty_table(spark):
    assert token_files.encode_documents(table(spark, [])).collect() == []


def test_query_on_a_given_table(spark, tokenizer):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    at, want = 0, set()
    for r in docs:
        ids = ids_of(tokenizer, r["text"])
        want.add((r["doc_id"], at, len(ids), crc(ids)))
        at += len(ids)
    found = QUERIES["op12_token_files"](spark, DATA).collect()
    assert len(found) == len(docs) and {tuple(r) for r in found} == want


def test_sequences_are_views_at_any_place(spark, tokenizer):
    files = token_files.write_token_files(table(spark, TEXTS), width=16, batch=4).collect()
    assert sum(f["documents"] for f in files) == len(TEXTS)
    for f in files:
        with pa.OSFile(f"{f['folder']}/{f['name']}.arrow") as source:
            whole = pa.ipc.open_stream(source).read_all()
        ids = whole["ids"].combine_chunks().flatten().to_numpy()
        mask = np.array(whole["mask"].combine_chunks().flatten().to_pylist())
        assert len(whole) == f["sequences"] and mask.sum() == f["tokens"] == mask.argmin() or (
            mask.all() and len(mask) == f["tokens"])
        assert not ids[f["tokens"]:].any()
        opened = token_files._opened(f["folder"], f["name"] + ".arrow")
        stream = token_files.SequenceFile(opened, f["sequences"])
        before = pa.total_allocated_bytes()
        for i in random.Random(3).sample(range(len(stream)), len(stream)):
            assert (stream.ids(i) == ids[16 * i:16 * i + 16]).all()
            assert stream.mask(i).to_pylist() == mask[16 * i:16 * i + 16].tolist()
        assert pa.total_allocated_bytes() - before < 4096       # nothing was copied
        for start in (0, 5, f["tokens"] - 1):
            n = min(200, f["tokens"] - start)
            joined = np.concatenate([*stream.tokens(start, n)])
            assert (joined == ids[start:start + n]).all()
        with pytest.raises(IndexError):
            stream.ids(len(stream))


def test_a_repeated_task_leaves_no_wrong_file(spark):
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/tokens-twice"
    docs = table(spark, TEXTS)
    first = token_files.write_token_files(docs, folder=folder)
    second = token_files.write_token_files(docs, folder=folder)
    names = [{r["name"] for r in t.collect()} for t in (first, second)]
    assert not names[0] & names[1]
    both = [sorted(map(tuple, token_files.read_documents(t).collect()), key=repr)
            for t in (first, second)]
    assert both[0] == both[1]


ODD = ["", " ", "  ", "\n", " \n a", "a  b", "a \n b", "a　 b", "don't  go", "x<|endoftext|> y",
       " <|endoftext|> ", "a​ b", "᠎ ᠎a", "é è", "1 2 33  4", "\x1c a", "tab\t tab",
       "a   b", "日本 語", " lead", "trail ", "😀 😀", "a\r\n b", "'s 's", "#  #", "we'll've 'tis",
       "x\n\n\ny", "½ ² a²b", "a\x85 b", "…don’t", "A1b2--c_d", "a" * 3000 + " b"]


def test_pieces_encode_as_whole_texts(tokenizer):
    rng = random.Random(5)
    letters = " \n\t a'sté1²½. 　\x85#-日"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
                   for _ in range(2000)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for cached in (0, 10, 500_000):
        encoder = encoding.PieceEncoder(encoding.public_vocabulary(), cached)
        assert encoder.by_piece and encoder.kind.itemsize == 2
        for _ in range(2):              # with an empty and with a filled cache
            assert [x.tolist() for x in encoder.encode(texts)] == want


def test_other_vocabularies_get_whole_texts(tokenizer):
    import public_tokenizers as files
    path = files.path("word_bpe_49k.json")
    encoder, plain = encoding.PieceEncoder(path), Tokenizer.from_file(path)
    assert not encoder.by_piece
    assert [x.tolist() for x in encoder.encode(ODD)] == [
        plain.encode(t, add_special_tokens=False).ids for t in ODD]
