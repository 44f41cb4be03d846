"""Brute-force and edge-case tests of the training-data operators."""

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from flowcascade.llm import (
    chat,
    decontaminate,
    licenses,
    packing,
    quality_rules,
    secrets,
    sharding,
    simhash,
    suffix_dedup,
    urls,
)
from flowcascade.llm.common import prepare_session
from flowcascade.llm.queries import ORACLE

DATA = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "words string, fp long, host string, shard int, `a.b` string")
PROSE = " ".join(f"word{i}" for i in range(120))
LONG = " ".join(f"long{i % 7919}" for i in range(60_000))
SECRET = "password = hunter2secret and AKIA" + "A1" * 10 + " " + "ab12" * 8
TEXTS = [(1, None), (2, ""), (3, PROSE), (3, PROSE), (4, PROSE + " end"), (5, LONG),
         (6, "  \t\n "), (None, PROSE), (7, SECRET + " " + PROSE[:400]), (8, "é ü " * 40)]


def rows_of(texts):
    return [(i, t, "en", None if i == 4 else "s", len(t or ""), "x", 1, "h", 2, "z")
            for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    prepare_session(spark)
    return spark.createDataFrame(rows_of(TEXTS), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def sample(spark):
    prepare_session(spark)
    return spark.read.parquet(f"{DATA}/documents.parquet")


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("operator", [
    quality_rules.judge, suffix_dedup.remove_repeats, licenses.scan_licenses,
    simhash.near_duplicates, secrets.find_secrets, lambda d: sharding.shard_rows(d, 40)])
def test_one_row_per_row(operator, docs, empty):
    ids = Counter(r["doc_id"] for r in operator(docs).collect())
    assert ids == Counter(i for i, _ in TEXTS)
    assert operator(empty).collect() == []


def test_quality_matches_sql(spark, sample):
    duckdb.sql(f"create or replace view documents as from '{DATA}/documents.parquet'")
    got = quality_rules.judge(sample)
    want = duckdb.sql(ORACLE["op1_quality_rules"])
    columns = sorted(got.columns)
    assert tuples(got.select(columns)) == sorted(
        want.project(", ".join(columns)).fetchall(), key=repr)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=4):
    """Smallest id reachable, over rows (id, fingerprint)."""
    group = list(range(len(prints)))
    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= bits and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = defaultdict(list)
    for g, (i, _) in zip(group, prints):
        if i is not None:
            least[g].append(i)
    return [min(least[g], default=None) for g in group]


@pytest.mark.parametrize("source", ["docs", "sample"])
def test_simhash_matches_brute_force(source, request):
    df = request.getfixturevalue(source)
    prints = [(r[0], brute_fingerprint(r[1])) for r in df.select("doc_id", "text").collect()]
    want = [(i, f"{fp:016x}", c) for (i, fp), c in zip(prints, brute_components(prints))]
    assert tuples(simhash.near_duplicates(df)) == sorted(want, key=repr)


@pytest.mark.parametrize("trees", [1, 3, None])
def test_trees_lose_no_link(spark, trees, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 64)
    monkeypatch.setattr(simhash, "CHUNK", 32)
    draw = np.random.default_rng(5)
    base = draw.integers(0, 2**63, 600, dtype=np.uint64)
    moved = base.copy()
    for _ in range(4):
        moved ^= np.uint64(1) << draw.integers(0, 64, 600).astype(np.uint64)
    fps = np.unique(np.concatenate([base, moved]))
    frame = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    stars = {r["node"]: r["root"] for r in simhash.components(
        simhash.links(frame, trees=trees)).collect()}
    want = brute_components([(int(s), int(f)) for s, f in zip(fps.view(np.int64), fps)])
    assert [stars.get(int(f), int(f)) for f in fps.view(np.int64)] == want


def brute_repeats(texts):
    """Per row: bytes removed, runs, digest; strings of 50 bytes of smaller ids go."""
    first, out = {}, []
    key = lambda i: 2**63 - 1 if i is None else i
    data = [(key(i), (t or "").encode()) for i, t in texts]
    for i, b in data:
        for p in range(len(b) - 49):
            s = b[p:p + 50]
            first[s] = min(i, first.get(s, i))
    for (i, b), (doc, _) in zip(data, texts):
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < i:
                gone[p:p + 50] = b"\1" * 50
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [8 << 20, 5000])
@pytest.mark.parametrize("source", ["docs", "sample"])
def test_repeats_match_brute_force(source, block_bytes, request):
    df = request.getfixturevalue(source)
    texts = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = suffix_dedup.remove_repeats(df, block_bytes=block_bytes)
    assert tuples(got) == brute_repeats(texts)


def brute_base(text):
    spans = []
    rules = [(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
              r"([A-Za-z0-9+/_.=-]+)", re.I | re.A, 2, 6),
             (r"AKIA[A-Z0-9]+", 0, 0, 20), (r"[0-9a-f]+", 0, 0, 24)]
    for k, (pattern, flags, group, least) in enumerate(rules):
        spans += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "", flags)
                  if len(m[group]) >= least]
    return sorted(spans)


@pytest.mark.parametrize("source", ["docs", "sample"])
def test_secrets_match_brute_force(source, request):
    df = request.getfixturevalue(source)
    want = []
    for i, t in df.select("doc_id", "text").collect():
        spans = brute_base(t)
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        want.append((i, *(sum(s[1] == k for s in spans) for k in range(3)),
                     hashlib.sha256(joined.encode()).hexdigest()))
    assert tuples(secrets.find_secrets(df).drop("spans")) == sorted(want, key=repr)


def test_redaction_leaves_no_secret(docs):
    clean = secrets.redact_secrets(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert secrets.find_secrets(clean).filter("spans != ''").count() == 0


def test_redaction_leaves_no_key_bytes(spark):
    body = "\n".join(f"MIIBkey{i}+/" + "Qx9Zt7" * 8 for i in range(12)) + "=="
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    other = pem.replace("RSA ", "")
    texts = [(1, f"before\n{pem}\nbetween\n{other}\nafter"), (2, f"before\n{pem[:-20]}"),
             (3, f"before {pem!r} after"), (4, f"before\n{pem.replace('END RSA', 'END EC')}"),
             (5, "BEGIN PRIVATE KEY is prose")]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(docs).collect()}
    assert clean == {1: "before\n[SECRET]\nbetween\n[SECRET]\nafter", 2: "before\n[SECRET]",
                     3: "before '[SECRET]' after", 4: "before\n[SECRET]", 5: texts[4][1]}
    spans = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs).collect()}
    assert spans[1] == (f"private_key:7:{7 + len(pem)},"
                        f"private_key:{16 + len(pem)}:{16 + len(pem) + len(other)}")


def test_shards_move_only_into_the_new_one(docs, sample):
    for df in (docs, sample):
        rows = sharding.shard_rows(df, 40).collect()
        slots = defaultdict(list)
        for r in rows:
            assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
                   for i, t in sample.select("doc_id", "text").collect())
    assert Counter(r[:3] for r in rows) == want


def test_every_placement_has_the_least_sum_of_squares():
    draw = np.random.default_rng(8)
    size = 40
    bins, fills = packing.SumOfSquares(size), {}
    for item in draw.integers(1, size, 2000):
        item = int(item)
        levels = Counter(f for f in fills.values() if f < size)

        def cost(at):
            after = levels.copy()
            after[at] -= at > 0
            after[at + item] += at + item < size
            return sum(v * v for v in after.values())

        usable = [0, *{f for f in levels if levels[f] and f + item <= size}]
        at, window = bins.place(item)
        assert cost(at) == min(map(cost, usable))
        assert at == max(f for f in usable if cost(f) == cost(at))      # ties: the fullest
        window = len(fills) if window < 0 else window
        assert fills.get(window, 0) == at
        fills[window] = at + item
        bins.keep(window, at + item)


@pytest.mark.parametrize("most", [1, 700, 5000, 10 ** 9])
def test_packing_is_a_round_trip(docs, empty, most):
    assert packing.pack_documents(empty).collect() == []
    rows = packing.pack_documents(docs.repartition(2), max_open_ids=most).collect()
    windows = defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    encoder = packing.public_encoder()
    for doc, text in TEXTS:
        if [i for i, _ in TEXTS].count(doc) > 1:
            continue
        ids = np.append(encoder.tokenizer.encode(text or "", add_special_tokens=False).ids,
                        0).astype("<u4")
        pieces = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
                        for r in rows if r["doc_id"] == doc)
        at = 0
        for start, length, crc, total in pieces:
            assert (start, total) == (at, len(ids))
            assert crc == zlib.crc32(ids[start:start + length].tobytes())
            at += length
        assert at == len(ids)


def test_leaks_are_found_and_verified(spark, docs, empty):
    draw = np.random.default_rng(3)
    items = [(i, " ".join(f"w{x}" for x in draw.integers(0, 900, 40))) for i in range(30)]
    texts = []
    for i, text in items:
        words = text.split()
        for at in draw.choice(40, 5, replace=False):
            words[at] = "changed"
        texts.append((i, PROSE + " " + " ".join(words) + " " + PROSE))
    texts += [(100, PROSE), (101, None), (102, "")]
    bench = spark.createDataFrame([*items, (500, None), (501, "")], "item_id long, text string")
    leaky = spark.createDataFrame(rows_of(texts), SCHEMA)
    found = {(r["doc_id"], r["item_id"]): r["distance"]
             for r in decontaminate.find_leaks(leaky, bench).collect()}
    want = {(i, j) for i, t in texts for j, w in items
            if decontaminate.edit_positions(w.split(), (t or "").split())[0] <= 6}
    assert set(found) <= want and len(found) >= 0.95 * len(want)
    assert all(d <= 6 for d in found.values())
    kept = {r["doc_id"] for r in decontaminate.drop_leaks(leaky, bench).collect()}
    assert {100, 101, 102} <= kept and kept == {i for i, _ in texts} - {i for i, _ in found}
    assert decontaminate.find_leaks(empty, bench).collect() == []
    assert decontaminate.drop_leaks(docs, bench.limit(0)).count() == docs.count()


def test_long_items_of_a_mixed_block_are_found():
    draw = np.random.default_rng(8)
    sizes = [20] * 60 + [55] * 6 + [200] * 12
    words = [[f"w{x}" for x in draw.integers(0, 3000, n)] for n in sizes]
    index = decontaminate.Items(list(enumerate(words)))
    asked = found = 0
    for item, n in enumerate(sizes):
        for _ in range(4 if n == 20 else 10):
            copy = list(words[item])
            for _ in range(int(n * 0.15)):
                place = int(draw.integers(len(copy)))
                copy[place:place + int(draw.integers(2))] = ["new"] * int(draw.integers(2))
            copy = PROSE.split() + copy + PROSE.split()
            least, _ = decontaminate.edit_positions(words[item], copy)
            hits = {i: d for _, i, d, *_ in index.search([" ".join(copy)])}
            assert least <= int(n * 0.15)
            asked, found = asked + 1, found + (hits.get(item) == least)
            assert n <= 64 or hits.get(item) == least       # not walked, so none is lost
    assert found >= 0.99 * asked


def test_mined_url_rules_block(spark):
    rows = [(f"http://h{i}.org/casino/bonus{i}?x=1", True) for i in range(60)]
    rows += [(f"http://h{i}.org/news/{i}", False) for i in range(60)] + [(None, True)]
    rules = urls.mine_rules(spark.createDataFrame(rows, "url string, block boolean"))
    pages = spark.createDataFrame([
        (1, "https://new.org/casino/bonus7"), (2, "http://new.org/news/1"), (3, None),
        (4, "no scheme"), (5, "http://Ads.Example.com/en/x"), (6, "http://www.example.com/en/"),
        (7, "http://a.net/es/q?z"), (None, "http://b.net/de/")], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"])
           for r in urls.judge_urls(pages, rules).collect()}
    assert got == {
        1: ("new.org", None, "block"), 2: ("new.org", None, "allow"), 3: ("", None, "allow"),
        4: ("", None, "allow"), 5: ("ads.example.com", "example.com/en/", "block"),
        6: ("www.example.com", "www.example.com/en/", "allow"),
        7: ("a.net", "net/es/", "block"), None: ("b.net", None, "allow")}
    assert urls.judge_urls(pages.limit(0), rules).collect() == []


def test_rare_url_rules_are_mined_in_a_large_table(spark):
    rows = spark.range(20_000).selectExpr(
        "concat('http://h', id, '.org/', if(id < 40, 'casino', 'news')) as url",
        "id < 40 as block")
    found = {tuple(r["tokens"]) for r in urls.mine_rules(rows).collect()}
    assert found == {("path:casino",)}


def test_calls_are_ordered_and_checked(spark):
    calls = spark.createDataFrame([
        (1, "a", 0, "search", '{"query":"q","limit":1.0}', ["b"]),
        (1, "b", 1, "search", '{"limit":2,"query":"r"}', ["c"]),
        (1, "c", 2, "search", "{", None),
        (1, "x", 3, "answer", '{"text":"t"}', ["y"]), (1, "y", 4, "answer", None, ["x"]),
        (2, "a", 0, "answer", '{"text":"t"}', None), (2, "b", 1, "answer", '{"text":""}', ["a"]),
        (None, None, None, None, None, None)],
        "conv_id long, call_id string, turn long, name string, arguments string, "
        "depends_on array<string>")
    results = spark.createDataFrame([(1, "a", 5, "done"), (2, "a", 1, "ok"), (3, "z", 0, "stray")],
                                    "conv_id long, call_id string, turn long, content string")
    got = {(r["conv_id"], r["call_id"]): r
           for r in chat.link_tool_calls(calls, results, chat.SCHEMAS).collect()}
    assert {k: (r["status"], r["position"]) for k, r in got.items()} == {
        (1, "c"): ("invalid", 0), (1, "b"): ("no_result", 1), (1, "a"): ("linked", 2),
        (1, "x"): ("cycle", 3), (1, "y"): ("cycle", 4), (2, "a"): ("linked", 0),
        (2, "b"): ("invalid", 1), (3, "z"): ("no_call", 0), (None, None): ("invalid", 0)}
    assert got[1, "a"]["record"] == (
        '{"arguments":{"limit":1,"query":"q"},"id":"a","name":"search","result":"done"}')
    assert chat.link_tool_calls(calls.limit(0), results.limit(0), chat.SCHEMAS).collect() == []


def test_repeated_identifiers_are_all_linked(spark):
    ask = '{"text":"%s"}'
    calls = spark.createDataFrame([
        (1, "a", 0, "answer", ask % "one", None), (1, "b", 1, "answer", ask % "b", ["a"]),
        (1, "a", 2, "answer", ask % "two", ["b", "a"]), (1, "a", 2, "answer", ask % "two", ["b"]),
        (2, "c", 0, "answer", ask % "x", ["c"]), (2, "c", 1, "answer", ask % "y", ["c"]),
        (None, None, None, "answer", ask % "p", [None]),
        (None, None, None, "answer", ask % "q", None)],
        "conv_id long, call_id string, turn long, name string, arguments string, "
        "depends_on array<string>")
    results = spark.createDataFrame(
        [(1, "a", 1, "r0"), (1, "a", 3, "r1"), (1, "b", 2, "rb"), (1, "b", 3, "rb2")],
        "conv_id long, call_id string, turn long, content string")
    rows = chat.link_tool_calls(calls, results, chat.SCHEMAS).collect()
    assert len(rows) == 9
    got = {(r["conv_id"], r["call_id"], r["occurrence"]):
           (r["status"], r["n_calls"], r["n_results"], r["position"]) for r in rows}
    assert got == {
        (1, "a", 0): ("linked", 3, 2, 0), (1, "b", 0): ("linked", 1, 2, 1),
        (1, "a", 1): ("linked", 3, 2, 2), (1, "a", 2): ("no_result", 3, 2, 3),
        (1, "b", 1): ("no_call", 1, 2, 4),
        (2, "c", 0): ("cycle", 2, 0, 0), (2, "c", 1): ("cycle", 2, 0, 1),
        (None, None, 0): ("cycle", 2, 0, 1), (None, None, 1): ("no_result", 2, 0, 0)}
    records = {(r["conv_id"], r["call_id"], r["occurrence"]): r["record"] for r in rows}
    assert '"two"' in records[1, "a", 1] and '"r1"' in records[1, "a", 1]


ODD_JSON = [
    ('{"limit":1e400}', "invalid", "not JSON"), ('{"limit":-1e999,"query":"q"}', "invalid", "not JSON"),
    ('{"limit":' + "9" * 6000 + "}", "invalid", "not JSON"), ('{"limit":NaN}', "invalid", "not JSON"),
    ('{"query":"\\ud800","limit":1}', "no_result", ""),
    ('{"query":"\\udc00\\ud800x","limit":1}', "no_result", ""),
    ('{"query":"\\ud83d\\ude00","limit":1}', "no_result", ""),
    ('{"query":"q","limit":1,"\\udfff":2}', "invalid", "/\\udfff:additionalProperties"),
    ("[" * 100_000, "invalid", "not JSON"), ('{"a":1,"a":1}', "invalid", "not JSON"),
    ('{"query":"q","limit":' + "1" + "0" * 300 + "}", "invalid", "/limit:maximum"),
    ("", "invalid", "not JSON"), ("null", "invalid", ":type"), ("\u2028", "invalid", "not JSON")]


def test_any_json_text_is_judged(spark):
    calls = spark.createDataFrame(
        [(1, str(i), i, "search", text, None) for i, (text, _, _) in enumerate(ODD_JSON)],
        "conv_id long, call_id string, turn long, name string, arguments string, "
        "depends_on array<string>").withColumn("record", F.lit("clash"))
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    got = {int(r["call_id"]): r for r in
           chat.link_tool_calls(calls, results, chat.SCHEMAS).collect()}
    assert len(got) == len(ODD_JSON)
    for i, (text, status, errors) in enumerate(ODD_JSON):
        assert (got[i]["status"], got[i]["errors"]) == (status, errors), text[:50]
        json.loads(got[i]["record"])
    kept = json.loads(got[4]["record"])["arguments"]["query"]
    assert kept == "\ud800" and "\\ud800" in got[4]["record"]
    assert json.loads(got[6]["record"])["arguments"]["query"] == "\U0001f600"


def test_unknown_types_in_a_schema_match_nothing():
    assert chat.violations(1, {"type": "decimal"}) == [":type"]
    assert chat.violations(1, {"type": ["decimal", "integer"]}) == []


def test_long_arguments_and_results(spark):
    text = json.dumps({"text": LONG})
    calls = spark.createDataFrame([(1, "a", 0, "answer", text, ["a" * 70_000])],
                                  "conv_id long, call_id string, turn long, name string, "
                                  "arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, "a", 1, LONG)],
                                    "conv_id long, call_id string, turn long, content string")
    row = chat.link_tool_calls(calls, results, chat.SCHEMAS).first()
    assert row["status"] == "linked" and json.loads(row["record"])["result"] == LONG


def brute_order(calls):
    """Level per call (none on or behind a cycle) and the order of a conversation's calls."""
    needs = {c: [d for d in deps if d in calls] for c, (_, deps) in calls.items()}
    if all((calls[d][0], d) < (calls[c][0], c) for c, deps in needs.items() for d in deps):
        level = dict.fromkeys(calls, 0)
    else:
        level, before = {}, None
        while before != len(level):
            before = len(level)
            for c, deps in needs.items():
                if c not in level and all(d in level for d in deps):
                    level[c] = 1 + max((level[d] for d in deps), default=-1)
    order = sorted(calls, key=lambda c: (level.get(c, 2**31), calls[c][0], c))
    return level, {c: i for i, c in enumerate(order)}


def test_query_orders_calls_topologically(spark):
    turns = spark.read.parquet(f"{DATA}/conversations.parquet")
    more = spark.createDataFrame(
        [(10_000 + i // 60, i % 60, "user" if i % 2 == 0 else "assistant", f"text {i}")
         for i in range(300)], turns.schema)
    prepare_session(spark)
    calls, results = chat.calls_of(turns.unionByName(more))
    given = defaultdict(dict)
    for r in calls.collect():
        given[r["conv_id"]][r["call_id"]] = (r["turn"], r["depends_on"])
    got = [r for r in chat.link_tool_calls(calls, results, chat.SCHEMAS).collect()
           if r["status"] != "no_call"]
    assert len(got) == sum(map(len, given.values()))
    seen = Counter()
    for r in got:
        level, place = brute_order(given[r["conv_id"]])
        assert r["level"] == level.get(r["call_id"])
        assert (r["status"] == "cycle") == (r["call_id"] not in level)
        if r["n_results"] <= r["n_calls"]:
            assert r["position"] == place[r["call_id"]]
        seen[r["level"]] += 1
    assert seen[None] and seen[0] and seen[1] and seen[2]


def test_turns_with_one_number_are_all_kept(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "one"), (1, 0, "user", "two"), (1, 1, "assistant", "yes"),
         (2, None, "user", "three"), (2, None, "user", "four"), (2, None, "user", "four")],
        "conv_id long, turn long, role string, text string")
    rows = chat.link_tool_calls(*chat.calls_of(turns), chat.SCHEMAS).collect()
    assert Counter((r["conv_id"], r["n_calls"]) for r in rows) == {(1, 2): 2, (2, 3): 3}
    for text, times in (("one", 1), ("two", 1), ("three", 1), ("four", 2)):
        assert sum(f'"{text}"' in r["record"] for r in rows) == times


def test_license_lines_are_found(spark):
    notice = licenses.TEMPLATES["apache-2.0"]
    docs = spark.createDataFrame([(1, f"code\n{notice.upper()}.\n"), (2, PROSE), (3, None)],
                                 "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["unit"]) for r in licenses.scan_licenses(docs).collect()}
    assert got == {1: ("apache-2.0", 2), 2: (None, None), 3: (None, None)}


def wrapped(text, width=6):
    words = text.split()
    return "\n".join(" * " + " ".join(words[i:i + width]) for i in range(0, len(words), width))


def test_notices_within_longer_texts_are_found(spark):
    names = sorted(licenses.TEMPLATES)
    texts = [(i, f"{PROSE}\n{wrapped(licenses.TEMPLATES[n])}\n{PROSE}")
             for i, n in enumerate(names)]
    header = licenses.TEMPLATES["apache-2.0-header"]
    texts += [(100, f"{PROSE} {header} {PROSE}"),
              (101, f"a\nLicensed under the Apache License,\nVersion 2.0\n{PROSE}\n"
                    f"Released under the MIT License.\nb\nReleased under the MIT License.\n"),
              (102, PROSE)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    for i, name in enumerate(names):
        found = {m["license"]: (m["first_line"], m["last_line"]) for m in got[i]["matches"]}
        assert name in found, name
        last = 1 + -(-len(licenses.TEMPLATES[name].split()) // 6)
        assert name.endswith("-text") or found[name] == (2, last)
    assert "apache-2.0-header" in {m["license"] for m in got[100]["matches"]}
    assert [tuple(m) for m in got[101]["matches"]] == [
        ("apache-2.0", 1.0, 2, 3), ("mit", 1.0, 5, 5), ("mit", 1.0, 7, 7)]
    assert got[101]["n_matches"] == 3 and got[102]["matches"] == []


@pytest.mark.parametrize("sample", [64, 1 << 15])
def test_fingerprints_are_dealt_once_per_tree(spark, monkeypatch, sample):
    """A small sample makes large leaves; as long as they fit a chunk nothing is dealt twice."""
    monkeypatch.setattr(simhash, "SAMPLE", sample)
    draw = np.random.default_rng(2)
    prints = draw.integers(0, 1 << 63, 6000).astype(np.int64)
    prints[3000:] = prints[:3000] ^ (1 << draw.integers(0, 60, 3000)) ^ (1 << 61)
    fps = spark.createDataFrame([(int(x),) for x in set(prints.tolist())], "fp long")
    dealt = []
    real = simhash.VantageTree.overlaps
    tree = simhash.VantageTree(np.sort(prints.view(np.uint64)), 3, (1 << 13) - 1)
    rows, _ = real(tree, prints.view(np.uint64), 0)
    dealt.append(len(rows))
    assert dealt == [6000]
    found = simhash.components(simhash.links(fps))
    roots = {r["node"]: r["root"] for r in found.collect()}
    assert all(roots[int(a)] == roots[int(b)] for a, b in zip(prints[:3000], prints[3000:]))


def test_frequent_keys_are_joined_in_place(spark):
    left = spark.createDataFrame([(i % 3 if i < 900 else i, i) for i in range(1000)],
                                 "k long, v long")
    right = left.groupBy("k").agg(F.count("*").alias("n")).withColumn("w", F.col("k") * 2)
    for parts in (1, 4, 50, 5000):
        got = simhash.join_counted(left, right, "k", parts).collect()
        assert sorted((r["k"], r["v"], r["w"]) for r in got) == sorted(
            (r["k"], r["v"], 2 * r["k"]) for r in left.collect())
    assert simhash.join_counted(left.limit(0), right.limit(0), "k", 4).collect() == []


def test_pipeline_stages(spark, docs, empty):
    kept = corpus_pipeline.quality(spark, docs, DATA)
    assert kept.columns == docs.columns
    verdicts = Counter(r["doc_id"] for r in quality_rules.judge(docs).filter("kept").collect())
    assert Counter(r["doc_id"] for r in kept.collect()) == verdicts
    one = corpus_pipeline.near_duplicates(spark, docs, DATA).collect()
    prints = [(i, brute_fingerprint(t)) for i, t in TEXTS]
    assert Counter(r["doc_id"] for r in one) == Counter(set(brute_components(prints)))
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, DATA).collect() == []
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_pipeline_stages_take_any_further_columns(spark, docs):
    clashing = ["row", "__row", "row_", "carried", "c0", "host", "kept", "n_words", "fp", "pairs"]
    odd = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in clashing})
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, odd, DATA)
        assert out.columns == odd.columns
        for r in out.collect():
            assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}")
                       for c in clashing)
    pieces = corpus_pipeline.STAGES[-1][1](spark, odd, DATA)
    assert pieces.agg(F.sum("length")).first() == corpus_pipeline.STAGES[-1][1](
        spark, docs, DATA).agg(F.sum("length")).first()


def test_pipeline_decisions_take_effect_on_the_next_stage(spark):
    """A short, a copied, a leaking and a secret-bearing document through the whole chain."""
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]

    def prose(seed):
        draw = np.random.default_rng(seed)
        return " ".join(f"w{x}" for x in draw.integers(0, 5000, 200))

    rows = [(1, prose(1)), (2, prose(1)), (3, "too short"), (4, prose(4) + " " + bench + " end"),
            (5, prose(5) + " password = hunter2secret " + prose(6)), (6, prose(7))]
    docs = spark.createDataFrame(
        [(i, t, "en", f"s{i}", len(t)) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, DATA)
        docs = docs.sparkSession.createDataFrame(docs.collect(), docs.schema)
        seen.append({r["doc_id"] for r in docs.collect()})
    assert seen == [{1, 2, 4, 5, 6}, {1, 4, 5, 6}, {1, 5, 6}, {1, 5, 6}, {1, 5, 6}]
    tokens = {r["doc_id"]: r["doc_tokens"] for r in docs.collect()}
    encoder = packing.public_encoder().tokenizer
    masked = prose(5) + " [SECRET] " + prose(6)
    assert tokens[5] == len(encoder.encode(masked, add_special_tokens=False).ids) + 1
