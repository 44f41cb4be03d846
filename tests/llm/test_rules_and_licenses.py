"""Brute-force tests of the licence windows and of the mined URL rules."""

import math
import random
import time
from itertools import combinations

import pytest

from flowcascade.llm import licenses, urls
from flowcascade.llm.common import prepare_session


def brute_matches(text, templates, threshold=0.8):
    """All windows of all templates, the best per start, without those that overlap a better one."""
    lines, words = [], []
    for number, line in enumerate((text or "").split("\n"), 1):
        own = licenses.re.sub(r"[^a-z0-9]+", " ", line.translate(licenses._LOWER)).split()
        words += own
        lines += [number] * len(own)
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    found = []
    for place, (name, body) in enumerate(sorted(templates.items())):
        own = licenses.bigrams_of(body)
        known = set(own)
        reach = math.floor(len(own) * (2 - threshold) / threshold + 1e-9)
        for s in range(len(pairs)):
            best = None
            if pairs[s] not in known:
                continue
            inside, shared = set(), set()
            for e in range(s, min(s + reach, len(pairs))):
                inside.add(pairs[e])
                if pairs[e] in known:
                    shared.add(pairs[e])
                    dice = 2 * len(shared) / (len(inside) + len(known))
                    if best is None or dice > best[0]:
                        best = (dice, e)
            if best and best[0] >= threshold:
                found.append((-best[0], s, place, best[1], name))
    kept = []
    for x in sorted(found):
        long = x[3] - x[1] + 1
        if not any(x[1] <= y[3] and y[1] <= x[3] and (
                x[2] == y[2] or (3 * long >= 2 * (y[3] - y[1] + 1) and 3 * (y[3] - y[1] + 1) >= 2 * long))
                for y in kept):
            kept.append(x)
    return [(x[4], -x[0], lines[x[1]], lines[x[3] + 1]) for x in kept]


def edited(rng, text, rate, width=7):
    words = []
    for w in text.split():
        draw = rng.random()
        if draw < rate / 2:
            words.append("changed")
        elif draw > rate:
            words.append(w)
        if rng.random() < rate / 4:
            words.append("added")
    return "\n".join(" ".join(words[i:i + width]) for i in range(0, len(words), width))


def test_windows_equal_brute_force(spark):
    rng = random.Random(4)
    prose = [f"w{i}" for i in range(300)]
    long = " ".join(rng.choice(prose) for _ in range(260)) + " the end of the long template"
    templates = {**{k: v for k, v in licenses.TEMPLATES.items() if len(v) < 1500}, "long": long}
    texts = ["", None, "the", long, long + " " + long, (templates["mit-grant"] + "\n") * 3]
    for _ in range(24):
        parts = []
        for _ in range(rng.randint(1, 3)):
            name = rng.choice(list(templates))
            parts.append(edited(rng, templates[name], rng.choice([0, 0.05, 0.15, 0.25])))
            parts.append(" ".join(rng.choice(prose) for _ in range(rng.randint(0, 60))))
        texts.append("\n".join(parts))
    prepare_session(spark)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: [(m["license"], m["dice"], m["first_line"], m["last_line"])
                         for m in r["matches"]]
           for r in licenses.scan_licenses(docs, templates).collect()}
    for i, text in enumerate(texts):
        want = brute_matches(text, templates)
        assert [m[0] for m in got[i]] == [m[0] for m in want], i
        for a, b in zip(got[i], want):
            assert a[1] == pytest.approx(b[1]) and a[2:] == b[2:], i
    assert sum(len(m) for m in got.values()) > 30


def test_many_notices_in_one_text(spark):
    prepare_session(spark)
    text = (licenses.TEMPLATES["apache-2.0-header"] + "\n") * 268
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    licenses.scan_licenses(docs.limit(0)).collect()
    start = time.time()
    row = licenses.scan_licenses(docs).first()
    assert time.time() - start < 60
    headers = [m for m in row["matches"] if m["license"] == "apache-2.0-header"]
    assert len(headers) == 268 and {m["dice"] for m in headers} == {1.0}


def mined(spark, rows, **options):
    prepare_session(spark)
    df = spark.createDataFrame(rows, "url string, block boolean").repartition(3)
    return {tuple(r["tokens"]): (round(r["confidence"], 9), r["anchor"])
            for r in urls.mine_rules(df, **options).collect()}


def brute_rules(spark, rows, min_rows, min_confidence):
    """Minimal rules over all combinations of tokens; of tokens with equal rows the first."""
    df = spark.createDataFrame(rows, "url string, block boolean")
    baskets = [(set(r["t"]), r["block"]) for r in
               df.select(urls.tokens(urls.F.col("url")).alias("t"), "block").collect()
               if r["block"] is not None and r["t"]]
    posting = {}
    for i, (have, _) in enumerate(baskets):
        for t in have:
            posting.setdefault(t, set()).add(i)
    first = {}
    for t in sorted(posting):
        first.setdefault(frozenset(posting[t]), t)
    names = sorted(t for t in first.values() if len(posting[t]) >= min_rows)
    blocked = {i for i, (_, b) in enumerate(baskets) if b}
    rules = {}
    for size in range(1, 7):
        for combo in combinations(names, size):
            both = set.intersection(*(posting[t] for t in combo))
            if len(both & blocked) >= min_rows:
                confidence = len(both & blocked) / len(both)
                if confidence >= min_confidence:
                    rules[combo] = confidence
    kept = {r: c for r, c in rules.items() if not any(
        set(p) < set(r) and d >= c for p, d in rules.items())}
    return {r: (round(c, 9), min((len(posting[t]), t) for t in r)[1]) for r, c in kept.items()}


def some_urls(n, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        host = f"{rng.choice(['www', 'm'])}.{rng.choice(['a', 'b', 'c'])}.org"
        path = "/".join(rng.choice(["x", "y", "buy", "win"]) for _ in range(rng.randint(0, 3)))
        url = f"http://{host}/{path}" + rng.choice(["", "?q=1", "?ref=2&q=3"])
        bad = ("buy" in path and "win" in path) or (".c." in url and rng.random() < 0.85)
        rows.append((url, None if rng.random() < 0.05 else bad != (rng.random() < 0.03)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_equal_brute_force(spark, seed):
    rows = some_urls(500, seed) + [(None, True), ("no scheme", True)]
    want = brute_rules(spark, rows, 12, 0.8)
    assert want and mined(spark, rows, min_rows=12, min_confidence=0.8) == want


def test_constant_tokens_do_not_multiply(spark):
    """All itemsets of 14 tokens that every URL has would be 16,383 rules."""
    path = "/".join(f"part{chr(97 + i)}" for i in range(14))
    rows = [(f"http://h.com/{path}/{'bad' if i % 2 else 'good'}", bool(i % 2)) for i in range(400)]
    start = time.time()
    got = mined(spark, rows)
    assert time.time() - start < 40
    assert list(got) == [("path:bad",)]


def test_tokens_that_are_alike_stand_for_each_other(spark):
    rows = [(f"http://h{i}.org/buy/pill?x=1&y=2" + ("#f" if i % 3 else ""), bool(i % 3))
            for i in range(90)] + [(f"http://h{i}.org/news", False) for i in range(60)]
    prepare_session(spark)
    rules = urls.mine_rules(spark.createDataFrame(rows, "url string, block boolean"))
    pages = spark.createDataFrame([
        (1, "http://z.com/pill#f"), (2, "http://z.com/pill"), (3, "http://z.com/?y#g"),
        (4, "http://z.com/?z"), (5, "http://z.com/buy/pill?x=1&y=2#h"), (6, "http://z.com/#f")],
        "page_id long, url string")
    got = {r["page_id"]: r["matched"] for r in urls.judge_urls(pages, rules).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True}


def test_first_of_equally_long_host_rules_decides(spark):
    pages = spark.createDataFrame([(1, "http://com/a")], "page_id long, url string")
    none = spark.createDataFrame([], urls.RULES)
    for first, second in (("block", "allow"), ("allow", "block")):
        rules = (urls.HostRule(first, "com", "/a"), urls.HostRule(second, "com", "/a"))
        assert urls.judge_urls(pages, none, rules).first()["verdict"] == first
