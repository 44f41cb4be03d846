"""Secret scan with a trigram inverted index.

A Boolean query over trigrams is derived from each rule's regular expression.  Each batch
of texts is a segment with its own inverted index over the trigrams that occur in the
queries; postings are intersected and united per query, and only the texts that remain
are searched with the expression.  A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from re import _parser as regex_parser

import pyarrow as pa
from pyspark.sql import DataFrame

from flowcascade.llm.common import id_and_text, map_whole_rows

MAX_EXACT = 64          # spellings followed side by side while a query is derived


@dataclass(frozen=True)
class Rule:
    """``least`` characters are wanted in the match, or in ``group`` of it."""

    kind: str
    pattern: str
    base: bool = False
    least: int = 0
    group: int = 0
    ignore_case: bool = False


# The patterns of the three base kinds are fixed values.  Runs of hexadecimal letters are
# maximal, so asking for 24 at once finds the same spans as taking every run and dropping
# the short ones.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                   r"""([A-Za-z0-9+/_.=-]+)""", True, 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", True, 20),
    Rule("hex", r"[0-9a-f]{24,}", True, 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    # the key itself: all up to the matching END line, or up to the end of the text without one
    Rule("private_key", r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----"
                        r"(?:[\s\S]*?-----END \1-----|[\s\S]*)"),
)

# A query is True (no demand), a trigram, or ("and" | "or", frozenset of queries).
Query = bool | str | tuple


def _all(parts: Iterable[Query]) -> Query:
    kept = frozenset(p for p in parts if p is not True)
    if not kept:
        return True
    return next(iter(kept)) if len(kept) == 1 else ("and", kept)


def _any(parts: Iterable[Query]) -> Query:
    kept = frozenset(parts)
    if True in kept or not kept:
        return True
    return next(iter(kept)) if len(kept) == 1 else ("or", kept)


def _spelled(exact: set[str]) -> Query:
    """What texts with one of these spellings must hold."""
    return _any(_all(s[i:i + 3] for i in range(len(s) - 2)) if len(s) > 2 else True
                for s in exact)


def _members(items: list) -> set[str] | None:
    """The characters of a small class."""
    found: set[str] = set()
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            found.add(chr(value))
        elif name == "RANGE" and value[1] - value[0] < 8:
            found.update(chr(c) for c in range(value[0], value[1] + 1))
        else:
            return None
    return found if len(found) <= 8 else None


def _walk(nodes: Iterable) -> tuple[set[str] | None, Query]:
    """All spellings of a sequence if they are few, and what else it demands."""
    demands: list[Query] = []
    exact: set[str] = {""}
    whole = True

    def cut() -> None:
        nonlocal exact, whole
        demands.append(_spelled(exact))
        exact, whole = {""}, False

    def extend(more: set[str]) -> None:
        nonlocal exact
        if len(exact) * len(more) > MAX_EXACT:
            cut()
        exact = {a + b for a in exact for b in more} if len(more) <= MAX_EXACT else {""}

    for op, value in nodes:
        name = str(op)
        if name == "LITERAL":
            extend({chr(value)})
        elif name == "AT":
            continue
        elif name == "IN" and (chars := _members(value)) is not None:
            extend(chars)
        elif name in ("SUBPATTERN", "BRANCH"):
            branches = [value[-1]] if name == "SUBPATTERN" else value[1]
            walked = [_walk(b) for b in branches]
            if all(e is not None for e, _ in walked):
                extend(set().union(*(e for e, _ in walked)))
            else:
                cut()
                demands.append(_any(q if e is None else _spelled(e) for e, q in walked))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and tuple(value[:2]) == (0, 1):
            inner, _ = _walk(value[2])
            if inner is None:
                cut()
            else:
                extend(inner | {""})
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            cut()
            if value[0] > 0:
                inner, query = _walk(value[2])
                demands.append(query if inner is None else _spelled(inner))
        else:
            cut()
    if whole:
        return exact, True
    demands.append(_spelled(exact))
    return None, _all(demands)


def trigram_query(pattern: str, ignore_case: bool = False) -> Query:
    """The Boolean trigram query of an expression; trigrams are in lower case."""
    exact, query = _walk(regex_parser.parse(pattern))
    query = _spelled(exact) if exact is not None else query

    def lower(q: Query) -> Query:
        if isinstance(q, str):
            return q.lower()
        return q if q is True else (q[0], frozenset(map(lower, q[1])))
    return lower(query)


def trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def candidates(query: Query, index: dict[str, set[int]], everyone: set[int]) -> set[int]:
    """Texts of a segment that satisfy the query."""
    if query is True:
        return everyone
    if isinstance(query, str):
        return index[query]
    found = [candidates(q, index, everyone) for q in query[1]]
    return set.intersection(*found) if query[0] == "and" else set.union(*found)


def build_index(texts: list[str], wanted: set[str]) -> dict[str, set[int]]:
    """Postings of the wanted trigrams."""
    index: dict[str, set[int]] = {t: set() for t in wanted}
    order = sorted(wanted)
    for i, text in enumerate(texts):
        folded = text.lower()
        for trigram in order:
            if trigram in folded:
                index[trigram].add(i)
    return index


class Scanner:
    def __init__(self, rules: Iterable[Rule]):
        self.rules = [(r, re.compile(r.pattern, re.ASCII | re.IGNORECASE * r.ignore_case),
                       trigram_query(r.pattern, r.ignore_case)) for r in rules]
        self.wanted = set().union(*(trigrams(q) for _, _, q in self.rules))

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule number, end), sorted."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        index, everyone = build_index(texts, self.wanted), set(range(len(texts)))
        for number, (rule, regex, query) in enumerate(self.rules):
            for i in candidates(query, index, everyone):
                for m in regex.finditer(texts[i]):
                    if len(m.group(rule.group)) >= rule.least:
                        found[i].append((m.start(), number, m.end()))
        return [sorted(spans) for spans in found]


def _joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...], base: bool) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans if rules[k].base or not base)


REPORT = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
          "spans string")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document with its secrets.

    ``spans`` lists ``kind:start:end`` in code points, by start, then by the order of the
    rules; ``base_sha256`` is taken over the base kinds alone.  Null and empty texts have
    no spans: counts 0, ``spans`` empty.  Null ids stay null, repeated rows are reported
    each, an empty table gives an empty result, other columns are not read.
    """
    kinds = [r.kind for r in rules]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            found = scanner.scan(batch.column("text").to_pylist())
            counts = {k: [sum(n == kinds.index(k) for _, n, _ in spans) if k in kinds else 0
                          for spans in found] for k in ("assign", "access", "hex")}
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                *(pa.array(counts[k], pa.int64()) for k in ("assign", "access", "hex")),
                pa.array([hashlib.sha256(_joined(s, rules, True).encode()).hexdigest()
                          for s in found], pa.string()),
                pa.array([_joined(s, rules, False) for s in found], pa.string()),
            ], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(scan, REPORT)


def redacted(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """The text with each stretch of overlapping spans replaced by the mask."""
    parts, done = [], 0
    for start, _, end in spans:
        if start >= done:
            parts += [text[done:start], mask]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]",
                   text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The table with every secret replaced by ``mask`` and ``length_col`` brought up to date.

    Every other column and every row stays; null texts stay null and keep their length.
    """
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = scanner.scan([t or "" for t in texts])
            clean = [t if t is None or not s else redacted(t, s, mask)
                     for t, s in zip(texts, found)]
            columns = list(batch.columns)
            columns[at] = pa.array(clean, pa.string())
            if length is not None:
                old, kind = columns[length].to_pylist(), batch.schema.field(length).type
                columns[length] = pa.array(
                    [len(c) if s else n for c, s, n in zip(clean, found, old)], kind)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_whole_rows(docs, redact)
