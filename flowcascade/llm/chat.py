"""Tool-call linking for chat records.

Calls and results are joined by conversation, identifier and the number of times that the
identifier came before, ordered so that a call comes after the calls it depends on, their arguments are checked against the tool's schema, and
each linked call is written as canonical JSON.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowcascade.llm.common import number_rows
from flowcascade.session import discard_stage, stage

KEY = ["conv_id", "call_id"]
CALL = [*KEY, "occurrence"]


# --- arguments --------------------------------------------------------------
_HALF = re.compile("[\ud800-\udfff]")


class RepeatedKey(ValueError):
    """An object names a key twice."""


def _object(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise RepeatedKey("repeated key")
    return found


def _constant(name: str):
    raise ValueError(f"{name} is not JSON")


def _finite(digits: str) -> float:
    value = float(digits)
    if not math.isfinite(value):
        raise ValueError(f"{digits} is too large a number")
    return value


def parse(text: str | None):
    """The value of a JSON text.

    ``ValueError`` if it is none, names a key twice, is nested too deep or has a number that
    is too large: beyond a double, or a whole number of thousands of digits.
    """
    if text is None:
        raise ValueError("no JSON")
    try:
        return json.loads(text, object_pairs_hook=_object, parse_constant=_constant,
                          parse_float=_finite)
    except RecursionError:
        raise ValueError("nested too deep") from None


def storable(text: str) -> str:
    """Halves of surrogate pairs, which JSON may name and UTF-8 cannot hold, as escapes."""
    return _HALF.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, and whole floats as integers."""
    def plain(v):
        if isinstance(v, float) and math.isfinite(v) and v.is_integer() and abs(v) < 2**53:
            return int(v)
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v
    return storable(json.dumps(plain(value), sort_keys=True, separators=(",", ":"),
                               ensure_ascii=False, allow_nan=False))


_TYPES = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: (isinstance(v, int) and not isinstance(v, bool))
    or (isinstance(v, float) and v.is_integer()),
}


def _same(a, b) -> bool:
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def violations(value, schema: dict, at: str = "") -> list[str]:
    """What of a schema a value breaks, as ``path:keyword``.

    Keywords: type, enum, required, properties, additionalProperties (true or false),
    items, minimum, maximum, minLength, maxLength, minItems, maxItems.  No value is of a
    type that is none of JSON's.
    """
    found = []
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(k in _TYPES and _TYPES[k](value) for k in kinds):
        return [f"{at}:type"]
    if "enum" in schema and not any(_same(value, e) for e in schema["enum"]):
        found.append(f"{at}:enum")
    if _TYPES["number"](value):
        if value < schema.get("minimum", -math.inf):
            found.append(f"{at}:minimum")
        if value > schema.get("maximum", math.inf):
            found.append(f"{at}:maximum")
    for kind, low, high in ((str, "minLength", "maxLength"), (list, "minItems", "maxItems")):
        if isinstance(value, kind):
            if len(value) < schema.get(low, 0):
                found.append(f"{at}:{low}")
            if len(value) > schema.get(high, math.inf):
                found.append(f"{at}:{high}")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}/{k}:required" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties", True) is False:
            found += [f"{at}/{k}:additionalProperties" for k in value if k not in known]
        for k in known:
            if k in value:
                found += violations(value[k], known[k], f"{at}/{k}")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            found += violations(v, schema["items"], f"{at}/{i}")
    return sorted(found)


def check_arguments(name: str | None, arguments: str | None,
                    schemas: dict[str, dict]) -> tuple[object, list[str]]:
    """The parsed arguments (null if they are no JSON) and what is wrong with them."""
    try:
        value = parse(arguments)
    except ValueError:
        return None, ["not JSON"]
    if name not in schemas:
        return value, ["unknown tool"]
    return value, violations(value, schemas[name])


# --- linking ----------------------------------------------------------------
def renamed(df: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    """``df`` with a prefix before the names of these columns."""
    return df.withColumnsRenamed({c: prefix + c for c in columns})


def equal(prefix: str, columns: list[str]) -> Column:
    """Whether these columns equal those with the prefix; null equals null."""
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(prefix + c)) for c in columns])


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """One row per call and per result that no call is left for.

    Calls (results) with one conversation and identifier are numbered from 0 by turn, then by
    content, as ``occurrence``; a call is linked with the result of its number.  ``n_calls``
    (``n_results``) counts all calls (results) with the identifier.
    """
    calls = number_rows(calls, KEY, ["turn", "name", "arguments", "depends_on"], "calls",
                        "occurrence").withColumn("is_call", F.lit(True))
    results = renamed(
        number_rows(results, KEY, ["turn", "content"], "results", "occurrence")
        .withColumn("has_result", F.lit(True)), "r_", [*CALL, "turn"])
    joined = calls.join(results, equal("r_", CALL), "full_outer")
    here = F.coalesce("is_call", F.lit(False))
    linked = stage(joined.select(
        *[F.when(here, F.col(c)).otherwise(F.col(f"r_{c}")).alias(c) for c in CALL],
        F.coalesce("turn", "r_turn").alias("turn"), "name", "arguments", "depends_on", "content",
        here.alias("is_call"), F.coalesce("has_result", F.lit(False)).alias("has_result")),
        "linked")
    counts = renamed(linked.groupBy(*KEY).agg(
        F.count_if("is_call").alias("n_calls"), F.count_if("has_result").alias("n_results")),
        "c_", KEY)
    return linked.join(counts, equal("c_", KEY)).drop(*[f"c_{k}" for k in KEY])


def dependencies(calls: DataFrame) -> DataFrame:
    """``CALL``, the ``n_`` columns of a call that this one needs, and if that is ``earlier``.

    Of several calls with the identifier that is needed it is the last one before the call
    that needs it (by turn, identifier and occurrence), and the first of all if none is before.
    Identifiers that no call has are left out.
    """
    wanted = calls.select(*CALL, "turn", F.explode(F.array_distinct("depends_on")).alias("needs"))
    # callers sort among the calls with the identifier they need, before themselves
    both = wanted.withColumn("given", F.lit(0)).unionByName(calls.select(
        *CALL, "turn", F.col("call_id").alias("needs"), F.lit(1).alias("given")))
    before = number_rows(both, ["conv_id", "needs"], ["turn", "call_id", "occurrence", "given"],
                         "wanted", "before", "given").filter("given = 0")
    needed = before.select(
        *CALL, F.col("conv_id").alias("n_conv_id"), F.col("needs").alias("n_call_id"),
        F.greatest(F.col("before") - 1, F.lit(0)).alias("n_occurrence"),
        (F.col("before") > 0).alias("earlier"))
    there = renamed(calls.select(*CALL), "o_", CALL)
    same = reduce(Column.__and__, [F.col(f"n_{c}").eqNullSafe(F.col(f"o_{c}")) for c in CALL])
    return needed.join(there, same, "left_semi")


def levels(calls: DataFrame) -> DataFrame:
    """``CALL``, ``level``: a number that is greater than those of all calls that the call
    depends on, or 0 in conversations whose turns are in order.

    ``calls`` has ``CALL``, unique, ``turn`` and ``depends_on``; see :func:`dependencies`.
    Where every dependency points to an earlier call (by turn, then identifier, then
    occurrence), that order is topological and all levels are 0; conversations of any
    length are settled by this one join.  In the others the level is the length of the
    longest chain of dependencies below the call, found in rounds: a round settles the
    calls whose dependencies are all settled, joining the open dependencies with the calls
    of the round before.  Calls on a cycle, or behind one, have no row.
    """
    keys = calls.select(*CALL)
    needed = [f"n_{c}" for c in CALL]
    edges = stage(dependencies(calls), "edges")
    mixed = stage(edges.filter(~F.col("earlier")).select(F.col("conv_id").alias("m_conv_id"))
                  .distinct(), "mixed")
    if mixed.isEmpty():
        return keys.withColumn("level", F.lit(0))
    is_mixed = equal("m_", ["conv_id"])
    plain = keys.join(mixed, is_mixed, "left_anti").withColumn("level", F.lit(0))
    keys = keys.join(mixed, is_mixed, "left_semi")
    open_edges = stage(edges.join(mixed, is_mixed, "left_semi").select(*CALL, *needed), "needs")
    exists = reduce(Column.__and__, [F.col(f"n_{c}").eqNullSafe(F.col(f"o_{c}")) for c in CALL])
    blocked = renamed(open_edges.select(*CALL).distinct(), "b_", CALL)
    is_blocked = equal("b_", CALL)
    done = [stage(keys.join(blocked, is_blocked, "left_anti").withColumn("level", F.lit(0)),
                  "level")]
    while not open_edges.isEmpty():
        last = renamed(done[-1].select(*CALL), "o_", CALL)
        # callers that waited for a call of the last round, and do not wait for another
        now_open = open_edges.join(last, exists, "left_anti")
        still = renamed(now_open.select(*CALL).distinct(), "b_", CALL)
        free = (open_edges.join(last, exists, "left_semi").select(*CALL).distinct()
                .join(still, is_blocked, "left_anti"))
        settled = stage(free.withColumn("level", F.lit(len(done))), "level")
        if settled.isEmpty():
            discard_stage(settled)
            break
        done.append(settled)
        before, open_edges = open_edges, stage(now_open, "needs")
        discard_stage(before)
    discard_stage(open_edges)
    return reduce(DataFrame.unionAll, done, plain)


REPORT = ("conv_id long, call_id string, occurrence long, n_calls long, n_results long, "
          "name string, position long, level int, status string, errors string, record string")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call and stray result, with its place, verdict and canonical JSON.

    ``calls``: ``conv_id``, ``call_id``, ``turn``, ``name``, ``arguments`` (JSON text),
    ``depends_on`` (array of identifiers); ``results``: ``conv_id``, ``call_id``, ``turn``,
    ``content``.  Other columns are not read.

    An identifier may come several times in a conversation (see :func:`link`): ``occurrence``
    numbers its rows from 0, ``n_calls`` and ``n_results`` count its calls and results.
    ``status``: ``no_call`` (a result without a call), ``cycle`` (on or behind a cycle of
    dependencies), ``invalid`` (see ``errors``), ``no_result``, else ``linked``, the first
    that holds.  ``position`` counts from 0 in a conversation by level (see
    :func:`levels`), turn, identifier and occurrence; what has no level comes last.  Null
    conversations and identifiers are values like any other; null arguments are no JSON; null dependencies are none.  Empty
    tables give an empty result.
    """
    linked = stage(link(calls.select(*KEY, "turn", "name", "arguments", "depends_on"),
                        results.select(*KEY, "turn", "content")), "linked")
    level = renamed(levels(linked.filter("is_call").select(*CALL, "turn", "depends_on")),
                    "l_", CALL)
    rows = linked.join(level, equal("l_", CALL), "left")
    order = rows.select(*CALL, F.coalesce("level", F.lit(2**31 - 1)).alias("rank"), "turn")
    placed = number_rows(order, ["conv_id"], ["rank", "turn", "call_id", "occurrence"], "places",
                         "position")
    places = renamed(placed.select(*CALL, "position"), "p_", CALL)
    full = rows.join(places, equal("p_", CALL)).select(
        *CALL, "n_calls", "n_results", "name", "position", "level", "arguments", "content",
        "is_call", "has_result")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            statuses, problems, records = [], [], []
            for row in batch.to_pylist():
                value, errors = (None, [])
                if row["is_call"]:
                    value, errors = check_arguments(row["name"], row["arguments"], schemas)
                statuses.append(
                    "no_call" if not row["is_call"] else "cycle" if row["level"] is None
                    else "invalid" if errors else "no_result" if not row["has_result"]
                    else "linked")
                problems.append(storable(", ".join(errors)))
                records.append(canonical({
                    "arguments": value, "id": row["call_id"], "name": row["name"],
                    "result": row["content"]}))
            keep = [*CALL, "n_calls", "n_results", "name", "position", "level"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(statuses, pa.string()),
                 pa.array(problems, pa.string()), pa.array(records, pa.string())],
                names=[*keep, "status", "errors", "record"])

    return full.mapInArrow(write, REPORT)


# --- calls in plain conversations ---------------------------------------------
SCHEMAS = {
    "search": {
        "type": "object", "required": ["query", "limit"], "additionalProperties": False,
        "properties": {"query": {"type": "string", "minLength": 1, "maxLength": 400},
                       "limit": {"type": "integer", "minimum": 1, "maximum": 60},
                       "exact": {"type": "boolean"}}},
    "answer": {
        "type": "object", "required": ["text"],
        "properties": {"text": {"type": "string", "minLength": 1},
                       "style": {"enum": ["short", "long"]}}},
}


SPAN = 16       # turns within which calls need each other


def _needs() -> Column:
    turn = F.col("turn")

    def near(*steps: int) -> Column:
        there = F.array(*[F.when(F.floor((turn + k) / SPAN) == F.floor(turn / SPAN), turn + k)
                          for k in steps])
        return F.transform(F.filter(there, lambda t: t.isNotNull()), lambda t: t.cast("string"))

    kind = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5))
    return (F.when(kind == 0, near(2)).when(kind == 1, near(-2, -4))
            .when(kind == 2, F.array().cast("array<string>")).otherwise(near(-2)))


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read off a table of turns.

    A user turn is a call: of ``answer`` if it has an odd number of lines, else of
    ``search``; its arguments are taken from its text, and its identifier is its turn.  The
    assistant turn after it is its result.  Other turns are neither.

    A hash of conversation and turn says what a call needs among the calls of the same
    ``SPAN`` turns: of five calls two need the one before, one the two before, one the one
    after, and one none.  So calls wait for later ones, and some wait for each other.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lines = F.split("text", "\n")
    words = F.size(F.split("text", " ")).cast("long")
    answer = F.size(lines) % 2 == 1
    arguments = F.when(answer, F.to_json(F.struct(
        F.when(words > 20, "long").when(words > 5, "short").otherwise("none").alias("style"),
        F.col("text")))).otherwise(F.to_json(F.struct(
            lines[0].alias("query"), words.alias("limit"), (words % 2 == 0).alias("exact"))))
    calls = turns.filter(F.col("role") == "user").select(
        "conv_id", F.col("turn").cast("string").alias("call_id"), "turn",
        F.when(answer, "answer").otherwise("search").alias("name"), arguments.alias("arguments"),
        _needs().alias("depends_on"))
    results = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).cast("string").alias("call_id"), "turn",
        F.col("text").alias("content"))
    return calls, results
