"""URL filters: given host rules, and association rules mined from labelled URLs.

FP-growth finds the combinations of URL tokens that go with blocked labels.  Rules with
too little support or confidence, and rules that a shorter one makes superfluous, are
pruned.  The rest is looked up by an inverted index: a rule is filed under its rarest
token, so a URL meets only rules of tokens it has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowcascade.llm.common import named
from flowcascade.session import stage

BLOCK_ITEM = "label:block"
MIN_ROWS = 30            # labelled rows that have a rule and block, whatever the table's size
MIN_CONFIDENCE = 0.8


@dataclass(frozen=True)
class HostRule:
    """``host`` and its subdomains, paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the registered query (fixed values).
HOST_RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for URLs without ``://``."""
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """Distinct tokens: host labels, path segments (numbers as one), query keys, fragment."""
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    host, path = host_and_path(url)
    asked = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)

    def marked(prefix: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda p: p != ""),
                           lambda p: F.concat(F.lit(prefix), p))

    segments = F.transform(F.split(F.lower(path), "/"),
                           lambda s: F.regexp_replace(s, r"\d+", "0"))
    keys = F.transform(F.split(asked, "&"), lambda p: F.substring_index(p, "=", 1))
    return F.array_distinct(F.concat(
        marked("host:", F.split(host, r"\.")), marked("path:", segments), marked("key:", keys),
        F.when(F.instr(rest, "#") > 0, F.array(F.lit("fragment"))).otherwise(
            F.array().cast("array<string>"))))


def leaders(exploded: DataFrame, min_rows: int) -> DataFrame:
    """``token``, ``leader`` of the tokens that ``min_rows`` rows have.

    Tokens that exactly the same rows have say the same, and every combination of them would
    be mined; the first of them, the leader, stands for all.  They are found by count and
    two digests of their rows, and parted again unless each row that has one has all.
    """
    posted = exploded.groupBy("token").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"),
        F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y")).filter(F.col("n") >= min_rows)
    alike = Window.partitionBy("n", "x", "y")
    led = stage(posted.select("token", F.min("token").over(alike).alias("leader"),
                              F.count("*").over(alike).alias("members")), "leaders")
    met = exploded.join(led, "token").groupBy("row", "leader", "members").agg(
        F.count("*").alias("here"))
    mixed = met.filter(F.col("here") < F.col("members")).select(
        F.col("leader").alias("mixed")).distinct()
    parted = led.join(mixed, F.col("leader") == F.col("mixed"), "left").select(
        "token", F.when(F.col("mixed").isNull(), F.col("leader")).otherwise(
            F.col("token")).alias("leader"))
    # written, so that Spark knows this side of later joins to be the small one
    return stage(parted, "parted-leaders")


RULES = ("tokens array<string>, alike array<array<string>>, confidence double, support double, "
         "anchor string")


def mine_rules(labelled: DataFrame, min_rows: int = MIN_ROWS,
               min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules ``tokens -> block`` from rows of ``url`` and ``block`` (boolean).

    Columns ``tokens``, ``confidence``, ``support`` (of the rows mined) and ``anchor``, the
    token of the rule that the fewest labelled URLs have (of equals the first).  Rows without
    a label or without tokens are not used.  Of tokens that the same rows have, only the first
    is in a rule and stands for all of them, which ``alike`` lists.  A rule is superfluous when one on part of its tokens is at least as
    confident.
    """
    spark = labelled.sparkSession
    baskets = stage(labelled.filter(F.col("block").isNotNull()).select(
        tokens(F.col("url")).alias("tokens"), "block",
        F.monotonically_increasing_id().alias("row")).filter(F.size("tokens") > 0), "baskets")
    empty = spark.createDataFrame([], RULES)
    exploded = baskets.select("row", "block", F.explode("tokens").alias("token"))
    leading = leaders(exploded, min_rows)
    led = exploded.join(leading, "token")
    merged = led.groupBy("row", "block").agg(F.collect_set("leader").alias("tokens"))
    items = stage(merged.select(
        F.when(F.col("block"), F.array_append("tokens", F.lit(BLOCK_ITEM)))
        .otherwise(F.col("tokens")).alias("items")), "items")
    n = items.count()
    if n < min_rows:
        return empty
    model = FPGrowth(itemsCol="items", minSupport=(min_rows - 0.5) / n,
                     minConfidence=min_confidence).fit(items)
    rules = stage(model.associationRules
                  .filter(F.array_contains("consequent", BLOCK_ITEM))
                  .select(F.sort_array("antecedent").alias("tokens"), "confidence", "support"),
                  "rules")
    if rules.isEmpty():
        return empty
    part = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("c"))
    anchored = rules.withColumn("key", F.explode("tokens"))
    # a part of a rule is met under each token of the rule
    shorter = anchored.join(
        part.withColumn("key", F.col("part")[0]), "key").filter(
        (F.size("part") < F.size("tokens"))
        & (F.size(F.array_except("part", "tokens")) == 0)
        & (F.col("c") >= F.col("confidence")))
    kept = rules.join(shorter.select("tokens").distinct(), "tokens", "left_anti")
    counts = baskets.select(F.explode("tokens").alias("key")).groupBy("key").agg(
        F.count("*").alias("n"))
    rarest = (kept.withColumn("key", F.explode("tokens")).join(counts, "key")
              .groupBy("tokens").agg(F.min(F.struct("n", "key"))["key"].alias("anchor")))
    members = leading.groupBy(F.col("leader").alias("key")).agg(
        F.sort_array(F.collect_list("token")).alias("members"))
    alike = (kept.select("tokens", F.posexplode("tokens").alias("at", "key")).join(members, "key")
             .groupBy("tokens").agg(F.sort_array(F.collect_list(F.struct("at", "members")))
                                    ["members"].alias("alike")))
    return stage(kept.join(rarest, "tokens").join(alike, "tokens").select(
        "tokens", "alike", "confidence", "support", "anchor"), "index")


def judge_urls(pages: DataFrame, rules: DataFrame, host_rules: tuple[HostRule, ...] = HOST_RULES,
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``matched`` of every page.

    The longest host rule that fits decides (of equally long ones the first given); where
    none fits, a page is blocked if its URL has every token of a mined rule, or one alike,
    which ``matched`` says.  Null URLs and URLs without ``://`` have an empty host and path and
    no tokens, so they are allowed.  Null ids stay null, repeated rows are judged each, an
    empty table gives an empty result, other columns are not read.
    """
    rows = pages.select(named(id_col).cast("long").alias("page_id"),
                        named(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    place = F.array_position("tokens", F.col("anchor")).cast("int")
    filed = rules.select(F.explode(F.element_at("alike", place)).alias("anchor"),
                         F.col("alike").alias("need"))
    found = (rows.select("url", tokens(F.col("url")).alias("have")).distinct()
             .withColumn("anchor", F.explode("have"))
             .join(filed, "anchor")
             .filter(F.forall("need", lambda same: F.arrays_overlap(same, F.col("have"))))
             .select(F.col("url").alias("hit_url")).distinct()
             .withColumn("hit", F.lit(True)))
    judged = rows.join(found, F.col("url") == F.col("hit_url"), "left").select(
        "page_id", host.alias("host"), path.alias("path"),
        F.coalesce("hit", F.lit(False)).alias("matched"))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("matched"), "block").otherwise("allow")
    for r in sorted(reversed(host_rules), key=lambda r: len(r.text)):     # the last one decides
        fits = (((F.col("host") == r.host) | F.col("host").endswith("." + r.host))
                & F.col("path").startswith(r.path))
        rule = F.when(fits, r.text).otherwise(rule)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return judged.select("page_id", "host", "path", rule.alias("rule"),
                         verdict.alias("verdict"), "matched")
