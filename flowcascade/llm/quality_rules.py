"""Quality rules at host level.

Rules are tested per document; their failures are added up per host, the failure rates
are shrunk with a beta prior fitted to all hosts, and hosts that mostly fail a rule are
rejected with all their documents.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowcascade.llm.common import named
from flowcascade.session import stage

# Characters between words, and the symbols that are counted (fixed values).
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

RULES = ("short", "repeats", "symbols", "dup_lines", "word_length")
MAX_HOST_RATE = 0.5             # a host is rejected above this shrunk failure rate
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


CARRIED = "carried"


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            host_col: str = "source", carry: bool = False) -> DataFrame:
    """``doc_id``, ``host`` and the counts of each text; with ``carry`` also the whole row."""
    whole = [F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
             .alias(CARRIED)] if carry else []
    kept = [CARRIED] if carry else []
    base = docs.select(named(id_col).cast("long").alias("doc_id"),
                       named(host_col).cast("string").alias("host"),
                       F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"), *whole)
    split = base.select(
        "doc_id", "host", *kept,
        F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: _without(x, BLANKS) != "").alias("lines"),
        F.length(_without(F.col("text"), BLANKS)).alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).alias("n_symbols"))
    n = F.size("words")
    word = F.col("words")
    places = F.when(n > 2, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    # Hashes tell in one pass whether any window may occur twice; only then are the
    # windows themselves sorted.
    hashed = split.withColumn("hashes", F.transform(places, lambda i: F.xxhash64(
        F.get(word, i), F.get(word, i + 1), F.get(word, i + 2))))
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    windows = hashed.withColumn("windows", F.when(repeats, F.sort_array(F.transform(
        places, lambda i: F.struct(
            F.concat_ws(" ", F.get(word, i), F.get(word, i + 1), F.get(word, i + 2)).alias("w"),
            i.alias("i"))))))
    sorted_windows = F.col("windows")

    def twice(x: Column, i: Column) -> Column:
        same = [F.coalesce(F.get(sorted_windows, at)["w"] == x["w"], F.lit(False))
                for at in (i - 1, i + 1)]
        return same[0] | same[1]

    spots = windows.withColumn("spots", F.sort_array(
        F.transform(F.filter(sorted_windows, twice), lambda x: x["i"])))
    spot = F.col("spots")
    covered = F.aggregate(
        F.transform(spot, lambda p, i: F.coalesce(F.least(F.get(spot, i + 1) - p, F.lit(3)),
                                                  F.lit(3))),
        F.lit(0), lambda total, x: total + x)
    return spots.select(
        "doc_id", "host", *kept, n.cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def rule_failures() -> dict[str, Column]:
    """What fails each rule, over the columns of :func:`measure`."""
    n = F.col("n_words")
    return {
        "short": n < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
    }


def host_verdicts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host (the null host is one of them): counts, shrunk rates, verdict.

    The prior of a rule is a beta distribution with the mean of all documents and the
    spread of the hosts' rates (by moments, hosts weighted by their documents).  Its
    strength lies between 1 and 1,000 documents; without any spread it is 1,000.
    """
    flags = rule_failures()
    hosts = measured.groupBy("host").agg(
        F.count("*").alias("n"),
        *[F.count_if(flags[r]).alias(f"n_{r}") for r in RULES])
    totals = hosts.agg(F.sum("n").alias("n"), *[F.sum(f"n_{r}").alias(r) for r in RULES]).first()
    n_all = totals["n"] or 1
    mean = {r: (totals[r] or 0) / n_all for r in RULES}
    spread = hosts.agg(*[
        (F.sum(F.col("n") * (F.col(f"n_{r}") / F.col("n") - mean[r])
               * (F.col(f"n_{r}") / F.col("n") - mean[r])) / n_all).alias(r)
        for r in RULES]).first()
    rates = {}
    for r in RULES:
        v = spread[r] or 0.0
        strength = mean[r] * (1 - mean[r]) / v - 1 if v > 0 else MAX_STRENGTH
        strength = min(max(strength, MIN_STRENGTH), MAX_STRENGTH)
        rates[f"rate_{r}"] = (F.col(f"n_{r}") + mean[r] * strength) / (F.col("n") + strength)
    rated = hosts.withColumns(rates)
    return rated.withColumn("host_rejected",
                            F.greatest(*[F.col(c) for c in rates]) > max_rate)


def _judged(measured: DataFrame, max_rate: float) -> DataFrame:
    """The measured rows with the verdict of their host, ``base_failed`` and ``kept``.

    The table of hosts is joined by Spark's own choice of join, which splits a host with too
    many rows.
    """
    verdicts = stage(host_verdicts(measured, max_rate).select(
        F.col("host").alias("verdict_host"), "host_rejected"), "hosts")
    flags = rule_failures()
    failed = flags["short"] | flags["repeats"]
    judged = measured.join(verdicts, F.col("host").eqNullSafe(F.col("verdict_host")), "left")
    return judged.withColumns({"base_failed": failed,
                               "kept": ~failed & ~F.col("host_rejected")})


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per document with its counts, ``base_failed`` and ``kept``.

    Null and empty texts have no words, so they fail.  Null hosts form one host, null ids
    stay null, repeated rows are judged each.  An empty table gives an empty result.
    Extra columns are not read.
    """
    measured = stage(measure(docs, id_col, text_col, host_col), "quality")
    return _judged(measured, max_rate).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "host_rejected", "kept")


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows that :func:`judge` keeps, with all their columns, whatever these are called.

    Every row is judged by its own text and carried along with its counts, so that no text
    is joined back.
    """
    measured = stage(measure(docs, id_col, text_col, host_col, carry=True), "quality")
    kept = _judged(measured, max_rate).filter("kept").select(CARRIED)
    return kept.select(*[F.col(CARRIED)[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])
