"""Reading wide flow CSVs: header rules, pruning, malformed lines, types."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowcascade.functions import looks_numeric, quoted
from flowcascade.operators.clean import (
    Accounting,
    coerce_numeric,
    dedup,
    drop_missing,
    stage_counted,
)
from flowcascade.schema import (
    BASE_FEATURES,
    TEXT_FEATURES,
    column_map,
    resolve_label,
    strip_spaces,
)
from flowcascade.session import discard_stage, side_session, stage

# Field texts that mean "missing" to the common CSV readers.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# A quote inside a quoted field is written twice.
CSV_OPTIONS = {"mode": "PERMISSIVE", "quote": '"', "escape": '"'}


def normalize_columns(df: DataFrame) -> DataFrame:
    """Remove spaces from column names; of equal names only the last column stays."""
    last = column_map(df.columns)
    return df.select(*[
        quoted(c).alias(strip_spaces(c)) for c in df.columns if last[strip_spaces(c)] == c])


def _unique_header(cells: list[str | None]) -> list[str]:
    """Repeated names get ``.1``, ``.2`` ...; blank ones a positional name."""
    seen: Counter[str] = Counter()
    names = []
    for i, cell in enumerate(cells):
        name = cell if cell else f"Unnamed: {i}"
        names.append(f"{name}.{seen[name]}" if seen[name] else name)
        seen[name] += 1
    return names


def read_header(spark: SparkSession, path: str, **options: str) -> list[str | None]:
    """Cells of the first line; none if there is no line at all."""
    first = spark.read.options(**{**CSV_OPTIONS, **options}).csv(path, header=False).first()
    return [] if first is None else list(first)


def _require_equal_headers(spark: SparkSession, path: str) -> None:
    """Compare the first lines of all files as text; one aggregate pass over the lines."""
    first = (
        spark.read.text(path)
        .select("value", F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("at"))
        .filter((F.col("at") == 0) & (F.trim("value") != ""))
        .withColumn("line", F.monotonically_increasing_id())
        .groupBy("file").agg(F.min_by("value", "line").alias("header"))
    )
    if first.select("header").distinct().limit(2).count() > 1:
        raise ValueError(f"the header is not the same in all files of {path}")


def _wanted(names: list[str], features: list[str], keep: Iterable[str]) -> list[str]:
    """Actual names to read, label included, in file order."""
    by_name = column_map(names)
    chosen = {by_name[f] for f in [*features, *keep] if f in by_name}
    label = resolve_label(names)
    if label is not None:
        chosen.add(label)
    return [n for n in names if n in chosen]


def read_flow_text(spark: SparkSession, path: str, features: list[str] = BASE_FEATURES,
                   keep: Iterable[str] = (), on_error: str = "raise",
                   multi_line: bool = False, **options: str) -> DataFrame:
    """Scan only the wanted columns of a flow CSV, all as text.

    ``path`` is a file or a folder of files with the same header.  Lines that
    are too long are cut, short ones padded with nulls.  Names lose their
    spaces, columns keep file order, missing-value texts become null.  With
    ``on_error="empty"`` an unreadable input gives an empty table without
    columns instead of an error.
    
    With ``multi_line`` quoted fields may hold line breaks; a file is then read by one task,
    so give it many files.
    """
    if multi_line:
        options["multiLine"] = "true"
    try:
        header = read_header(spark, path, **options)
    except PySparkException:
        if on_error == "empty":
            return spark.createDataFrame([], T.StructType())
        raise
    names = _unique_header(header)
    wanted = _wanted(names, features, keep)
    if not wanted:
        if on_error == "empty":
            return spark.createDataFrame([], T.StructType())
        raise ValueError(f"no wanted column in {path}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    # every file's own header is checked: by Spark, unless names had to be made up
    if names != header:
        _require_equal_headers(spark, path)
    text = (
        spark.read.schema(schema).options(**{**CSV_OPTIONS, **options})
        .csv(path, header=True, enforceSchema=names != header)
    )
    return text.select(*[
        F.when(~quoted(n).isin(NA_TOKENS), quoted(n)).alias(strip_spaces(n)) for n in wanted])


def _non_numeric_counts(df: DataFrame, cols: list[str]) -> list:
    return [
        F.count_if(quoted(c).isNotNull() & ~looks_numeric(quoted(c))).alias(f"c{i}")
        for i, c in enumerate(cols)]


def infer_numeric(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    """Text columns in which every value present is a number; one aggregate pass."""
    cols = list(df.columns) if cols is None else cols
    if not cols:
        return []
    row = df.agg(F.count(F.lit(1)).alias("rows"), *_non_numeric_counts(df, cols)).first()
    if row["rows"] == 0:
        return []
    return [c for i, c in enumerate(cols) if row[f"c{i}"] == 0]


def read_flows(spark: SparkSession, path: str, features: list[str] = BASE_FEATURES,
               keep: Iterable[str] = (), numeric: list[str] | None = None,
               on_error: str = "raise", multi_line: bool = False,
               **options: str) -> DataFrame:
    """Typed flow table.

    Columns whose values are all numbers become double.  Finding them costs one
    scan; name them in ``numeric`` to skip it.  Columns in ``keep`` that are neither
    features nor the label stay text, so ids keep all their digits.
    """
    keep = list(keep)
    text = read_flow_text(spark, path, features, keep, on_error, multi_line, **options)
    if numeric is None:
        carried = _carried(text, features, keep)
        numeric = infer_numeric(text, [c for c in text.columns if c not in carried])
    return coerce_numeric(text, [c for c in text.columns if c in set(numeric)])


def _carried(text: DataFrame, features: list[str], keep: Iterable[str]) -> set[str]:
    """Kept columns that are neither features nor the label."""
    return set(keep) - {*features, resolve_label(text.columns)}


def _stage_typed(text: DataFrame, numeric: list[str], carried: set[str],
                 spark: SparkSession, accounting: Accounting | None) -> DataFrame:
    typed = coerce_numeric(text, numeric)
    if accounting is None:
        return stage(drop_missing(dedup(typed), ignore=carried), "flows", spark)
    table, accounting[:] = stage_counted(typed, "flows", carried, spark)
    return table


def stage_clean_flows(spark: SparkSession, path: str, features: list[str] = BASE_FEATURES,
                      numeric: list[str] | None = None, keep: Iterable[str] = (),
                      accounting: Accounting | None = None, multi_line: bool = False,
                      **options: str) -> DataFrame:
    """Scan, type, de-duplicate and null-drop a flow CSV into a staged table.

    The text is read once: every feature is taken to be numeric and the job that
    writes the table counts the values that are not.  Only if that guess was
    wrong for some column is the job repeated with the types it found.  Columns in
    ``keep`` that are neither features nor the label stay text and may be missing.  A list
    given as ``accounting`` is filled with the row counts of both cleaning steps.
    """
    keep = list(keep)
    if numeric is not None:
        text = read_flow_text(spark, path, features, keep, multi_line=multi_line, **options)
        return _stage_typed(text, [c for c in text.columns if c in set(numeric)],
                            _carried(text, features, keep), spark, accounting)
    # a session that has observed metrics can no longer be shipped inside fitted
    # models, so the observing is done in a session of its own
    text = read_flow_text(side_session(spark), path, features, keep, multi_line=multi_line,
                          **options)
    carried = _carried(text, features, keep)
    label = resolve_label(text.columns)
    typed = [c for c in text.columns if c not in carried]
    guess = [c for c in typed if c != label and c not in TEXT_FEATURES]
    seen = Observation()
    watched = text.observe(seen, F.count(F.lit(1)).alias("rows"),
                           *_non_numeric_counts(text, typed))
    table = _stage_typed(watched, guess, carried, spark, accounting)
    if table.isEmpty():
        # without output rows Spark may drop the counted stage, and its counts with it
        found = infer_numeric(text, typed)
        if not found:
            return table
    else:
        counts = seen.get
        found = [c for i, c in enumerate(typed) if counts[f"c{i}"] == 0]
    if found == guess:
        return table
    discard_stage(table)
    return _stage_typed(text, found, carried, spark, accounting)
