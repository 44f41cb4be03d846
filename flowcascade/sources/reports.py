"""Report sink."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(report: DataFrame, path: str) -> None:
    """Write a report table (a handful of aggregate rows) as one CSV file with a header."""
    if "f1" in report.columns:
        report = report.withColumnRenamed("f1", "f1-score")
    report.coalesce(1).write.mode("overwrite").csv(path, header=True)
