"""Reports as text lines and as JSON, and pools as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report_lines(report: DataFrame, source: str = "source") -> DataFrame:
    """``source, lines``: the level, then a line per finding with its marks, then a line per secret with its line number."""
    head = F.format_string("%s: sensitivity %s", F.col(source), F.col("sensitivity.level"))

    def finding(f: Column) -> Column:
        return F.concat(F.lit("  "), f["type"], F.when(f["number_type"].isNotNull(), F.concat(F.lit(" ("), f["number_type"], F.lit(")"))).otherwise(""), F.lit(": "), f["value"], F.when(f["pii"], "").otherwise(" [not PII]"))

    def secret(s: Column) -> Column:
        return F.concat(F.lit("  secret ("), s["rule"], F.lit(")"), F.coalesce(F.concat(F.lit(" on line "), s["line"].cast("string")), F.lit("")), F.lit(": "), s["value"])

    return report.select(source, F.concat(F.array(head), F.transform("findings", finding), F.transform("secrets", secret)).alias("lines"))


def write_text(report: DataFrame, path: str, source: str = "source") -> None:
    report_lines(report, source).select(F.concat_ws("\n", "lines").alias("value")).write.mode("overwrite").text(path)


def write_json(report: DataFrame, path: str) -> None:
    """One object per document; null fields are left out."""
    report.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_pools(docs: DataFrame, path: str, pool: str = "pool") -> None:
    docs.write.mode("overwrite").partitionBy(pool).json(path)
