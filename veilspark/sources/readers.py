"""Readers of text files, JSON lines, corpora and templates as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDINGS = "array<struct<type:string,value:string,pii:boolean,number_type:string,honorific:string,note:string,public_figure:boolean>>"
CORPUS = f"tests array<struct<id:string,lang:string,format:string,text:string,expected:struct<sensitivity:string,findings:{FINDINGS}>,split:string>>"
TEMPLATES = "templates array<struct<id:string,lang:string,sensitivity:string,cell:string,text:string>>"


def text_files(spark: SparkSession, *paths: str) -> DataFrame:
    """``source, text``: one row per file. A file that isn't UTF-8 is an error when its row is read."""
    raw = spark.read.format("binaryFile").load([*paths])
    whole = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))))
    return raw.select(F.col("path").alias("source"), whole.alias("text"))


def standard_input(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("stdin", text)], "source string, text string")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Labelled training documents; blank lines are skipped. Raw spans are ``[start, end, kind]``."""
    raw = spark.read.schema("text string, lang string, format string, spans array<array<string>>, sensitivity int, categories array<string>").json(path)
    return raw.withColumn("spans", F.transform("spans", lambda s: F.struct(s[0].cast("int").alias("start"), s[1].cast("int").alias("end"), s[2].alias("kind"))))


def corpus(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of ``{"tests": [...]}`` files."""
    return spark.read.schema(CORPUS).option("multiLine", True).json([*paths]).select(F.explode("tests").alias("t")).select("t.*")


def templates(spark: SparkSession, *paths: str, skip_cells: tuple[str, ...] = (), briefs: DataFrame | None = None) -> DataFrame:
    """``id, lang, sensitivity, cell, text, source, pool``: every seventh template of a file, from the fourth, is for validation.

    A file that can't be read, a folder without templates, and templates with problems (:func:`coverage.template_problems`, against
    ``briefs`` if given) are errors that name the first of them. Cells to skip are left out after the pools are told apart.
    """
    from veilspark.operators.coverage import template_problems

    raw = spark.read.schema(f"{TEMPLATES}, broken string").option("columnNameOfCorruptRecord", "broken").option("multiLine", True).json([*paths]).withColumn("source", F.input_file_name())
    rows = raw.where("broken IS NULL").select("source", F.posexplode("templates").alias("i", "t")).select("t.*", "source", F.when(F.col("i") % 7 == 3, "valid").otherwise("train").alias("pool"))
    bad = [f"{r['source']}: not a file of templates" for r in raw.where("broken IS NOT NULL OR templates IS NULL").select("source").limit(20).collect()]
    bad = bad or [f"{r['id']}: {r['problem']}" for r in template_problems(rows, briefs).limit(20).collect()]
    if bad:
        raise ValueError("; ".join(bad))
    if rows.isEmpty():
        raise ValueError(f"no templates in {', '.join(paths)}")
    return rows.where(~F.col("cell").isin(*skip_cells)) if skip_cells else rows
