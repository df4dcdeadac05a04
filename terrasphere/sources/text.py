"""Ordered text lines of small configuration files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value) of text files; line numbers start at 1."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    lines = whole.select("path", F.posexplode(F.split("value", "\r?\n")).alias("pos", "value"))
    return lines.select("path", (F.col("pos") + 1).alias("line_no"), "value")


def tokens(value: Column) -> Column:
    return F.filter(F.split(F.trim(value), r"\s+"), lambda t: t != "")


def is_comment(value: Column) -> Column:
    return value.startswith("#")
