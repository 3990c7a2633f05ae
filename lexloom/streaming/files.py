"""Incremental ingestion: new order files become lines and references, statelessly per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import fold
from lexloom.operators.lines import explode_lines
from lexloom.operators.references import detect


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of Markdown files as they arrive."""
    files = spark.readStream.format("text").option("wholetext", "true").load(path)
    docs = files.select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.[mM][dD]$", 1).alias("doc_id"), F.col("value").alias("text"))
    return explode_lines(docs)


def stream_references(spark: SparkSession, path: str) -> DataFrame:
    """References in those lines; every row depends on its own line only, so late files need no state."""
    lines = stream_lines(spark, path).withColumn("folded", fold(F.col("contents")))
    return detect(lines, ["doc_id", "line_no"])
