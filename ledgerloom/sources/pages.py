"""Pages of text files: one row a page, cut at form feeds, with the lines of two readings side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """path, sha256, bytes, page_number (from 1), text of the files under a folder. Files are UTF-8; carriage returns before line feeds are dropped. An empty file has one empty
    page."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
    pages = files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), F.posexplode(F.split(text, "\f")).alias("pos", "text"))
    return pages.select("path", "sha256", "bytes", (F.col("pos") + 1).alias("page_number"), "text")


def page_readings(layout: DataFrame, native: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text, other, readers, agree: each page with the text of both readings (keys, text); a page only one reader has is kept."""
    both = layout.select(*keys, "text").join(native.select(*keys, F.col("text").alias("other")), keys, "full")
    return both.withColumn("readers", F.col("text").isNotNull().cast("int") + F.col("other").isNotNull().cast("int")).withColumn("agree", F.coalesce(F.col("text") == F.col("other"), F.lit(False)))
