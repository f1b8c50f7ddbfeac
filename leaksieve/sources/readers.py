"""Readers for named paths in any store that Spark lists, to string records (source, file, relpath, line, seq, keypath, path, value).

Discovered files, databases and files that don't fit a row are read by sources.files; Spark's own listing hides names that begin with a dot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leaksieve.functions.text import physical_lines, text_lines, without_end
from leaksieve.sources.walk import json_strings, leaves, walker

STRINGS = ("source", "file", "relpath", "line", "seq", "keypath", "path", "value")


def _named(df: DataFrame, source: str, root: str | None) -> DataFrame:
    top = (root or "").rstrip("/") + "/"
    file = F.col("file")
    below = F.when(F.contains(file, F.lit(top)), F.regexp_replace(file, "^.*?" + _quoted(top), "")).otherwise(file) if root else file
    return df.withColumns({"source": F.lit(source), "relpath": below})


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def whole_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file, size, text of each file (one row a file; for files that fit a task)."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))


def file_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file, line (from 1), raw with its end."""
    return whole_files(spark, paths).select("file", F.posexplode(physical_lines(F.col("text"))).alias("_k", "raw")).select("file", (F.col("_k") + 1).cast("long").alias("line"), "raw")


def split_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file, line, raw (without end) of files of any size: splits are read in parallel, numbered by lines per split.

    A split's own order is kept by Spark's increasing ids; splits of a file are summed in order of their offset.
    """
    rows = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("raw"))
    blocks = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "raw")


def jsonl_strings(spark: SparkSession, paths: Sequence[str], source: str, root: str | None = None, huge: bool = True) -> DataFrame:
    """String leaves of each line of JSONL files. Blank lines are numbered but skipped, bad lines give nothing (see jsonl_quality).

    huge: files are read in splits; otherwise a file is one row, for files that fit a task.
    """
    lines = split_lines(spark, paths) if huge else file_lines(spark, paths)
    body = lines.select("file", "line", without_end(F.col("raw")).alias("_body")).where(F.trim("_body") != "")
    return _named(json_strings(body, "_body"), source, root).select(*STRINGS)


def jsonl_quality(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file, unparseable_lines."""
    lines = split_lines(spark, paths).withColumn("_body", without_end(F.col("raw"))).where(F.trim("_body") != "")
    return lines.withColumn("failed", walker()(F.col("_body"))["failed"]).groupBy("file").agg(F.sum(F.col("failed").cast("long")).alias("unparseable_lines"))


def json_file_strings(spark: SparkSession, paths: Sequence[str], source: str, root: str | None = None) -> DataFrame:
    """String leaves of whole-JSON files, a file a row."""
    docs = whole_files(spark, paths).select("file", F.lit(1).cast("long").alias("line"), F.col("text").alias("_body"))
    return _named(json_strings(docs, "_body"), source, root).select(*STRINGS)


def text_strings(spark: SparkSession, paths: Sequence[str], source: str, root: str | None = None) -> DataFrame:
    """Non-blank lines of plain texts, markdown, logs and XML; the key path is the line number."""
    lines = whole_files(spark, paths).select("file", F.posexplode(text_lines(F.col("text"))).alias("_k", "value")).where(F.trim("value") != "")
    numbered = lines.withColumns({"line": (F.col("_k") + 1).cast("long"), "seq": F.lit(0)})
    keyed = numbered.withColumns({"keypath": F.array(F.col("line").cast("string")), "path": F.concat(F.lit("["), F.col("line").cast("string"), F.lit("]"))})
    return _named(keyed, source, root).select(*STRINGS)
