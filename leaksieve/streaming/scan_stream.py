"""Scanning streams: the scan is row-local, so it runs on a streaming DataFrame as it is.

Findings already seen are kept in the state store, so a record that is delivered again gives no second finding; ignore entries
are a static table that each batch is joined with.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leaksieve.functions.detectors import Detector
from leaksieve.functions.rules import Rule
from leaksieve.functions.text import fingerprint
from leaksieve.operators.report import records
from leaksieve.operators.scan import scan
from leaksieve.operators.staging import staged
from leaksieve.operators.suppress import glob_patterns


def text_stream(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Lines of text files as they arrive: source, file, relpath, line (0: unknown in a stream), value."""
    rows = spark.readStream.format("text").load(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return rows.select(F.lit(source).alias("source"), "file", F.col("file").alias("relpath"), F.lit(0).cast("long").alias("line"), F.array().cast("array<string>").alias("keypath"), "value")


def without_ignored(findings: DataFrame, ignores: DataFrame) -> DataFrame:
    """Streamed findings that no ignore entry covers: anti-joins with the static entries, by rule, fingerprint and value; path globs are matched one by one.

    The entries are written once, before the stream starts: each batch joins tables of a known size, which Spark broadcasts if small, and runs no Python for them.
    """
    held = staged(ignores.select("kind", "entry").distinct())
    patterns = staged(glob_patterns(held))
    entries = lambda kind: held.where(F.col("kind") == kind).select(F.col("entry").alias(f"_{kind}"))
    path = F.regexp_replace("relpath", r"\\", "/")
    out = findings.withColumns({"_fp": fingerprint(path, F.col("line"), F.col("rule")), "_at": path})
    out = out.join(entries("rule"), F.col("rule") == F.col("_rule"), "left_anti").join(entries("fingerprint"), F.col("_fp") == F.col("_fingerprint"), "left_anti")
    out = out.join(entries("value"), F.col("match") == F.col("_value"), "left_anti")
    return out.join(patterns, F.rlike("_at", F.col("_pattern")), "left_anti").drop("_fp", "_at")


def first_seen_only(findings: DataFrame, time: str | None = None, late: str = "1 day") -> DataFrame:
    """Each finding (place, rule and text, by digest) once, across all batches of a stream.

    time: the event-time column. With it the state forgets after the watermark passes, repeats that are more than `late` apart count anew, and rows that come later
    than that are dropped; without it the state keeps a digest of every finding.
    """
    keyed = findings.withColumn("_seen", F.sha2(F.to_json(F.struct("source", "relpath", "line", "rule", "start", "match")), 256))
    if time is None:
        return keyed.dropDuplicates(["_seen"]).drop("_seen")
    marked = keyed.withWatermark(time, late) if keyed.isStreaming else keyed
    return (marked.dropDuplicatesWithinWatermark(["_seen"]) if keyed.isStreaming else marked.dropDuplicates(["_seen"])).drop("_seen")


def start_scan(
    strings: DataFrame, rules: Sequence[Rule], out: str, checkpoint: str, words: Sequence[str] = (), detectors: Sequence[Detector] = (), ignores: DataFrame | None = None, once: bool = False, time: str | None = None, late: str = "1 day", **trigger
) -> StreamingQuery:
    """Append the published fields of findings (and the time column) to a Parquet table; exactly once by the checkpoint.

    words, detectors: as in scan. ignores: (kind, entry) rows to leave out. once: each finding only the first time it is seen.
    """
    found = scan(strings, rules, words=words, detectors=detectors)
    if ignores is not None:
        found = without_ignored(found, ignores)
    if once:
        found = first_seen_only(found, time, late)
    shown = records(found) if time is None else records(found.withColumn("_time", F.col(time)), also=["_time"]).withColumnRenamed("_time", time)
    return shown.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start(out)


def windowed_counts(findings: DataFrame, time: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Findings per rule and time window, on batches and on streams; rows later than the watermark are dropped in a stream."""
    marked = findings.withWatermark(time, late) if findings.isStreaming else findings
    return marked.groupBy(F.window(time, window).alias("w"), "rule").agg(F.count(F.lit(1)).alias("findings")).select(F.col("w.start").alias("window_start"), "rule", "findings")
