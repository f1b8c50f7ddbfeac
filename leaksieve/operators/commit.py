"""Validated writes of redacted files, in two phases, with an audit and a vault.

A run first stages all rewritten lines, then judges every file by them: a file passes if every change could be applied, changed
JSON still parses, and no line break came or went. Only files that pass are written, each run into folders of its own, and the
audit last: a run without audit rows doesn't exist for readers, so a run that broke off can simply be repeated. One refused file
stops no other one.

    target/files/run=..  file, line, raw of the files that passed     target/vault/run=..  file, line, original of changed lines
    target/audit/run=..  ts, file, digests, bytes, changed lines

Digests are trees of SHA-256: of a file's lines in blocks of BLOCK by line number, then of its blocks, so a file of any size is
digested by many tasks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.functions.text import without_end
from leaksieve.operators.staging import staged

BLOCK = 4096
KINDS = ("jsonl", "json", "text")
_FILES = "file string, line long, raw string, run string"
_VAULT = "file string, line long, original string, run string"
_AUDIT = "ts timestamp, file string, original_digest string, new_digest string, bytes_before long, bytes_after long, changed_lines long, run string"


def _breaks(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\r\n|\r|\n"))


def file_statuses(rows: DataFrame, kind: str) -> DataFrame:
    """file, status (ok, skip, fail), note, lines, changed_lines, bytes and digests before and after.

    rows: (file, line, raw, changed, failed, was) as the rewriters give them. A file without a change is skipped.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    was = F.coalesce("was", "raw")
    body = F.trim(without_end(F.col("raw")))
    broken = (F.col("changed") & (body != "") & F.try_parse_json(body).isNull()) if kind == "jsonl" else F.lit(False)  # the rewriter has parsed whole files
    moved = F.col("changed") & (_breaks(F.col("raw")) != _breaks(was))
    count = lambda c: F.sum(c.cast("long"))
    tree = lambda d: F.sha2(F.array_join(F.transform(F.array_sort(d), lambda x: x["d"]), ""), 256)
    lines = rows.select("file", "line", "changed", "failed", broken.alias("broken"), moved.alias("moved"), F.octet_length("raw").alias("b_new"), F.octet_length(was).alias("b_old"), F.sha2("raw", 256).alias("d_new"), F.sha2(was, 256).alias("d_old"))
    blocks = lines.groupBy("file", F.floor(F.col("line") / BLOCK).alias("block")).agg(
        F.count(F.lit(1)).alias("lines"),
        *(count(F.col(c)).alias(c) for c in ("changed", "failed", "broken", "moved")),
        *(F.sum(c).alias(c) for c in ("b_old", "b_new")),
        *(tree(F.collect_list(F.struct("line", F.col(c).alias("d")))).alias(c) for c in ("d_old", "d_new")),
    )
    files = blocks.groupBy("file").agg(
        *(F.sum(c).alias(c) for c in ("lines", "changed", "failed", "broken", "moved", "b_old", "b_new")), *(tree(F.collect_list(F.struct("block", F.col(c).alias("d")))).alias(c) for c in ("d_old", "d_new"))
    )
    note = F.when(F.col("failed") > 0, "a change could not be applied").when(F.col("broken") > 0, "a line would not parse").when(F.col("moved") > 0, "the number of lines would change")
    status = F.when(note.isNotNull(), "fail").when(F.col("changed") > 0, "ok").otherwise("skip")
    return files.select("file", status.alias("status"), note.alias("note"), "lines", F.col("changed").alias("changed_lines"), F.col("b_old").alias("bytes_before"), F.col("b_new").alias("bytes_after"), F.col("d_old").alias("original_digest"), F.col("d_new").alias("new_digest"))


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the target; empty where nothing was written yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def audit_log(spark: SparkSession, target: str) -> DataFrame:
    """ts, run, file, digests, bytes and changed_lines of every file ever written."""
    return _table(spark, f"{target}/audit", _AUDIT)


def vault(spark: SparkSession, target: str) -> DataFrame:
    """file, line, original, run: plaintext of changed lines, of committed runs (purge a run by dropping its folder)."""
    done = audit_log(spark, target).select("run", "file")
    return _table(spark, f"{target}/vault", _VAULT).join(done, ["run", "file"], "left_semi").select("file", "line", "original", "run")


def current(spark: SparkSession, target: str) -> DataFrame:
    """file, line, raw of the last committed version of every file."""
    last = audit_log(spark, target).groupBy("file").agg(F.max_by("run", F.struct("ts", "run")).alias("run"))
    return _table(spark, f"{target}/files", _FILES).join(last, ["file", "run"], "left_semi").select("file", "line", "raw")


def commit(rows: DataFrame, target: str, run_id: str, kind: str) -> DataFrame:
    """Judge the rewritten files and write those that pass; returns the statuses (file, status, note, lines, changed_lines, bytes and digests).

    rows: (file, line, raw, changed, failed, was). A file whose last committed version equals the new one is skipped, so a second run on the
    same input writes nothing. Repeating a run_id replaces that run.
    """
    if not re.fullmatch(r"[\w.-]+", run_id):
        raise ValueError("a run id has letters, digits and ._- only")
    spark = rows.sparkSession
    work = staged(rows.select("file", "line", "raw", "changed", "failed", "was"))
    judged = file_statuses(work, kind)
    known = audit_log(spark, target).where(F.col("run") != run_id).groupBy("file").agg(F.max_by("new_digest", F.struct("ts", "run")).alias("_known"))
    same = (F.col("status") == "ok") & F.coalesce(F.col("_known") == F.col("new_digest"), F.lit(False))
    statuses = staged(judged.join(known, "file", "left").withColumns({"note": F.when(same, "already written").otherwise(F.col("note")), "status": F.when(same, "skip").otherwise(F.col("status"))}).drop("_known"))
    passed = statuses.where(F.col("status") == "ok")
    if passed.isEmpty():
        return statuses
    mine = work.join(passed.select("file"), "file", "left_semi")
    write = lambda df, name: df.write.mode("overwrite").parquet(f"{target}/{name}/run={run_id}")
    write(mine.where("changed").select("file", "line", F.col("was").alias("original")), "vault")
    write(mine.select("file", "line", "raw"), "files")
    write(passed.select(F.current_timestamp().alias("ts"), "file", "original_digest", "new_digest", "bytes_before", "bytes_after", "changed_lines"), "audit")
    return statuses


def rolled_back(spark: SparkSession, target: str) -> DataFrame:
    """file, line, raw of the last committed versions with the originals of their changed lines put back."""
    last = audit_log(spark, target).groupBy("file").agg(F.max_by("run", F.struct("ts", "run")).alias("run"))
    old = vault(spark, target).join(last, ["file", "run"], "left_semi").select("file", "line", "original")
    return current(spark, target).join(old, ["file", "line"], "left").select("file", "line", F.coalesce("original", "raw").alias("raw"))
