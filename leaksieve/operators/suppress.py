"""Suppression: rule filters and ignore entries as anti-joins, with the number of suppressed findings."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from leaksieve.functions.rules import Rule, select_rules
from leaksieve.functions.text import fingerprint, glob_pattern, ignore_kind
from leaksieve.operators.staging import staged


def only_rules(findings: DataFrame, rules: Sequence[Rule], only: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    """Findings of the selected rules; runs after overlap resolution and doesn't count as suppression."""
    names = select_rules(rules, only, exclude)
    return findings if len(names) == len({r.rule for r in rules}) else findings.where(F.col("rule").isin(*sorted(names)))


def parse_ignores(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of ignore files (any number, by union) -> distinct (kind, entry)."""
    return lines.select(ignore_kind(F.col(column)).alias("i")).where(F.col("i").isNotNull()).select("i.kind", "i.entry").distinct()


def ignores_of(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    return parse_ignores(spark.createDataFrame([(x,) for x in lines], "value string"))


@F.pandas_udf(StructType([StructField(c, StringType()) for c in ("before", "after", "pattern")]))
def _glob_parts(globs: pd.Series) -> pd.DataFrame:
    """The literal text before a glob's first and after its last wildcard, and its pattern."""
    cut = [re.split(r"[*?\[]", g, maxsplit=1)[0] for g in globs]
    ends = [re.split(r"[*?\]]", g)[-1] if c != g else "" for c, g in zip(cut, globs, strict=True)]
    return pd.DataFrame({"before": cut, "after": ends, "pattern": [glob_pattern(g) for g in globs]})


def glob_patterns(ignores: DataFrame) -> DataFrame:
    """_pattern of each path glob among the ignore entries."""
    return ignores.where(F.col("kind") == "path").select(_glob_parts("entry")["pattern"].alias("_pattern")).distinct()


def paths_under_globs(paths: DataFrame, globs: DataFrame) -> DataFrame:
    """The distinct paths (column path) that match one of the globs (column entry).

    Globs and paths meet by equality: on the literal beginning of a glob (a path has one candidate for each length that occurs among the globs'
    beginnings), or on its literal end where it has no beginning; only pairs that meet are matched. A glob with neither is tested on all paths.
    """
    parts = staged(globs.select(_glob_parts("entry").alias("g")).select("g.*").distinct())
    paths = paths.select("path").distinct()

    def meet(side: str, some: DataFrame, cut) -> DataFrame:
        lengths = some.agg(F.sort_array(F.collect_set(F.length(side))).alias("_lengths"))  # one row, as long as paths are
        keyed = paths.crossJoin(lengths).select("path", F.explode(F.filter("_lengths", lambda n: n <= F.length("path"))).alias("_n"))
        return keyed.withColumn("_key", cut(F.col("path"), F.col("_n"))).join(some, F.col("_key") == F.col(side)).where(F.rlike("path", F.col("pattern"))).select("path")

    by_start = meet("before", parts.where(F.col("before") != ""), lambda p, n: F.substring(p, F.lit(1), n))
    by_end = meet("after", parts.where((F.col("before") == "") & (F.col("after") != "")), lambda p, n: F.right(p, n))
    loose = parts.where((F.col("before") == "") & (F.col("after") == "")).select("pattern")
    anywhere = paths.join(loose, F.rlike("path", F.col("pattern")), "left_semi")
    return by_start.unionByName(by_end).unionByName(anywhere).distinct()


def _slashed(path: str):
    return F.regexp_replace(path, r"\\", "/")


def with_suppression(findings: DataFrame, ignores: DataFrame) -> DataFrame:
    """findings (relpath, line, rule, match ..) with suppressed: whether an ignore entry covers them.

    Four equi-joins, by rule, fingerprint, value and matched path, which Spark broadcasts or shuffles by size.
    """
    entries = lambda kind: ignores.where(F.col("kind") == kind).select(F.col("entry").alias(f"_{kind}")).distinct()
    out = findings.withColumns({"_fp": fingerprint(_slashed("relpath"), F.col("line"), F.col("rule")), "_at": _slashed("relpath")})
    out = out.join(entries("rule"), F.col("rule") == F.col("_rule"), "left")
    out = out.join(entries("fingerprint"), F.col("_fp") == F.col("_fingerprint"), "left")
    out = out.join(entries("value"), F.col("match") == F.col("_value"), "left")
    globs = ignores.where(F.col("kind") == "path").select("entry").distinct()
    hit = F.col("_rule").isNotNull() | F.col("_fingerprint").isNotNull() | F.col("_value").isNotNull()
    if not globs.isEmpty():
        matched = paths_under_globs(findings.select(_slashed("relpath").alias("path")), globs).select(F.col("path").alias("_path"))
        out = out.join(matched, F.col("_at") == F.col("_path"), "left")
        hit = hit | F.col("_path").isNotNull()
    return out.withColumn("suppressed", hit).select(*findings.columns, "suppressed")


def suppress(findings: DataFrame, ignores: DataFrame) -> DataFrame:
    """The findings that no ignore entry covers."""
    return with_suppression(findings, ignores).where(~F.col("suppressed")).drop("suppressed")
