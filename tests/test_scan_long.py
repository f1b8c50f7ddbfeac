"""Texts of more than a million characters are scanned and redacted to their end."""

import pytest
from pyspark.sql import functions as F

from leaksieve.functions.rules import builtin_rules
from leaksieve.operators import redact, scan

KEY = "AKIA" + "Q7" * 8


@pytest.mark.parametrize("filler", ["word ", "wörd "])  # the JVM's patterns and Python's
def test_secret_behind_a_million_characters(spark, filler):
    rules = [r for r in builtin_rules() if r.rule in ("aws-access-key", "github-pat")]
    start = 1_000_100
    df = spark.range(1).select(F.concat(F.repeat(F.lit(filler), start // 5), F.lit(KEY + " end")).alias("value"))
    assert [(r.start, r.end, r.match) for r in scan.scan(df, rules).collect()] == [(start, start + 20, KEY)]
    done = redact.redact_column(df, "value", rules).select(F.right("redacted", F.lit(29)).alias("tail"), "n_redacted").first()
    assert (done.tail, done.n_redacted) == ("[REDACTED:aws-access-key] end", 1)
    assert scan.with_hits(df, "value", rules, cap=1_000_000).select(F.size("hits")).first()[0] == 0
