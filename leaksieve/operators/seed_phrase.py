"""Wallet seed phrases of a table of strings. The word list is a parameter: the 2048 words of a standard list, in its order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.functions.rules import SEED_PHRASE, builtin_rules
from leaksieve.operators.scan import scan
from leaksieve.sources.readers import split_lines


def word_list(spark: SparkSession, path: str) -> list[str]:
    """The 2048 words of a standard list from its file, a word a line, in order: what `words` takes everywhere. Other files are refused."""
    lines = split_lines(spark, [path]).select("line", F.trim("raw").alias("word")).where(F.col("word") != "").orderBy("line").limit(2049).collect()
    words = [r.word for r in lines]
    if len(words) != 2048 or len(set(words)) != 2048:
        raise ValueError("a word list has 2048 different words")
    return words


def n_words(match: Column) -> Column:
    return F.regexp_count(match, F.lit("[A-Za-z]+")).cast("long")


def seed_phrases(strings: DataFrame, words: Sequence[str], value: str = "value") -> DataFrame:
    """The other columns of strings with rule, n_words, start, end, match and masked of each phrase, by the detector alone."""
    if len(words) != 2048 or len(set(words)) != 2048:
        raise ValueError("a word list has 2048 different words")
    keys = [c for c in strings.columns if c != value]
    found = scan(strings, [r for r in builtin_rules() if r.rule == SEED_PHRASE], value, words)
    return found.select(*keys, "rule", n_words(F.col("match")).alias("n_words"), "start", "end", "match", "masked")
