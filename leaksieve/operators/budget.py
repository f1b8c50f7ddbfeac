"""Per-file limits and accounts.

A file's budget cuts its strings in their order (line, then seq). No text moves for it: lengths are summed per file first, and
only files over budget are looked at again, as narrow rows. Their cut is found digit by digit of the order: sums per cell of a
digit, a running sum over the cells, and only the cell that crosses the budget is refined, so a file of any size is never one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaksieve.operators.staging import staged

#: Fixed value: code points scanned per file.
FILE_BUDGET = 50_000_000
ORDER = ("line", "seq")
#: Bits of the lower digits of an order column, and the rows of a cell that are simply sorted.
DIGIT, SORTED = 10, 10_000
_FILE = ["source", "file"]


def _digits(keys: list[str]) -> list[Column]:
    return [d for k in keys for d in (F.shiftright(k, 2 * DIGIT), F.shiftright(k, DIGIT).bitwiseAND((1 << DIGIT) - 1), F.col(k).bitwiseAND((1 << DIGIT) - 1))]


def cut_points(narrow: DataFrame, keys: list[str], budget: int, rows: int = SORTED) -> DataFrame:
    """source, file, cut: the order (struct of keys) of the last string kept. narrow: source, file, keys (longs), n; every file exceeds the budget."""
    cells = narrow.withColumn("base", F.lit(0).cast("long"))
    digits = _digits(keys)
    for i, digit in enumerate(digits):
        most = cells.groupBy(*_FILE).agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0]
        if most is None or most <= rows:
            break
        sums = cells.groupBy(*_FILE, "base", digit.alias("cell")).agg(F.sum("n").alias("size"))
        upto = F.col("base") + F.sum("size").over(Window.partitionBy(*_FILE).orderBy("cell"))
        crossing = sums.withColumn("upto", upto).where((F.col("upto") > budget) & (F.col("upto") - F.col("size") <= budget))
        inner = crossing.select(*_FILE, "cell", (F.col("upto") - F.col("size")).alias("at"))
        cells = staged(cells.join(inner, _FILE).where(digit == F.col("cell")).select(*_FILE, *keys, "n", F.col("at").alias("base")))
        if i == len(digits) - 1:  # one order value is left of each file
            return cells.groupBy(*_FILE).agg(F.min(F.struct(*keys)).alias("cut"))
    running = F.col("base") + F.sum("n").over(Window.partitionBy(*_FILE).orderBy(*keys))  # rows of equal order share it
    return cells.withColumn("upto", running).where(F.col("upto") > budget).groupBy(*_FILE).agg(F.min(F.struct(*keys)).alias("cut"))


def within_budget(strings: DataFrame, budget: int | None = FILE_BUDGET, rows: int = SORTED) -> DataFrame:
    """The strings of each file, by line and seq, up to and with the one that makes the running total exceed the budget.

    Rows of one place stand or fall together; a string without source or file has no budget; None sets none. rows: cells of the order with at most so
    many strings are sorted, larger ones are refined.
    """
    if budget is None:
        return strings
    keys = [k for k in ORDER if k in strings.columns]
    order = [F.coalesce(F.col(k).cast("long"), F.lit(-(2**63))).alias(f"_{k}") for k in keys]
    narrow = strings.select(*_FILE, *order, F.coalesce(F.length("value"), F.lit(0)).cast("long").alias("n")).dropna(subset=_FILE)
    over = staged(narrow.groupBy(*_FILE).agg(F.sum("n").alias("chars")).where(F.col("chars") > budget))
    if over.isEmpty():
        return strings
    names = [f"_{k}" for k in keys]
    cuts = staged(cut_points(staged(narrow.join(over.select(*_FILE), _FILE, "left_semi")), names, budget, rows))
    at = F.struct(*(o.alias(n) for o, n in zip(order, names, strict=True)))
    ends = cuts.select(*(F.col(c).alias(f"_cut_{c}") for c in _FILE), F.col("cut").alias("_cut"))
    same = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_cut_{c}") for c in _FILE))
    return strings.join(ends, same, "left").where(F.col("_cut").isNull() | (at <= F.col("_cut"))).select(*strings.columns)


def truncated_files(strings: DataFrame, budget: int | None = FILE_BUDGET) -> DataFrame:
    """source, file, chars of the files that exceed the budget (partial sums only)."""
    sums = strings.groupBy(*_FILE).agg(F.sum(F.length("value")).alias("chars"))
    return sums.where(F.lit(False) if budget is None else F.col("chars") > budget)


def scan_quality(lines: DataFrame, listed: DataFrame | None = None, truncated: DataFrame | None = None) -> DataFrame:
    """file, unparseable_lines, unreadable, truncated: lines is (file, raw, failed); listed names all files that were found."""
    per = lines.groupBy("file").agg(F.sum(F.col("failed").cast("long")).alias("unparseable_lines"))
    out = per if listed is None else listed.select("file").distinct().join(per, "file", "left")
    out = out.withColumn("unreadable", F.col("unparseable_lines").isNull()).fillna(0, ["unparseable_lines"])
    if truncated is None:
        return out.withColumn("truncated", F.lit(False))
    return out.join(truncated.select("file", F.lit(True).alias("truncated")).distinct(), "file", "left").fillna(False, ["truncated"])
