"""The per-file budget against a plain running total."""

import random

from pyspark.sql import functions as F

from leaksieve.operators.budget import within_budget
from leaksieve.sources.readers import jsonl_strings, text_strings

SCHEMA = "source string, file string, line long, seq int, value string, cut string, n long"


def kept(rows, budget):
    out = []
    for file in {r[:2] for r in rows}:
        mine = [r for r in rows if r[:2] == file]
        order = lambda r: tuple(-(2**63) if v is None else v for v in r[2:4])
        used = 0
        for at in sorted({order(r) for r in mine}):
            here = [r for r in mine if order(r) == at]
            if None in file or used <= budget:
                out += here
            used += sum(len(r[4] or "") for r in here)
    return sorted(out, key=repr)


def check(spark, rows, budget, cell):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    got = within_budget(df, budget, cell)
    assert got.columns == df.columns
    assert sorted(((r.source, r.file, r.line, r.seq, r.value) for r in got.collect()), key=repr) == kept(rows, budget)


def test_against_a_running_total(spark):
    rng = random.Random(2)
    rows = [("a", f"f{rng.randrange(4)}", rng.choice([rng.randrange(30), rng.randrange(10**7), 2**40 + rng.randrange(5)]), rng.choice([0, 1, 2, 5000, 3_000_000]), "x" * rng.randrange(30)) for _ in range(400)]
    rows += [("b", "long", k, 0, "y" * 7) for k in range(600)] + [("b", "one line", 1, k, "z" * 3) for k in range(1500)]
    rows += [("b", "odd", None, None, "abc")] * 4 + [("b", None, 1, 0, "q" * 900), ("b", "null", 1, 0, None), ("b", "long", 3, 0, "y" * 7)]
    for budget in (0, 40, 1000):
        check(spark, rows, budget, 50_000)
        check(spark, rows, budget, 20)  # every digit is refined
    assert within_budget(spark.createDataFrame([], SCHEMA), 10).collect() == []


def test_a_hot_place_is_one_cell(spark):
    rows = [("a", "f", 7, 1, "x" * 10)] * 200 + [("a", "f", 8, 0, "late"), ("a", "f", 7, 0, "early")]
    check(spark, rows, 100, 20)


def test_readers_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f'{{"a": "first leaf {k}", "b": "second leaf"}}\n' for k in range(10)))
    (tmp_path / "b.txt").write_text("".join(f"line {k:2} of a text\n" for k in range(30)))
    strings = jsonl_strings(spark, [str(tmp_path / "a.jsonl")], "j").unionByName(text_strings(spark, [str(tmp_path / "b.txt")], "t"))
    got = within_budget(strings.withColumn("name", F.element_at(F.split("file", "/"), -1)), 40).orderBy("name", "line", "seq").collect()
    assert [(r.name, r.line, r.seq) for r in got] == [("a.jsonl", 1, 0), ("a.jsonl", 1, 1), ("a.jsonl", 2, 0), ("a.jsonl", 2, 1), ("b.txt", 1, 0), ("b.txt", 2, 0), ("b.txt", 3, 0)]
