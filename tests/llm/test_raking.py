"""Iterative proportional fitting: both forms against numpy, targets out of reach, odd rows and clashing names."""

import random

import numpy as np
import pytest

from leaksieve.llm import raking

WANT = {"source": {s: (i + 1) / 15 for i, s in enumerate("abcde")}, "lang": {"x": 0.5, "y": 0.3, "z": 0.2}, "topic": {"p": 0.25, "q": 0.75}}


def tables(spark, want):
    return {d: spark.createDataFrame(list(v.items()), "value string, share double") for d, v in want.items()}


@pytest.mark.parametrize("row_cells", [raking.ROW_CELLS, 3])
def test_raking_equals_numpy(spark, row_cells):
    rng = random.Random(11)
    rows = [(s, g, t, rng.randrange(0, 500)) for s in "abcde" for g in "xyz" for t in "pq"]
    w = np.array([r[3] for r in rows], float).reshape(5, 3, 2)
    w /= w.sum()
    for _ in range(200):
        for axis, d in enumerate(raking.DIMENSIONS):
            rest = tuple(k for k in range(3) if k != axis)
            factor = np.array(list(WANT[d].values())) / w.sum(axis=rest)
            w = w * factor.reshape([-1 if k == axis else 1 for k in range(3)])
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, w0 long")
    got = {(r.source, r.lang, r.topic): r for r in raking.rake(cells, tables(spark, WANT), rounds=60, row_cells=row_cells).collect()}
    assert all(r.converged for r in got.values())
    assert max(abs(got[r[:3]].w - x) for r, x in zip(rows, w.ravel(), strict=True)) < 1e-8


@pytest.mark.parametrize("row_cells", [raking.ROW_CELLS, 1])
def test_targets_out_of_reach_say_so(spark, row_cells):
    # source a occurs in language x only, so 0.9 for a and 0.2 for x can't both hold
    cells = spark.createDataFrame([("a", "x", "p", 10), ("b", "y", "p", 10), ("c", "y", "p", 5)], "source string, lang string, topic string, w0 long")
    want = {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.2, "y": 0.8}, "topic": {"p": 1.0}}
    rows = {r.source: r for r in raking.rake(cells, tables(spark, want), rounds=5, row_cells=row_cells).collect()}
    assert not any(r.converged for r in rows.values()) and rows["c"].w == 0.0


def test_mixing_handles_odd_rows(spark):
    texts = [f"word {'x ' * (i % 50)}" for i in range(600)] + [None, "", " \n\t ", "あ" * 50, "long " * 20000, "a@b | c"]
    rows = [(i if i % 100 else None, t, None if i % 7 == 0 else "en", ("a", "a", "a", "b", None)[i % 5], 1.5, "r", "c") for i, t in enumerate([*texts, *texts[:20]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, chance double, row string, cell string").repartition(3)
    got = raking.calibrated(df).collect()
    assert len(got) == len(rows) and max(r.probability for r in got) == 1.0 and all(r.converged for r in got)
    taken = sorted((r.doc_id or -1) for r in got if r.sampled)
    mixed = raking.mixed(df, power=0.7)
    assert mixed.columns == df.columns and sorted((r.doc_id or -1) for r in mixed.collect()) == taken
    empty = df.where("false")
    assert raking.calibrated(empty).count() == 0 and raking.mixed(empty).count() == 0


def test_targets_change_what_is_drawn(spark):
    df = spark.createDataFrame([(i, "some words here", "en", "big" if i % 10 else "small") for i in range(4000)], "doc_id long, text string, lang string, source string")
    want = {"source": {"big": 0.5, "small": 0.5}, "lang": {"en": 1.0}, "topic": {"prose": 1.0}}
    drawn = {r.source: r["count"] for r in raking.mixed(df, targets=tables(spark, want)).groupBy("source").count().collect()}
    assert drawn["small"] == 400 and 300 < drawn["big"] < 520
