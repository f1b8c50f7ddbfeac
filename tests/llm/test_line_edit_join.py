"""The edit join and the distance behind it, against brute force."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from leaksieve.llm import line_edit_join as join
from leaksieve.llm.edit_distance import within


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(a, b):
    n = min(len(a), len(b))
    edits = 2 if n >= 24 else 1 if n >= 12 else 0
    return abs(len(a) - len(b)) <= edits and levenshtein(a, b) <= edits


def classes(lines):
    """line -> least number of its class, by brute force."""
    lines = sorted(set(lines))
    label = {x: i for i, x in enumerate(lines)}
    for a, b in itertools.combinations(lines, 2):
        if label[a] != label[b] and near(a, b):
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {x: new if v == old else v for x, v in label.items()}
    return label


def edited(rng, text, most, letters="zq é"):
    out = list(text)
    for _ in range(rng.randrange(most + 1)):
        at, kind = rng.randrange(len(out) + 1), rng.randrange(3)
        if kind == 0:
            out.insert(at, rng.choice(letters))
        elif out:
            out[min(at, len(out) - 1)] = rng.choice(letters) if kind == 1 else ""
    return "".join(out)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_distance_equals_brute_force(spark, edits):
    rng = random.Random(edits)
    rows = [("", ""), ("a", ""), ("", "abc"), ("abcdef", "abcxef"), ("a" * 500, "a" * 502), ("퟿", "x")]
    for _ in range(600):
        letters = rng.choice(["ab", "abcdefgh", "aé中😀"])
        a = "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 20, 60])))
        rows.append((a, edited(rng, a, 6, letters) if rng.random() < 0.9 else "".join(rng.choice(letters) for _ in a)))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", within(F.col("a"), F.col("b"), edits).alias("w")).collect()
    assert all(r.w == (levenshtein(r.a, r.b) <= edits) for r in got) and 50 < sum(r.w for r in got) < 600


def test_counted_classes_are_disjoint(spark):
    chars = spark.createDataFrame([(chr(c),) for c in (*range(9, 14), *range(32, 127), 233, 160)], "c string")
    hits = sum((F.regexp_count("c", F.lit(f"[{c}]")) for c in join.COUNTED), F.lit(0))
    assert chars.select("c", hits.alias("n")).where("n > 1").collect() == []


def linked(spark, lines, **how):
    """Sets of lines that share a class."""
    rows = spark.createDataFrame([(x,) for x in lines], "text string").select(F.xxhash64("text").alias("id"), F.xxhash64(F.lit(1), F.col("text")).alias("id2"), "text")
    found = collections.defaultdict(set)
    texts_of = lambda ids: rows.join(ids, "id", "left_semi").dropDuplicates(["id"])
    for r in join.edit_links(join.with_keys(rows.repartition(3)), texts_of, **how).join(rows, ["id", "id2"]).collect():
        found[r.label].add(r.text)
    return {frozenset(v) for v in found.values()}


def wanted(lines):
    found = collections.defaultdict(set)
    for x, label in classes(lines).items():
        found[label].add(x)
    return {frozenset(v) for v in found.values() if len(v) > 1}


@pytest.mark.parametrize("pairs_listed", [join.PAIRS, 3])
def test_classes_equal_brute_force(spark, pairs_listed):
    rng = random.Random(31)
    text = lambda n, letters="stea rod": "".join(rng.choice(letters) for _ in range(n))
    head, tail = "one template for all of it: ", " and the same end again"
    lines = [head + text(18) + tail for _ in range(40)]  # hot segments, hardly a link
    lines += [edited(rng, rng.choice(lines[:40]), 2, "ste ") for _ in range(60)]
    lines += [f"{head}{rng.randrange(10**4):05d}{tail}" for _ in range(40)]  # chains of links
    lines += [edited(rng, text(n), 0) for n in range(12, 60) for _ in range(2)]
    lines += [edited(rng, rng.choice(lines[-96:]), 3) for _ in range(120)]
    lines += [x[:k] for x in lines[:8] for k in (11, 12, 13, 22, 23, 24, 25)]
    want = wanted(lines)
    assert len(want) > 20 and linked(spark, lines, pairs_listed=pairs_listed) == want


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars int, row string, mark string, linked int, kept string").repartition(3)


def test_reports_and_removal_equal_brute_force(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdef é") for _ in range(rng.randrange(24, 60))).strip() for _ in range(12)]
    pick = lambda: rng.choice([edited(rng, rng.choice(base), 3).strip(), rng.choice(base), "short", "", "exactly ten", "  padded line \t\r", "padded line"])
    texts = ["\n".join(pick() for _ in range(6)) for _ in range(40)] + [None, "", " \n", "one", "é" * 300, "x" * 100_000, "a\nb\nc", "tie", "tie"]
    rows = [(i, t, len(t or ""), "r", "m", 1, None) for i, t in enumerate(texts)]
    # repeated rows, two texts under one doc_id, rows without an id
    unique = "a line that occurs in this place and nowhere else"
    more = [rows[0], rows[0], (100, base[0] + "\n" + unique, None, None, None, None, None), (100, base[1] + "\n" + base[0], 7, "r", "m", 1, "k"), (None, base[0], 3, "r", "m", 1, "k")]
    df = frame(spark, rows + more)
    docs = [*rows, *more[2:4]]
    every = [(r[0], d, k, x.strip(" \t\r")) for d, r in enumerate(docs) for k, x in enumerate((r[1] or "").split("\n")) if x.strip(" \t\r")]
    label = classes(x for *_, x in every)
    groups = collections.defaultdict(list)
    for i, d, k, x in every:
        groups[label[x]].append((i, d, k, x))
    report = join.line_report(df).collect()
    assert len(report) == len(rows) + len(more)
    first = {v: min(g, key=lambda r: r[:1] + r[2:3]) for v, g in groups.items()}
    for r in report:
        if r.doc_id is None:
            assert (r.n_linked, r.n_links) == (0, 0)
        elif r.doc_id < 100:
            mine = [x for x in every if x[0] == r.doc_id and len(groups[label[x[3]]]) > 1]
            assert [x.line for x in r.linked] == sorted(x[2] for x in mine)
            for x, got in zip(sorted(mine, key=lambda x: x[2]), r.linked, strict=True):
                head = first[label[x[3]]]
                assert got.first_doc == head[0] and got.removed == (x[:3] != head[:3] and len(x[3]) >= 10)
                assert got.near == (x[3] != head[3])
            assert r.n_removed == sum(x.removed for x in r.linked) and r.n_links == sum(x.others for x in r.linked)
    kept = join.without_repeated_lines(df)
    assert kept.columns == df.columns
    by_id = collections.defaultdict(list)
    for r in kept.collect():
        by_id[r.doc_id].append(r)
    assert sorted(r.text.split("\n")[-1] for r in by_id[100] if r.text) == [unique] and len(by_id[100]) == 2 and by_id[None][0].text == base[0]
    for i, t in enumerate(texts):
        gone = {x[2] for x in every if x[0] == i and first[label[x[3]]][:3] != x[:3] and len(x[3]) >= 10}
        want = t if not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        assert all((r.text, r.n_chars, r.row) == (want, len(want or ""), "r") for r in by_id[i]) and len(by_id[i]) == (3 if i == 0 else 1)
    empty = df.where("false")
    assert join.line_report(empty).count() == 0 and join.without_repeated_lines(empty).count() == 0
