"""The line model against enumeration of all labellings, plain statistics, and held-out accuracy."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from leaksieve.llm import quality_crf as Q

SCHEMA = "doc_id long, text string, score double, line long, quality int"


def test_chains_against_all_labellings():
    rng = np.random.default_rng(4)
    counts = np.array([3, 1, 6, 2, 6])
    scores, pairs = rng.normal(size=counts.sum()), rng.normal(size=(2, 2))
    total, good, expected = Q.chain(scores, counts, pairs)
    want_total, want_pairs, at = 0.0, np.zeros((2, 2)), 0
    for n in counts:
        own = scores[at : at + n]
        weights = {y: math.exp(sum(own[i] * y[i] for i in range(n)) + sum(pairs[a, b] for a, b in zip(y, y[1:], strict=False))) for y in itertools.product((0, 1), repeat=n)}
        z = sum(weights.values())
        want_total += math.log(z)
        for i in range(n):
            assert good[at + i] == pytest.approx(sum(w for y, w in weights.items() if y[i]) / z)
        for y, w in weights.items():
            for a, b in zip(y, y[1:], strict=False):
                want_pairs[a, b] += w / z
        at += n
    assert total == pytest.approx(want_total)
    assert expected == pytest.approx(want_pairs)


def test_long_chain_stays_finite():
    total, good, _ = Q.chain(np.full(50_000, 30.0), np.array([50_000]), np.array([[2.0, -2.0], [-2.0, 2.0]]))
    assert math.isfinite(total) and good.min() > 0.999


def test_statistics_against_plain_ones():
    texts = ["a b a\nX! y? \n\na b a", "", "é" * 40, " \t\n", "# $ x\r\nA1 {}.", "w " * 3000, "p q r s p q r t\nlast."]
    own, counts, size = Q.own_features([t.encode() for t in texts])
    at = 0
    for text, n in zip(texts, counts, strict=True):
        lines = text.encode().split(b"\n")
        assert n == len(lines)
        words = text.encode().split()
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else []
        for i, x in enumerate(lines):
            w = x.split()
            filled = max(1, len(x) - sum(x.count(c) for c in b" \t\n\x0b\x0c\r"))
            some = max(1, len(w))
            share = lambda chars: math.sqrt(sum(x.count(c) for c in chars) / filled)  # noqa: B023, E731
            want = [math.log1p(len(w)) / 6, not w, share(b"#*$%&|<>"), any(c in b"#*$%&|<>" for c in x), share(b"!?"), share(b".,;:"), share(b"{}[]()=\\/_~^+@`"), share(b"0123456789"), share(bytes(range(65, 91)))]
            want += [min(filled / some, 20) / 10, 1 - len(set(w)) / some if w else 0, bool(w) and x in lines[:i], 1 - len(set(windows)) / len(windows) if windows else 0, bool(w) and w[-1][-1:] in b".!?"]
            assert list(own[at]) == pytest.approx([float(v) for v in want])
            assert size[at] == len(x)
            at += 1
    wide = Q.with_neighbours(own, counts)
    k = len(Q.OWN)
    assert wide.shape[1] == Q.WIDTH
    assert list(wide[1, k : 2 * k]) == list(own[0]) and list(wide[1, 2 * k : 3 * k]) == list(own[2])
    assert not wide[0, k : 2 * k].any() and not wide[3, 2 * k : 3 * k].any() and list(wide[0, -3:]) == [1, 1, 0] and list(wide[4, -3:]) == [1, 1, 1]


def corpus(n):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeiounrst") for _ in range(rng.randrange(2, 9)))
    good = lambda: " ".join(word() for _ in range(rng.randrange(5, 30))) + "."
    bad = lambda: rng.choice([lambda: " ".join(word() + rng.choice(["###", "$$$"]) for _ in range(20)), lambda: " ".join(word().upper() + "!!" for _ in range(15)), lambda: " ".join([word()] * 20)])()
    rows = []
    for i in range(n):
        is_bad = rng.random() < 0.3
        lines = [bad() if is_bad and rng.random() < 0.7 else good() for _ in range(rng.randrange(1, 9))]
        if is_bad:
            lines.append(bad())
        rows.append((i, "\n".join(lines), 0.5, 1, 0 if is_bad else 1))
    return rows


def test_held_out_accuracy_and_repeats(spark):
    rows = corpus(900)
    copies = [rows[7]] * 500  # one document under one id, many times: one row of the sample
    docs = spark.createDataFrame(rows + copies, SCHEMA).repartition(4)
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows] + [(rows[7][0], rows[7][4])] * 300 + [(None, 1), (5, None)], "doc_id long, quality int")
    assert Q.labelled_sample(docs, labels, 100, 64).count() == 100
    sampled = {r.doc_id for r in Q.labelled_sample(docs, labels, 10_000, 64).select("doc_id").collect()}
    assert sampled == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5}
    model = Q.train(docs, labels)
    got = Q.document_quality(docs, model).collect()
    assert len(got) == 1400 and len({(r.doc_id, r.score) for r in got}) == 900
    truth = {r[0]: r[4] for r in rows}
    tested = {r.doc_id: r for r in got if r.held_out}
    assert set(tested) == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == truth[i] for i, r in tested.items()) >= 0.97 * len(tested)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    mixed = spark.createDataFrame([(1, rows[0][1] + "\n" + " ".join(["xx###"] * 20) + "\n" + "\n".join(["Nice words go here in a row."] * 2), 0.0, 0, 0)], SCHEMA)
    lines = {r.line: r for r in Q.line_labels(mixed, model).collect()}
    n = rows[0][1].count("\n") + 1
    assert lines[n + 1].probability < min(lines[n + 2].probability, lines[n + 3].probability)


def test_odd_texts_and_tables(spark):
    rows = corpus(300)
    docs = spark.createDataFrame(rows, SCHEMA)
    model = Q.train(docs, spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, quality int"))
    odd = [(1, None), (2, ""), (3, "\n\n"), (None, "x"), (4, "é " * 200_000), (5, "line.\n" * 30_000), (6, "tie"), (6, "tie")]
    table = spark.createDataFrame([(i, t, 9.0, 9, 9) for i, t in odd], SCHEMA)
    got = Q.document_quality(table, model).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].score == by[2][0].score and by[6][0].score == by[6][1].score and by[5][0].n_lines == 30_001 and by[None][0].held_out
    none = spark.createDataFrame([], SCHEMA)
    assert Q.document_quality(none, model).collect() == []
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.train(docs, no_labels) == {"constant": 0.5} and Q.train(none, no_labels) == {"constant": 0.5}
    assert {r.score for r in Q.document_quality(table, {"constant": 0.5}).collect()} == {0.5}
    assert Q.train(docs, spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")) == {"constant": 1.0}
