"""Every stage of the pipeline against brute force on what its predecessor kept: nulls, empty and long texts, repeated rows, copies, ties."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leaksieve.llm import toxicity
from leaksieve.llm.tables import staged, tokenizer_path
from tests.llm.test_line_edit_join import classes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TRIM = ".,;:!?\"'()[]{}<>*_-…“”„«»¡¿"


def corpus():
    rng = random.Random(23)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(300)]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(8, 16))) + "."
    text = lambda: "\n".join(line() for _ in range(rng.randrange(4, 9)))
    texts = [text() for _ in range(120)]
    toxic = {i for i in range(120) if i % 6 == 0}
    texts = [t + "\nwhat a vilezz uglyqq nastyxx thing." if i in toxic else t for i, t in enumerate(texts)]
    common = "this very line is common to a lot of documents here."
    texts = [t + "\n" + common.replace("very", f"ver{'xyz'[i % 3]}") if i % 5 == 1 else t for i, t in enumerate(texts)]
    copies = [texts[i] for i in (1, 1, 2, 3)] + [texts[i].replace(texts[i].split()[9], "changed", 1) for i in (4, 5, 7, 8)]
    odd = [None, "", " \n\t", "one", "é" * 300, "long word " * 20_000, "tie", "tie", "Licensed under a license", "a@b.c | d | e", None]
    every = texts + copies + odd
    langs, sources = ["en", "de", None], ["s1", "s1", "s2", None]
    rows = [(i, t, langs[i % 3], sources[i % 4], len(t or "")) for i, t in enumerate(every)]
    rows += [rows[9], rows[9], (None, texts[10], "en", "s1", 5), (None, None, None, None, None), (11, "another text under one id", "en", "s2", 3)]
    return rows, toxic


def key(r):
    return tuple((v is not None, v if v is not None else 0 if isinstance(v, int) else "") for v in r)


def rows_of(df):
    return collections.Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """name -> (input, output) of every stage."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, toxic = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        done = staged(stage(spark, docs, folder))
        out[name] = (docs, done)
        docs = done
    return out, folder, toxic


def test_order_and_columns(stages):
    out, _, _ = stages
    assert list(out) == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    assert all(done.columns == docs.columns for name, (docs, done) in out.items() if name != "packing")
    assert all(0 < done.count() <= docs.count() for name, (docs, done) in out.items() if name != "packing")


def test_toxicity(spark, stages):
    out, folder, toxic = stages
    docs, done = out["toxicity"]
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = collections.Counter()
    for r in docs.collect():
        words = {w.strip(TRIM) for w in (r.text or "").lower().split()} - {""}
        marks = words | {"^" + w[:4] for w in words if len(w) > 4} | {"^" + w[:5] for w in words if len(w) > 5}
        score = sum(model["weights"].get(m, 0.0) for m in marks)
        if sum(1 / (1 + math.exp(t - score)) for t in model["theta"]) < 0.5:
            kept[(r.doc_id, r.text, r.lang, r.source, r.n_chars)] += 1
    assert rows_of(done) == kept
    ids = {r[0] for r in kept}
    assert not ids & toxic and {i for i in range(120) if i not in toxic} <= ids


def test_line_dedup(stages):
    docs, done = stages[0]["line_dedup"]
    have = [r for r in docs.collect()]
    distinct = sorted({(r.doc_id, r.text or "") for r in have if r.doc_id is not None})
    every = [(i, t, k, x.strip(" \t\r")) for i, t in distinct for k, x in enumerate(t.split("\n")) if x.strip(" \t\r")]
    short = [x for *_, x in every if len(x) < 5_000]
    label = classes(short) | {x: x for *_, x in every if len(x) >= 5_000}
    groups = collections.defaultdict(set)
    for i, t, k, x in every:
        groups[label[x]].add((i, k, t))
    by_id = collections.Counter(i for i, _ in distinct)
    want = collections.Counter()
    for r in have:
        lines = (r.text or "").split("\n")
        gone = set()
        for k, x in enumerate(lines):
            x = x.strip(" \t\r")
            if r.doc_id is None or len(x) < 10:
                continue
            place = min((i, j) for i, j, _ in groups[label[x]])
            if place != (r.doc_id, k) or (by_id[r.doc_id] > 1 and min(groups[label[x]])[2] != (r.text or "")):
                gone.add(k)
        text = r.text if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        want[(r.doc_id, text, r.lang, r.source)] += 1
    got = collections.Counter((r.doc_id, r.text, r.lang, r.source) for r in done.collect())
    two = {i for i, n in by_id.items() if n > 1}  # which text of an id comes first is the operator's own choice
    drop = lambda c: {k: v for k, v in c.items() if k[0] not in two}
    assert drop(got) == drop(want) and sum(got.values()) == sum(want.values())
    assert sum(v for k, v in got.items()) == docs.count()


def bag(text):
    words = (text or "").lower().split()
    if not words:
        return collections.Counter()
    n = min(5, len(words))
    return collections.Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def test_near_dedup(stages):
    docs, done = stages[0]["near_dedup"]
    have = docs.collect()
    texts = {}
    for r in have:
        if r.doc_id is not None:
            texts.setdefault(" ".join((r.text or "").lower().split()), []).append(r.doc_id)
    names = sorted(texts)
    bags = [bag(t) for t in names]
    sizes = [sum(b.values()) for b in bags]
    label = list(range(len(names)))
    for i, j in itertools.combinations(range(len(names)), 2):
        if 0.8 * max(sizes[i], sizes[j]) <= min(sizes[i], sizes[j]):
            shared = sum((bags[i] & bags[j]).values())
            if shared >= 0.8 * (sizes[i] + sizes[j] - shared) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if v == old else v for v in label]
    groups = collections.defaultdict(set)
    for t, v in zip(names, label, strict=True):
        groups[v] |= {(i, t) for i in texts[t]}
    stay = {min(g)[0] for g in groups.values()}
    got = done.collect()
    assert {r.doc_id for r in got if r.doc_id is not None} == stay and len(groups) < len(names) + 1
    assert sum(r.doc_id is None for r in got) == sum(r.doc_id is None for r in have)
    assert not rows_of(done) - rows_of(docs)


def test_mixing(stages):
    docs, done = stages[0]["mixing"]
    have = docs.collect()
    cell = lambda r: (r.source or "?", r.lang or "?", "licensed" if "icensed under" in (r.text or "") else "contact" if "@" in (r.text or "") else "tabular" if " | " in (r.text or "") else "prose")
    tokens = collections.Counter()
    for r in have:
        tokens[cell(r)] += len(re.findall("[^ \t\n\x0b\f\r]+", r.text or ""))
    names = [sorted({c[k] for c in tokens}) for k in range(3)]
    w = np.zeros([len(n) for n in names])
    for c, n in tokens.items():
        w[tuple(names[k].index(c[k]) for k in range(3))] = n
    start = w.copy()
    w /= w.sum()
    goals = []
    for k in range(3):
        share = start.sum(axis=tuple(j for j in range(3) if j != k)) ** 0.95
        goals.append(share / share.sum())
    for _ in range(500):
        for k in range(3):
            now = w.sum(axis=tuple(j for j in range(3) if j != k))
            w = w * np.divide(goals[k], now, out=np.zeros_like(now), where=now > 0).reshape([-1 if j == k else 1 for j in range(3)])
    ratio = np.where(start > 0, w * start.sum() / np.maximum(start, 1), 1.0)
    want = collections.Counter()
    for r in have:
        chance = ratio[tuple(names[k].index(cell(r)[k]) for k in range(3))] / ratio.max()
        drawn = int(hashlib.md5(f"{'null' if r.doc_id is None else r.doc_id}:17".encode()).hexdigest()[:13], 16) / 2**52
        assert abs(drawn - chance) > 1e-6
        if drawn < chance:
            want[(r.doc_id, r.text, r.lang, r.source, r.n_chars)] += 1
    assert rows_of(done) == want


def test_packing(stages):
    from tokenizers import Tokenizer

    docs, done = stages[0]["packing"]
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    pieces = collections.Counter()
    total = 0
    for r in docs.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        if len(ids) <= 2048:
            pieces[(r.doc_id, 0, 0, len(ids), zlib.crc32(ids.tobytes()))] += 1
    rows = done.collect()
    whole = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert not pieces - whole and sum(r.length for r in rows) == total
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    for some in by_sequence.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) <= -(-total // 2048) + 2


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_pass_through(spark, tmp_path):
    rows, _ = corpus()
    docs = spark.createDataFrame([(*r, "a", "b", 1.0, 2) for r in rows[:40]], SCHEMA + ", row string, cell string, chance double, gone_id int")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, str(tmp_path)))
        assert docs.columns[-4:] == ["row", "cell", "chance", "gone_id"] and docs.where(F.col("row") != "a").count() == 0
