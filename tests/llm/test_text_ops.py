"""Quality rules, token counts, toxicity and preference formatting against brute force, with odd inputs."""

import math
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from leaksieve.llm import preference_format, quality_mcd, token_counts, toxicity
from leaksieve.llm.tables import tokenizer_path

ODD = [None, "", " \n\t", "one", "a\x00b   c", "é" * 300, "日本語 テキスト ΑΣ ΑΣ. İx ǅ", "x" * 200_000, "<|startoftext|>hi<|endoftext|>", "dup\ndup\ndup", "it's we'll 'S  's", "é ﬁ Ⅷ ½ ٣"]


def frame(spark, texts, **more):
    rows = [(i, t, "en", "s", 0, "clash", 5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, block int").repartition(3)


def test_base_statistics_by_definition():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["a ", "b ", "é ", "\n", "a b a b ", "#", " ", "c|d ", "\x1c"]) for _ in range(rng.randrange(30)))
        words = re.findall("[^\x20\x09-\x0d]+", text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        lines, seen, dup = text.split("\n"), set(), 0
        for x in lines:
            if re.search("[^\x20\x09-\x0d]", x):
                dup += x in seen
                seen.add(x)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))
        assert quality_mcd.base_statistics(text.encode(), len(text)) == want


def test_outliers_leave_and_clean_texts_stay(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeiounrst") for _ in range(rng.randrange(2, 9)))
    clean = [" ".join(word() for _ in range(rng.randrange(60, 400))) + "." for _ in range(300)]
    junk = [" ".join(word().upper() + "$$$###" for _ in range(100)) for _ in range(8)]
    got = {r.doc_id: r for r in quality_mcd.mcd_quality(frame(spark, clean + junk + ODD)).collect()}
    assert len(got) == len(clean) + len(junk) + len(ODD)
    assert all(got[i].kept for i in range(300)) and not any(got[i].kept for i in range(300, 308))
    assert all(got[i].base_failed and not got[i].kept for i in range(308, 308 + len(ODD)))


def test_concentration_matches_numpy():
    rng = np.random.default_rng(3)
    assert abs(quality_mcd.chi2_quantile(0.975, 5) - 12.8325) < 1e-3 and abs(quality_mcd.chi2_below(12.8325, 5) - 0.975) < 1e-5
    x = rng.normal(size=(50, quality_mcd.P))
    import pandas as pd

    rows = pd.DataFrame({"n": [50], **{f"s_x{i}": [x[:, i].sum()] for i in range(quality_mcd.P)}, **{f"s{i}_{j}": [(x[:, i] * x[:, j]).sum()] for i, j in quality_mcd._PAIRS}})
    n, mean, cov = quality_mcd._moments(rows)
    assert n == 50 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T, bias=True))


def test_empty_tables(spark):
    empty = frame(spark, ["x"]).where("false")
    assert quality_mcd.mcd_quality(empty).count() == 0
    assert token_counts.token_counts(empty).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(empty, labels)["weights"] == {}
    none = spark.createDataFrame([], "pair_id long, turn long, role string, text string")
    assert preference_format.preference_pairs(none, none).count() == 0


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = [*ODD, *ODD[3:6]]
    df = frame(spark, texts).unionByName(frame(spark, ["null id"]).withColumn("doc_id", F.lit(None).cast("long")))
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False)), n > 2048) for i, t in [*enumerate(texts), (None, "null id")]]
    assert got == sorted(want, key=str)


def test_quick_pretokens_agree_over_their_characters():
    cut = token_counts.PreTokens(tokenizer_path("word_bpe_49k.json"))
    for c in map(chr, range(0x250)):
        text = f"a{c}b {c}1{c}'s {c}{c} x"
        if not cut._unusual.search(text):
            normal = cut.tokenizer.normalizer.normalize_str(text)
            assert cut._find(text.lower()) == [w for w, _ in cut._split.pre_tokenize_str(normal)], (hex(ord(c)), unicodedata.name(c, ""))


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    bad = ["vilezz", "uglyqq", "nastyxx"]

    def text(toxic):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(8, 60))]
        for _ in range(toxic * rng.randrange(1, 4)):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", ".", ","]))
        return " ".join(words)

    truth = [int(rng.random() < 0.2) for _ in range(1200)]
    df = frame(spark, [text(t) for t in truth] + ODD)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(truth[:800])] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, labels)
    assert model["theta"][0] < model["theta"][1]
    got = {r.doc_id: r for r in toxicity.severity(df, model).collect()}
    assert all(got[i].rejected == bool(truth[i]) for i in range(800, 1200))
    assert not any(got[i].rejected for i in range(1200, 1200 + len(ODD)))
    assert all(0 <= r.expected_severity <= 2 and r.grade in (0, 1, 2) for r in got.values())
    kept = {r.doc_id for r in toxicity.without_toxic(df, model).collect()}
    assert kept == {i for i, r in got.items() if not r.rejected}


def test_severity_equals_a_plain_sum_over_the_words(spark):
    """Scores from the model's own weights, word by word, and the bound on the sample where ids repeat."""
    rng = random.Random(14)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(150)]
    truth = [int(rng.random() < 0.3) for _ in range(500)]
    texts = [" ".join(rng.choice(vocabulary).title() + rng.choice(["", ".", "!"]) for _ in range(rng.randrange(5, 400))) + (" vilezzes uglyqq," * rng.randrange(1, 3) if t else "") for t in truth]
    df = frame(spark, texts + ODD)
    labels = spark.createDataFrame(list(enumerate(truth)), "doc_id long, toxic int")
    repeated = df.unionByName(df.where("doc_id = 7").crossJoin(spark.range(500)).drop("id")).unionByName(df.where("doc_id = 8").withColumn("text", F.lit("another text")))
    sample = toxicity.labelled_sample(repeated, labels.unionByName(labels.where("doc_id = 7")), 100)
    assert sample.count() == 100 and sample.select("doc_id").distinct().count() == 100
    assert toxicity.labelled_sample(repeated, labels, 10_000).count() == 500
    model = toxicity.train(repeated, labels)
    trim = ".,;:!?\"'()[]{}<>*_-…“”„«»¡¿"
    for r in toxicity.severity(repeated, model).collect():
        text = (texts + ODD)[r.doc_id] or ""
        if r.doc_id == 8:
            continue
        words = {w.strip(trim) for w in text.lower().split()} - {""}
        marks = words | {"^" + w[:4] for w in words if len(w) > 4} | {"^" + w[:5] for w in words if len(w) > 5}
        score = sum(model["weights"].get(m, 0.0) for m in marks)
        above = [1 / (1 + math.exp(t - score)) for t in model["theta"]]
        assert r.expected_severity == pytest.approx(sum(above), abs=2e-6) and r.rejected == (r.expected_severity >= 0.5)
        assert r.grade == sum(a >= 0.5 for a in above)


def test_grades_do_not_follow_length(spark):
    """Toxic texts with one word each, of which half are fifty times as long: the long ones are not graded as severe for that."""
    rng = random.Random(15)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    rows = [(int(k % 4 == 0), rng.choice([30, 1500])) for k in range(600)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(n)) + (" vilezz" + " uglyqq nastyxx" * (k % 8 == 0) if toxic else "") for k, (toxic, n) in enumerate(rows)]
    df = frame(spark, texts)
    model = toxicity.train(df, spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, toxic int"))
    got = {r.doc_id: r.expected_severity for r in toxicity.severity(df, model).collect()}
    mean = lambda some: sum(got[k] for k in some) / len(some)
    toxic = [k for k, (t, _) in enumerate(rows) if t]
    for many in (True, False):
        short, long = ([k for k in toxic if (k % 8 == 0) is many and rows[k][1] == n] for n in (30, 1500))
        assert abs(mean(short) - mean(long)) < 0.25
    assert mean([k for k in toxic if k % 8 == 0]) > mean([k for k in toxic if k % 8]) + 0.3


def test_cumulative_link_gradient_reaches_a_minimum():
    rng = np.random.default_rng(5)
    rows = [[j for j in range(4) if rng.random() < 0.5] for _ in range(300)]
    grades = np.clip([len(r) - 1 + int(rng.random() < 0.2) for r in rows], 0, 2)
    w, theta = toxicity.fit_cumulative_link(rows, grades, 4, 3, rounds=1500)

    def loss(w, theta):
        score = np.array([sum(w[j] for j in r) for r in rows])
        above = np.hstack([np.ones((300, 1)), 1 / (1 + np.exp(-(score[:, None] - theta))), np.zeros((300, 1))])
        i = np.arange(300)
        return -np.log(np.maximum(above[i, grades] - above[i, grades + 1], 1e-12)).mean() + 0.01 * (w**2).sum() / 300

    best = loss(w, theta)
    for k in range(4):
        for e in (-0.05, 0.05):
            moved = w.copy()
            moved[k] += e
            assert loss(moved, theta) > best - 1e-6


def test_preference_pairs(spark):
    schema = "pair_id long, turn long, role string, text string, prompt string"
    chosen = [(1, 0, "user", "hi", "x"), (1, 2, "assistant", "good", "x"), (1, 2, "assistant", "zzz", "x"), (2, 0, None, None, "x"), (3, 0, "user", "only chosen", "x"), (4, 0, "user", "same", "x")]
    rejected = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", "bad é", "x"), (1, 5, "user", "why", "x"), (2, 0, "user", None, "x"), (4, 0, "user", "same", "x")]
    got = {r.pair_id: r for r in preference_format.preference_pairs(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema)).collect()}
    assert set(got) == {1, 2, 4}
    one = got[1]
    assert one.n_common_turns == 1 and one.prompt == "<|user|>\nhi<|end|>\n" and one.chosen == "<|assistant|>\ngood<|end|>\n"
    assert [one.rejected[s.start : s.end] for s in one.rejected_spans] == ["bad é<|end|>\n"]
    assert got[2].n_common_turns == 0 and got[2].chosen == "<|unknown|>\n<|end|>\n" and got[2].chosen_spans == []
    assert got[4].n_common_turns == 1 and got[4].chosen == got[4].rejected == ""


def test_branched_pairs_lose_no_conversation(spark):
    rows = []
    for c in [*range(40), 10**6, 10**9]:  # the last two are alone among their neighbours
        for k in range(c % 5 + 1):
            rows += [(c, 10 * k, "user", f"ask {c} {k}"), (c, 10 * k + 5, "assistant", f"answer {c} {k} é")]
    rows += [(50, 0, "user", "never answered"), (None, 0, "assistant", "no id"), (3, 5, "assistant", "answer 3 0 é"), (60, 0, "assistant", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    pairs = {r.pair_id: r for r in preference_format.formatted(preference_format.branched(turns)).collect()}
    assert set(pairs) == {*range(40), 10**6, 10**9, 60}
    prefixes = {c: r.n_common_turns for c, r in pairs.items()}
    assert len({(c % 5, n) for c, n in prefixes.items() if c < 40}) > 9  # prefixes of several lengths
    for c, r in pairs.items():
        assert all(r.rejected[s.start : s.end].endswith("<|end|>\n") for s in r.rejected_spans)
        if c < 40:
            other = c + 1 if c < 39 else 60
            last = f"answer {other} {other % 5} é" if other < 60 else ""
            assert r.rejected == f"<|assistant|>\n{last}<|end|>\n" and f"answer {c} {c % 5} é" in r.prompt + r.chosen
    assert pairs[10**6].rejected == "<|assistant|>\nanswer <|end|>\n" or pairs[10**6].rejected.startswith("<|assistant|>\nanswer")
    assert preference_format.branched(turns.where("false")).count() == 0
