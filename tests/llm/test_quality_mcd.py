"""Outliers that must not hide: repeated lines and passages, and a third of a group bad in the same way."""

import random

import numpy as np

from leaksieve.llm import quality_mcd


def judged(spark, texts):
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    return {r.doc_id: r for r in quality_mcd.mcd_quality(df).collect()}


def clean_texts(rng, n):
    word = lambda: "".join(rng.choice("aeiounrst") for _ in range(rng.randrange(2, 9)))
    return word, ["\n".join(" ".join(word() for _ in range(rng.randrange(5, 12))) + "." for _ in range(rng.randrange(12, 40))) for _ in range(n)]


def test_range_ends_are_beyond_the_cutoff():
    cutoff = quality_mcd.chi2_quantile(1 - 1e-6, quality_mcd.P)
    ends = {"symbols": 1, "dup_lines": 1, "repeats": 0.5, "capitals": 1, "marks": 1}
    assert all(end / quality_mcd.SCALES[name] ** 2 > cutoff for name, end in ends.items())


def test_repeated_lines_and_passages_are_rejected(spark):
    rng = random.Random(21)
    word, clean = clean_texts(rng, 300)
    # two-word lines, repeated: windows of three words differ, as each line's neighbours do
    short = [f"{word()} {word()}" for _ in range(3)]
    lines = []
    for _ in range(8):
        fresh = [" ".join(word() for _ in range(9)) + "." for _ in range(12)]
        lines.append("\n".join(x for k in range(60) for x in (short[k % 3], *([fresh[k // 5]] if k % 5 == 0 else [f"{word()}"] if k % 17 == 0 else []))))
    passages = []
    for _ in range(8):
        passage = " ".join(word() for _ in range(48))
        passages.append("\n".join([passage, " ".join(word() for _ in range(104)) + ".", passage]))
    got = judged(spark, clean + lines + passages)
    assert all(got[i].kept for i in range(300))
    assert not any(got[i].kept for i in range(300, 316))
    assert not any(got[i].base_failed for i in range(308, 316))


def test_a_third_of_a_group_is_rejected(spark):
    rng = random.Random(22)
    word, clean = clean_texts(rng, 400)
    bad = [" ".join(rng.choice([word().upper(), "##" + word()]) for _ in range(rng.randrange(80, 300))) for _ in range(200)]
    got = judged(spark, clean + bad)
    assert sum(got[i].kept for i in range(400)) >= 396
    assert not any(got[i].kept for i in range(400, 600))


def brute_force(x, starts=200):
    """Squared distances of the rows of x by concentration steps from random starts, with the floors of the operator."""
    rng = np.random.default_rng(3)
    n, p = x.shape
    h = (n + p + 1) // 2
    floored = lambda c: c + np.diag(np.maximum(0, 1 - np.diag(c)))
    distance = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    best = None
    for _ in range(starts):
        rows = rng.choice(n, 4 * p, replace=False)
        for _ in range(50):
            m, c = x[rows].mean(0), floored(np.cov(x[rows].T, bias=True))
            now = np.argsort(distance(m, c), kind="stable")[:h]
            if set(now) == set(rows):
                break
            rows = now
        m, c = x[rows].mean(0), floored(np.cov(x[rows].T, bias=True))
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = np.linalg.slogdet(c)[1], m, c
    chi, below = quality_mcd.chi2_quantile, quality_mcd.chi2_below
    good = x[distance(best[1], best[2] * 0.5 / below(chi(0.5, p), p + 2)) <= chi(0.975, p)]
    return distance(good.mean(0), floored(np.cov(good.T, bias=True) * 0.975 / below(chi(0.975, p), p + 2)))


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(23)
    word, clean = clean_texts(rng, 260)
    bad = [" ".join(rng.choice([word().upper(), "##" + word()]) for _ in range(rng.randrange(80, 300))) for _ in range(60)]
    rows = [(i, t, "en", "s") for i, t in enumerate(clean + bad + bad[:5])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = {r.doc_id: r for r in quality_mcd.mcd_quality(df).collect()}
    stats = quality_mcd.statistics(df)
    vectors = stats.select("doc_id", *(c.alias(f"v{i}") for i, c in enumerate(quality_mcd._vector()))).where("not base_failed").orderBy("doc_id").toPandas()
    d2 = brute_force(vectors.drop(columns="doc_id").to_numpy())
    cutoff = quality_mcd.chi2_quantile(1 - 1e-6, quality_mcd.P)
    clear = [(i, d <= cutoff) for i, d in zip(vectors["doc_id"], d2, strict=True) if abs(d / cutoff - 1) > 0.1]
    assert len(clear) > 250 and all(got[i].kept == kept for i, kept in clear)
    assert np.median([abs(got[i].distance / d - 1) for i, d in zip(vectors["doc_id"], d2, strict=True)]) < 0.15
