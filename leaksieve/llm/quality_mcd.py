"""Robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Each text gives a vector of transformed statistics. Rows that pass the base rules are grouped by language and source
(groups below ``least`` rows join their language's pool, and pools below it one common pool). Each group's location and
scatter come from concentration steps started from two deterministic estimates (median with interquartile scales, and
the spatial sign covariance); a step keeps the (n + p + 1) / 2 rows with the smallest distances, counted exactly from
logarithmic distance bins; of the bin that crosses that number the missing part counts. The start with the smaller determinant wins,
is made consistent for normal data, reweighted once, and rows beyond the cutoff distance are rejected.

A step is one aggregation of sums by (group, start, bin): partial sums before the shuffle, so a hot group costs no more
than its bins. Scales have a floor per statistic, since most texts share one value of some statistics.

Defined results: a null text has no words and fails the base rules; null language or source is a group of its own;
repeated rows each count and each get a row; a null doc_id is carried through; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.llm.tables import staged, text_of

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_capitals", "n_marks")
#: Transformed statistics and the least scale of each: log words, log mean word length, and square roots of the shares
#: of symbols, repeated lines, repeated words, ASCII capitals and punctuation marks. At the floor, each share's range end is
#: beyond the cutoff by itself; repeated words end at a half, where the base rules begin.
SCALES = {"log_words": 0.5, "log_word_chars": 0.12, "symbols": 0.04, "dup_lines": 0.12, "repeats": 0.1, "capitals": 0.1, "marks": 0.1}
P = len(SCALES)
_CAPITALS, _MARKS = bytes(range(65, 91)), b"!?.,;:\"'()"
_SPACE = b"\x20\t\n\x0b\x0c\r"


def base_statistics(data: bytes, n_chars: int) -> tuple[int, int, int, int, int]:
    """The five counts of one UTF-8 text."""
    words = data.split()  # bytes split at just these six
    n = len(words)
    lines = data.split(b"\n")
    dup = 0
    if len(lines) > 1:
        full = [x for x in lines if x.strip(_SPACE)]
        dup = len(full) - len(set(full))
    repeats = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        seen = Counter(windows)
        if len(seen) < len(windows):
            covered = bytearray(n)
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    covered[i] = covered[i + 1] = covered[i + 2] = 1
            repeats = sum(covered)
    return n, n_chars - _count(data, _SPACE), _count(data, b"#*$%&|<>"), dup, repeats


def _count(data: bytes, which: bytes) -> int:
    return len(data) - len(data.translate(None, which))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, chars = batch["text"].cast(pa.binary()).to_pylist(), batch["chars"].to_pylist()
        more = [(t.count(b"\n") + 1, _count(t, _CAPITALS), _count(t, _MARKS)) for t in texts]
        found = [(*base_statistics(t, c), *m) for t, c, m in zip(texts, chars, more, strict=True)]
        columns = [pa.array([x[i] for x in found], pa.int64()) for i in range(len(BASE) + len(MORE))]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["lang"], batch["source"], *columns], names=["doc_id", "lang", "source", *BASE, *MORE])


def statistics(df: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts, further counts and base_failed."""
    text = text_of(df)
    rows = df.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), text.alias("text"), F.length(text).cast("long").alias("chars"))
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in (*BASE, *MORE))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.mapInArrow(_statistics, schema).withColumn("base_failed", failed)


def _vector() -> list[Column]:
    words = F.greatest("n_words", F.lit(1))
    raw = [
        F.log(words),
        F.log(F.greatest(F.col("word_chars") / words, F.lit(1))),
        F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / F.col("n_lines")),
        F.sqrt(F.col("n_repeat_words") / words),
        F.sqrt(F.col("n_capitals") / F.greatest("word_chars", F.lit(1))),
        F.sqrt(F.col("n_marks") / F.greatest("word_chars", F.lit(1))),
    ]
    return [x / scale for x, scale in zip(raw, SCALES.values(), strict=True)]


def chi2_quantile(q: float, k: int) -> float:
    """By bisection over the regularised lower incomplete gamma series."""

    def below(x: float) -> float:
        a, z = k / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= z / n
            total += term
        return total * math.exp(a * math.log(z) - z - math.lgamma(a))

    lo, hi = 1e-9, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < q else (lo, mid)
    return lo


def chi2_below(x: float, k: int) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_quantile(mid, k) < x else (lo, mid)
    return lo


#: A determinant's logarithm that moves by less is still.
STILL = 1e-3
_MODEL = "grp string, start int, mean array<double>, inv array<double>, logdet double, rows long"
_X = [f"x{i}" for i in range(P)]
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _model(grp: str, start: int, mean: np.ndarray, cov: np.ndarray, rows: int) -> dict:
    """Scales are in units of their floors: a variance below 1 counts as 1, correlations stay."""
    cov = cov + np.diag(np.maximum(0, 1 - np.diag(cov)))
    return {"grp": grp, "start": start, "mean": mean, "inv": np.linalg.inv(cov).ravel(), "logdet": float(np.linalg.slogdet(cov)[1]), "rows": round(rows)}


def _distance() -> Column:
    d = [F.col(x) - F.col("mean")[i] for i, x in enumerate(_X)]
    return reduce(lambda a, b: a + b, ((1 if i == j else 2) * d[i] * d[j] * F.col("inv")[i * P + j] for i, j in _PAIRS))


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(f"s_{x}") for x in _X), *(F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"s{i}_{j}") for i, j in _PAIRS)]


def _moments(rows: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    n = float(rows["n"].sum())
    mean = rows[[f"s_{x}" for x in _X]].sum().to_numpy() / n
    cov = np.zeros((P, P))
    for i, j in _PAIRS:
        cov[i, j] = cov[j, i] = rows[f"s{i}_{j}"].sum() / n - mean[i] * mean[j]
    return n, mean, cov


def _concentrate(half: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin", ignore_index=True)
        total = rows["n"].sum()
        wanted = max(math.ceil(half * total), (total + P + 1) // 2)
        # the bin that crosses the subset's size counts by the part that still belongs to it
        part = ((wanted - (rows["n"].cumsum() - rows["n"])) / rows["n"]).clip(0, 1)
        sums = [c for c in rows.columns if c == "n" or c.startswith("s_") or re.fullmatch(r"s\d+_\d+", c)]
        kept = rows.assign(**{c: rows[c] * part for c in sums})
        n, mean, cov = _moments(kept)
        return pd.DataFrame([_model(rows["grp"].iloc[0], int(rows["start"].iloc[0]), mean, cov, n)])

    return run


def _reweighted(half: float):
    """The moments of the rows within the 97.5 % distance, made consistent for normal data."""
    shrink = 0.975 / chi2_below(chi2_quantile(0.975, P), P + 2)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n, mean, cov = _moments(rows)
        return pd.DataFrame([_model(rows["grp"].iloc[0], int(rows["start"].iloc[0]), mean, cov * shrink, n)])

    return run


def _start(rows: pd.DataFrame) -> pd.DataFrame:
    """Median and interquartile scale per statistic from its grid counts (a grid cell is 1/16 of the least scale)."""
    mean, scale = np.zeros(P), np.ones(P)
    for axis, cells in rows.groupby("axis"):
        cells = cells.sort_values("cell")
        share = cells["n"].cumsum() / cells["n"].sum()
        q = [cells["cell"].to_numpy()[int(np.searchsorted(share, p))] / 16 for p in (0.25, 0.5, 0.75)]
        mean[axis], scale[axis] = q[1], max(1.0, (q[2] - q[0]) / 1.349)
    return pd.DataFrame([_model(rows["grp"].iloc[0], 0, mean, np.diag(scale**2), int(rows["n"].sum() // P))])


def _sign_start(rows: pd.DataFrame) -> pd.DataFrame:
    """The spatial sign scatter about the median, brought back to the interquartile scales."""
    n, _, cov = _moments(rows)
    first = rows.iloc[0]
    scale = 1 / np.sqrt(np.diag(np.array(first["inv"]).reshape(P, P)))
    s = np.array([[rows[f"s{min(i, j)}_{max(i, j)}"].sum() / n for j in range(P)] for i in range(P)])
    root = np.sqrt(np.maximum(np.diag(s), 1e-12))
    corr = s / np.outer(root, root) + 1e-6 * np.eye(P)
    return pd.DataFrame([_model(first["grp"], 1, np.array(first["mean"]), corr * np.outer(scale, scale), n)])


def mcd_models(rows: DataFrame, half: float = 0.5, steps: int = 30) -> DataFrame:
    """grp, mean, inv, logdet: one model for each group of rows (grp, x0..). Steps end when no group's determinant moves any more."""
    cells = rows.select("grp", F.posexplode(F.array(*(F.floor(F.col(x) * 16) for x in _X))).alias("axis", "cell"))
    first = staged(cells.groupBy("grp", "axis", "cell").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").applyInPandas(_start, _MODEL))
    unit = rows.join(first, "grp")
    z = [(F.col(x) - F.col("mean")[i]) * F.sqrt(F.col("inv")[i * P + i]) for i, x in enumerate(_X)]
    norm = F.greatest(F.sqrt(reduce(lambda a, b: a + b, (c * c for c in z))), F.lit(1e-9))
    signs = unit.select("grp", "mean", "inv", *((c / norm).alias(x) for c, x in zip(z, _X, strict=True)))
    second = signs.groupBy("grp").agg(F.first("mean").alias("mean"), F.first("inv").alias("inv"), *_sums()).groupBy("grp").applyInPandas(_sign_start, _MODEL)
    models = staged(first.unionByName(second))
    for _ in range(steps):
        binned = rows.join(models, "grp").select("grp", "start", *_X, F.floor(16 * F.log2(_distance() + 1e-6)).alias("bin"))
        stepped = staged(binned.groupBy("grp", "start", "bin").agg(*_sums()).groupBy("grp", "start").applyInPandas(_concentrate(half), _MODEL))
        before = models.select("grp", "start", F.col("logdet").alias("was"))
        most = stepped.join(before, ["grp", "start"]).agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
        models = stepped
        if most is None or most < STILL:
            break
    best = models.groupBy("grp").agg(F.min_by(F.struct("start", "mean", "inv", "logdet", "rows"), F.struct("logdet", "start")).alias("m")).select("grp", "m.*")
    factor = half / chi2_below(chi2_quantile(half, P), P + 2)
    inner = rows.join(best, "grp").where(_distance() / F.lit(factor) <= chi2_quantile(0.975, P))
    return staged(inner.groupBy("grp", "start").agg(*_sums()).groupBy("grp", "start").applyInPandas(_reweighted(half), _MODEL))


def mcd_quality(df: DataFrame, least: int = 200, tail: float = 1e-6, half: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the squared distance (null where the base rules failed).

    kept is false for texts that fail the base rules and for those whose squared distance from their group's estimate
    exceeds the chi-square quantile that leaves the tail.
    """
    stats = staged(statistics(df))
    passed = stats.where(~F.col("base_failed"))
    lang, source = F.coalesce("lang", F.lit("?")), F.coalesce("source", F.lit("?"))
    named = lambda *parts: F.concat_ws("\x1f", *parts)
    counts = passed.groupBy(lang.alias("g_lang"), source.alias("g_source")).agg(F.count(F.lit(1)).alias("n"))
    by_lang = counts.where(F.col("n") < least).groupBy("g_lang").agg(F.sum("n").alias("pool"))
    grp = F.when(F.col("n") >= least, named("g_lang", "g_source")).when(F.col("pool") >= least, named("g_lang", F.lit("*"))).otherwise(F.lit("*"))
    names = counts.join(by_lang, "g_lang", "left").select("g_lang", "g_source", grp.alias("grp"))
    keyed = stats.withColumns({"g_lang": lang, "g_source": source, **dict(zip(_X, _vector(), strict=True))}).join(names, ["g_lang", "g_source"], "left")
    rows = staged(keyed.select("doc_id", *BASE, "base_failed", "grp", *_X))
    models = mcd_models(rows.where(~F.col("base_failed")).select("grp", *_X), half)
    d2 = F.when(~F.col("base_failed"), _distance())
    kept = ~F.col("base_failed") & F.coalesce(d2 <= chi2_quantile(1 - tail, P), F.lit(True))
    return rows.join(models.select("grp", "mean", "inv"), "grp", "left").select("doc_id", *BASE, "base_failed", kept.alias("kept"), d2.alias("distance"))
