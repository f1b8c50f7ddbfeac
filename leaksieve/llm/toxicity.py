"""Cumulative-link ordinal regression over sparse text features.

Severity grades are ordered (0 clean, 1 mild, 2 severe); one weight vector is shared by all thresholds:
P(grade >= k) = sigmoid(w.x - theta_k), theta ascending. The labels say only toxic or not, so training grades a toxic text as
severe when it has more words that are over-represented in toxic texts, beyond those that a clean text of its length has by chance, than the
median toxic text: a long text isn't graded higher for its length.

The model is fitted on at most ``sample`` labelled documents, the lowest by a hash of doc_id (a documented bound), one row each however often
an id is repeated (of different texts under one id, the one with the least hash), of which
near copies are left out (rows that share a minimum hash over five-word shingles with an earlier one, so that a group of
copies doesn't teach its rare words); scoring covers every whole text. Features are the presence of words and of word beginnings of four and
five characters (inflected forms share them); one is used if it occurs in at least ``least`` texts of the sample and its log-odds against the toxic label exceed ``z``
standard errors.

Defined results: a null or empty text has no features and gets the model's base rate; without labels, or without toxic
ones, nothing is rejected; repeated rows each get a row; a null doc_id is carried through; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksieve.llm.tables import staged, text_of
from leaksieve.session import bounded_batches

_TRIM = ".,;:!?\"'()[]{}<>*_-…“”„«»¡¿"


def word_set(text: str) -> set[str]:
    """Lower-cased words without outer punctuation."""
    return {w.strip(_TRIM) for w in set(text.lower().split())} - {""}


def features(words) -> set[str]:
    """The words, and the beginnings (marked ^) of those that are longer."""
    words = set(words)
    return words.union({"^" + w[:4] for w in words if len(w) > 4}, {"^" + w[:5] for w in words if len(w) > 5})


def sketch(text: str) -> list[int]:
    """Four minimum hashes over the five-word shingles."""
    words = text.lower().split()
    shingles = {zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))}
    return [min((h * a + a) & 0xFFFFFFFF for h in shingles) for a in (1, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)]


def _texts_to_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch["text"].to_pylist()
        lists = [pa.array([sorted(word_set(t)) for t in texts], pa.list_(pa.string())), pa.array([sketch(t) for t in texts], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], *lists], names=["doc_id", "toxic", "words", "sketch"])


def labelled_sample(df: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, toxic, words and sketch of the labelled documents with the lowest hashes of doc_id: one row a document, at most ``sample`` rows."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    chosen = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = df.select(F.col("doc_id").cast("long"), text_of(df).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("mark"), "text", "toxic")).alias("r"))
    return one.select("doc_id", "r.text", "r.toxic").mapInArrow(_texts_to_words, "doc_id long, toxic int, words array<string>, sketch array<long>")


def fit_cumulative_link(rows: list[list[int]], grades: np.ndarray, width: int, levels: int, ridge: float = 0.02, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by accelerated gradient steps on the mean negative log-likelihood with a ridge."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.array([j for r in rows for j in r], np.int64)
    share = np.array([(grades >= k).mean() for k in range(1, levels)])
    share = np.clip(share, 0.5 / (len(grades) + 1), 1 - 0.5 / (len(grades) + 1))
    theta = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(levels - 1))
    params = np.concatenate([np.zeros(width), theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    first, second = np.zeros_like(params), np.zeros_like(params)
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
    for t in range(1, rounds + 1):
        w, theta = params[:width], params[width] + np.concatenate([[0], np.cumsum(np.exp(params[width + 1 :]))])
        score = np.bincount(at, w[feature], len(rows))
        above = np.hstack([np.ones((len(rows), 1)), sigmoid(score[:, None] - theta), np.zeros((len(rows), 1))])
        k = grades.astype(int)
        i = np.arange(len(rows))
        prob = np.maximum(above[i, k] - above[i, k + 1], 1e-12)
        slope = above * (1 - above)
        d_score = -(slope[i, k] - slope[i, k + 1]) / prob / len(rows)
        d_theta = np.array([np.sum(np.where(k == c, -1, np.where(k == c - 1, 1, 0)) * slope[:, c] / prob) for c in range(1, levels)]) * -1 / len(rows)
        d_gap = np.array([d_theta[c:].sum() for c in range(1, levels - 1)]) * np.exp(params[width + 1 :])
        grad = np.concatenate([np.bincount(feature, d_score[at], width) + ridge * w / len(rows), [d_theta.sum()], d_gap])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        params = params - 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return params[:width], params[width] + np.concatenate([[0], np.cumsum(np.exp(params[width + 1 :]))])


def _without_copies(sample: DataFrame) -> DataFrame:
    """The sampled rows but those that share a minimum hash with an earlier one. Ids and sketches (at most the sample) pass the driver."""
    seen: set = set()
    kept = []
    for row in sample.select("doc_id", "sketch").orderBy("doc_id", "sketch").toLocalIterator():
        marks = set(enumerate(row.sketch))
        if not marks & seen:
            kept.append((row.doc_id, row.sketch))
            seen |= marks
    ids = sample.sparkSession.createDataFrame(kept, "doc_id long, sketch array<long>")
    return sample.join(F.broadcast(ids), ["doc_id", "sketch"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array([list(features(w)) for w in batch["words"].to_pylist()], pa.list_(pa.string()))], names=["toxic", "features"])


def _selected(strong: dict[str, float]):
    """Indices of a row's selected features, how many of its words are over-represented in toxic texts, and how many words it has."""
    vocabulary = {f: i for i, f in enumerate(sorted(strong))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch["words"].to_pylist()
            hits = [sum(max((strong.get(f, 0) for f in features([w])), default=0) > 0 for w in words) for words in rows]
            indices = [sorted(vocabulary[f] for f in features(words) if f in vocabulary) for words in rows]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(indices, pa.list_(pa.int32())), pa.array(hits, pa.int32()), pa.array([len(w) for w in rows], pa.int32())], names=["doc_id", "toxic", "indices", "hits", "size"])

    return run


def train(df: DataFrame, labels: DataFrame, sample: int = 12_000, least: int = 5, z: float = 4.0) -> dict:
    """{"weights": {feature: weight}, "theta": [..]}; a model that rejects nothing where no toxic text is labelled."""
    bounded_batches(df.sparkSession)
    rows = staged(_without_copies(staged(labelled_sample(df, labels, sample))))
    toxic = (F.col("toxic") > 0).cast("int")
    n, toxic_n = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(toxic), F.lit(0))).first()
    if not toxic_n or toxic_n == n:
        return {"weights": {}, "theta": [40.0, 41.0]}
    each = rows.mapInArrow(_features, "toxic int, features array<string>").select(toxic.alias("y"), F.explode("features").alias("feature"))
    counts = each.groupBy("feature").agg(F.count(F.lit(1)).alias("d"), F.sum("y").alias("t")).where(F.col("d") >= least)
    a, c = F.col("t") + 0.5, F.col("d") - F.col("t") + 0.5
    b, e = toxic_n + 1 - a, n - toxic_n + 1 - c
    odds = counts.withColumn("odds", F.log(a * e / (b * c))).where(F.abs("odds") > z * F.sqrt(1 / a + 1 / b + 1 / c + 1 / e))
    strong = {r.feature: r.odds for r in odds.collect()}
    picked = sorted(rows.mapInArrow(_selected(strong), "doc_id long, toxic int, indices array<int>, hits int, size int").collect())
    chance = sum(r.hits for r in picked if r.toxic <= 0) / max(1, sum(r.size for r in picked if r.toxic <= 0))
    excess = np.array([r.hits - chance * r.size for r in picked])
    toxic_rows = np.array([r.toxic > 0 for r in picked])
    grades = toxic_rows.astype(int) + (toxic_rows & (excess > np.median(excess[toxic_rows])))
    weights, theta = fit_cumulative_link([r.indices for r in picked], grades, len(strong), 3)
    return {"weights": {w: float(weights[i]) for i, w in enumerate(sorted(strong))}, "theta": [float(x) for x in theta]}


def _score(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = json.loads(model)
        weight, theta = m["weights"], m["theta"]
        for batch in batches:
            scores = []
            for text in batch["text"].to_pylist():
                found = features(word_set(text)).intersection(weight)
                scores.append(sum(map(weight.__getitem__, sorted(found))))
            above = 1 / (1 + np.exp(-np.clip(np.array(scores, float)[:, None] - theta, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.round(above.sum(axis=1), 6)), pa.array((above >= 0.5).sum(axis=1).astype(np.int32))], names=["doc_id", "expected_severity", "grade"])

    return run


def severity(df: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """doc_id, expected_severity (sum over k of P(grade >= k)), grade (the median one) and rejected."""
    bounded_batches(df.sparkSession)
    rows = df.select(F.col("doc_id").cast("long"), text_of(df).alias("text"))
    scored = rows.mapInArrow(_score(json.dumps(model)), "doc_id long, expected_severity double, grade int")
    return scored.withColumn("rejected", F.col("expected_severity") >= threshold)


def without_toxic(df: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The rows of df whose expected severity stays below the threshold, all columns kept."""
    bounded_batches(df.sparkSession)
    m = json.dumps(model)

    @F.arrow_udf("double")
    def expected(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), texts], names=["doc_id", "text"])
        return next(_score(m)(iter([batch])))["expected_severity"]

    return df.where(expected(text_of(df)) < threshold)
