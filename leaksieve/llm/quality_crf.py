"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad. A line's potential comes from its own statistics and those of its neighbours (shares of
symbols, capitals, digits, marks; word lengths; repetition; place), the chain adds a weight for each pair of adjacent labels. Forward-backward
gives each line's probability of being good; their mean, weighted by line length, is the document's good share, which a
two-parameter logistic curve turns into the probability of label 1.

Labels exist for documents only, so lines are labelled in two steps: first as their document, for a line model without the
chain; then the lines of bad documents which that model holds good become good (one line, the worst, always stays bad), and the
chain is fitted to these.

The model is fitted on the driver on a bounded sample: at most ``sample`` labelled documents, those with the lowest hash of doc_id, one row
each, and of a document with more than ``stretch`` lines a run of so many that starts at a line chosen by a hash. Scoring covers every line of every
whole text. Labels, language, source and doc_id are no inputs of a score.

Defined results: a null text is empty and has one blank line; lines split at \\n; a document whose lines are all empty weighs them equally; repeated rows
each get a row; a null doc_id hashes as the empty text (held out); labels that are null teach nothing, of several for one
document the highest counts; without labels of both kinds every score is their share (0.5 without any); other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.llm.tables import text_of

_KINDS = {"symbol": b"#*$%&|<>", "shout": b"!?", "mark": b".,;:", "code": b"{}[]()=\\/_~^+@`", "digit": b"0123456789", "capital": bytes(range(65, 91)), "space": b"\x20\t\n\x0b\x0c\r"}
_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate(_KINDS.values(), 1):
    _CLASS[list(_chars)] = _i
#: A line's own statistics.
OWN = ("log_words", "blank", "symbol", "any_symbol", "shout", "mark", "code", "digit", "capital", "word_length", "repeats", "seen_before", "passages", "sentence_end")
WIDTH = 3 * len(OWN) + 3  # own, previous, next; constant, first line, last line
_PART = 4 << 20


def own_features(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistics of every line of the texts, number of lines of each text, bytes of each line)."""
    lines = [t.split(b"\n") for t in texts]
    counts = np.array([len(x) for x in lines], np.int64)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    size = np.diff(np.flatnonzero(data == 10), prepend=-1)  # with its line break
    kinds = len(_KINDS) + 1
    kind = _CLASS[data]
    line = np.repeat(np.arange(len(size)), size)
    n = np.bincount(line * kinds + kind, minlength=len(size) * kinds).reshape(-1, kinds)
    space = kind == kinds - 1
    starts = ~space
    starts[1:] &= space[:-1]
    words = np.bincount(line[starts], minlength=len(size))
    filled = np.maximum(size - n[:, kinds - 1], 1)  # bytes that aren't space
    share = {name: np.sqrt(n[:, i] / filled) for i, name in enumerate(_KINDS, 1)}
    distinct, seen, ends = np.zeros(len(size)), np.zeros(len(size)), np.zeros(len(size))
    passages = np.zeros(len(texts))
    at = 0
    for k, own in enumerate(lines):
        before: set[bytes] = set()
        words_of = []
        for x in own:
            w = x.split()
            words_of += w
            distinct[at] = len(set(w))
            if w:
                seen[at] = x in before
                before.add(x)
                ends[at] = w[-1][-1:] in b".!?"
            at += 1
        if len(words_of) > 3:
            windows = len(words_of) - 2
            passages[k] = 1 - len(set(zip(words_of, words_of[1:], words_of[2:], strict=False))) / windows
    some = np.maximum(words, 1)
    columns = [np.log1p(words) / 6, words == 0, share["symbol"], n[:, 1] > 0, share["shout"], share["mark"], share["code"], share["digit"], share["capital"], np.minimum(filled / some, 20) / 10, 1 - np.where(words > 0, distinct / some, 1), seen, np.repeat(passages, counts), ends]
    return np.stack([np.asarray(c, float) for c in columns], axis=1), counts, size - 1


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """own, previous and next line's statistics (0 beyond the text's ends), a constant, first and last line."""
    first, last = np.zeros(len(own), bool), np.zeros(len(own), bool)
    ends = np.cumsum(counts)
    first[ends - counts] = True
    last[ends - 1] = True
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1]
    after[:-1] = own[1:]
    before[first] = 0
    after[last] = 0
    return np.hstack([own, before, after, np.ones((len(own), 1)), first[:, None], last[:, None]])


def chain(scores: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(sum of log partition functions, each line's probability of good, expected label pairs) of many chains side by side.

    scores: what label good adds at each line (bad adds 0); pairs[a, b]: what label a before label b adds. Lines of one chain follow each other.
    """
    order = np.argsort(-counts, kind="stable")
    start = (np.cumsum(counts) - counts)[order]
    length = counts[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(1, steps + 1), side="right")  # chains that have a line at each step
    forward: list[np.ndarray] = []
    for t in range(steps):
        here = np.zeros((active[t], 2))
        here[:, 1] = scores[start[: active[t]] + t]
        if t:
            here += np.logaddexp(forward[-1][: active[t], :1] + pairs[0], forward[-1][: active[t], 1:] + pairs[1])
        forward.append(here)
    good = np.zeros(len(scores))
    expected, total = np.zeros((2, 2)), 0.0
    backward = np.zeros((0, 2))
    whole = np.zeros(len(length))
    for t in reversed(range(steps)):
        begun = np.zeros((active[t] - len(backward), 2))  # chains whose last line this is
        ending = forward[t][len(backward) :]
        whole[len(backward) : active[t]] = np.logaddexp(ending[:, 0], ending[:, 1])
        backward = np.vstack([backward, begun])
        z = whole[: active[t]]
        good[start[: active[t]] + t] = np.exp(forward[t][:, 1] + backward[:, 1] - z)
        if t:
            emit = backward.copy()
            emit[:, 1] += scores[start[: active[t]] + t]
            joint = forward[t - 1][: active[t], :, None] + pairs + emit[:, None, :]
            expected += np.exp(joint - z[:, None, None]).sum(axis=0)
            backward = np.logaddexp(pairs[:, 0] + emit[:, :1], pairs[:, 1] + emit[:, 1:])
    total = float(whole.sum())
    return total, np.clip(good, 0, 1), expected


def fit_chain(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, linked: bool, ridge: float = 0.1, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(weights, pair weights) by accelerated gradient steps on the negative log-likelihood with a ridge; unlinked: pairs stay 0."""
    inner = np.ones(len(labels), bool)
    inner[np.cumsum(counts) - counts] = False
    seen = np.zeros((2, 2))
    at = np.flatnonzero(inner)
    np.add.at(seen, (labels[at - 1], labels[at]), 1)
    observed = x.T @ labels
    params = np.zeros(x.shape[1] + 4)
    first, second = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, rounds + 1):
        w, pairs = params[:-4], params[-4:].reshape(2, 2)
        _, good, expected = chain(x @ w, counts, pairs)
        grad = np.concatenate([x.T @ good - observed, (expected - seen).ravel() * linked]) + ridge * params
        grad /= len(labels)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        params = params - 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return params[:-4], params[-4:].reshape(2, 2)


def good_share(good: np.ndarray, counts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mean probability of good of each text's lines, weighted by their bytes."""
    doc = np.repeat(np.arange(len(counts)), counts)
    weight = size + np.where(np.bincount(doc, size, len(counts))[doc] > 0, 0, 1)
    return np.bincount(doc, weight * good, len(counts)) / np.bincount(doc, weight, len(counts))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_curve(share: np.ndarray, labels: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of the logistic curve from the logit of a good share to label 1 (Newton steps)."""
    z = np.stack([_logit(share), np.ones(len(share))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (p - labels) + ridge * (beta - [1.0, 0.0])
        beta = beta - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), grad)
    return float(max(beta[0], 1e-3)), float(beta[1])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _stretch(text: bytes, doc_id: int, most: int) -> bytes:
    lines = text.split(b"\n")
    start = zlib.crc32(str(doc_id).encode()) % max(1, len(lines) - most + 1)
    return b"\n".join(lines[start : start + most])


def labelled_sample(df: DataFrame, labels: DataFrame, sample: int, stretch: int) -> DataFrame:
    """quality and the statistics of the lines (row by row) of at most ``sample`` labelled documents that aren't held out."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    chosen = marked.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(df).alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            for k, text in enumerate(batch["text"].cast(pa.binary()).to_pylist()):
                own, _, size = own_features([_stretch(text, ids[k], stretch)])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(k, 1), batch["quality"].slice(k, 1), pa.array([own.ravel()], pa.list_(pa.float64())), pa.array([size], pa.list_(pa.int64()))], names=["doc_id", "quality", "own", "size"])

    rows = texts.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, own array<double>, size array<long>")
    return rows.groupBy("doc_id").agg(F.min(F.struct("quality", "size", "own")).alias("r")).select("doc_id", "r.*")  # one row a document, however often it is repeated


def train(df: DataFrame, labels: DataFrame, sample: int = 4_000, stretch: int = 64) -> dict:
    """{"weights", "pairs", "curve"}, or {"constant"} where the labels aren't of both kinds."""
    rows = sorted(labelled_sample(df, labels, sample, stretch).collect(), key=lambda r: r.doc_id)
    quality = np.array([int(r.quality > 0) for r in rows])
    if not 0 < quality.sum() < len(quality):
        return {"constant": float(quality.mean()) if len(quality) else 0.5}
    counts = np.array([len(r["size"]) for r in rows])
    size = np.concatenate([r["size"] for r in rows])
    x = with_neighbours(np.concatenate([r.own for r in rows]).reshape(-1, len(OWN)), counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    line_labels = quality[doc]
    w, none = fit_chain(x, counts, line_labels, linked=False)
    alone = x @ w
    worst = np.full(len(counts), np.inf)
    np.minimum.at(worst, doc, alone)
    line_labels = np.where((line_labels == 0) & (alone > 0) & (alone > worst[doc]), 1, line_labels)
    w, pairs = fit_chain(x, counts, line_labels, linked=True)
    _, good, _ = chain(x @ w, counts, pairs)
    return {"weights": w.tolist(), "pairs": pairs.tolist(), "curve": fit_curve(good_share(good, counts, size), quality)}


def _judged(batches: Iterator[pa.RecordBatch], model: dict):
    """(doc_ids, counts, sizes, good probabilities, scores) of parts of a partition; a part holds whole texts of a few MB."""
    for batch in batches:
        texts, ids = batch["text"].cast(pa.binary()).to_pylist(), batch["doc_id"]
        at = 0
        while at < len(texts):
            end, total = at + 1, len(texts[at])
            while end < len(texts) and total + len(texts[end]) <= _PART:
                total += len(texts[end])
                end += 1
            own, counts, size = own_features(texts[at:end])
            if "constant" in model:
                good = np.full(len(size), model["constant"])
                score = np.full(end - at, model["constant"])
            else:
                _, good, _ = chain(with_neighbours(own, counts) @ np.array(model["weights"]), counts, np.array(model["pairs"]))
                slope, offset = model["curve"]
                score = 1 / (1 + np.exp(-np.clip(slope * _logit(good_share(good, counts, size)) + offset, -40, 40)))
            yield ids.slice(at, end - at), counts, size, good, score
            at = end


def document_quality(df: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, n_lines and bad_lines of every document."""
    m = json.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, counts, _, good, score in _judged(batches, json.loads(m)):
            bad = np.bincount(np.repeat(np.arange(len(counts)), counts), good < 0.5, len(counts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(score), pa.array(counts), pa.array(bad)], names=["doc_id", "score", "n_lines", "bad_lines"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(df).alias("text")).mapInArrow(run, "doc_id long, score double, n_lines long, bad_lines long")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "n_lines", "bad_lines")


def line_labels(df: DataFrame, model: dict) -> DataFrame:
    """doc_id, line (from 1), bytes, probability and good of every line of every text."""
    m = json.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, counts, size, good, _ in _judged(batches, json.loads(m)):
            line = np.arange(len(size)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
            repeated = ids.take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            yield pa.RecordBatch.from_arrays([repeated, pa.array(line), pa.array(size), pa.array(good), pa.array(good >= 0.5)], names=["doc_id", "line", "bytes", "probability", "good"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(df).alias("text")).mapInArrow(run, "doc_id long, line long, bytes long, probability double, good boolean")
