"""Embedding whitening from an exact, bit-sliced scatter matrix.

Entries become fixed-point longs x = floor(256 c). The fit list holds each distinct x vector once. A task shifts every
dimension of a block of vectors to zero, packs each bit of each dimension across the rows into 64-bit words (a bit plane), and
ANDs and popcounts pairs of planes: weighted by the planes' powers of two, the counts are the block's exact cross-products.
Blocks add up in limbs of 48 bits, so the sums stay exact at any size. The driver sees one d x d matrix (d: dimensions, the
documented bound of what it gathers), centres it in integers, n * P - S S', and only then goes to floating point for eigh.

Defined results: a row whose vector is null, or holds a null, NaN or infinite entry, is dropped, and so is one of another length
than most distinct vectors have (the longer one of a tie; empty vectors never count); an entry beyond a long saturates; a null
vec_id is carried through; repeated rows each get their rows, and count once in the fit; other columns are ignored. A component without variance
(all vectors equal, or fewer distinct vectors than components) has whitened 0, and identity_error covers the components with variance.
An empty table gives an empty result. deviation is exact; where it exceeds a long it is null and deviation_digits has it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.llm.tables import staged

SCALE = 256
_LIMB = 48
_LONG = 2**63


def fixed_point(vector: Column) -> Column:
    """array<long> of floor(256 c); null where an entry is null or not finite."""
    entries = vector.cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(finite, F.transform(entries, lambda c: F.floor(c * SCALE)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as an int64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64, copy=False)


def bit_planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(planes as 64-bit words, dimension and bit of each plane) of an unsigned matrix of rows by dimensions."""
    planes, dims, bits = [], [], []
    top = shifted.max(axis=0) if len(shifted) else np.zeros(shifted.shape[1], np.uint64)
    for d in range(shifted.shape[1]):
        for b in range(int(top[d]).bit_length()):
            packed = np.packbits((shifted[:, d] >> np.uint64(b) & np.uint64(1)).astype(np.uint8))
            planes.append(np.pad(packed, (0, -len(packed) % 8)).view(np.uint64))
            dims.append(d)
            bits.append(b)
    words = np.array(planes, np.uint64) if planes else np.zeros((0, 1), np.uint64)
    return words, np.array(dims, np.int64), np.array(bits, np.int64)


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums over the rows of x (int64): of each dimension, and of each product of two dimensions (Python ints)."""
    rows, width = x.shape
    low = x.min(axis=0)
    shifted = x.view(np.uint64) - low.view(np.uint64)
    words, dims, bits = bit_planes(shifted)
    top = int(bits.max()) if len(bits) else 0
    kind = np.int64 if 2 * (top + 1) + rows.bit_length() + 2 < 63 else object  # the sums below fit a long, or are Python ints
    sums, products = np.zeros(width, kind), np.zeros((width, width), kind)
    weight = np.array([1 << int(b) for b in bits], kind)
    np.add.at(sums, dims, np.bitwise_count(words).sum(axis=1, dtype=np.int64).astype(kind) * weight)
    for k in range(len(words)):
        counts = np.bitwise_count(words[k] & words).sum(axis=1, dtype=np.int64).astype(kind)
        np.add.at(products, (dims[k], dims), counts * weight * weight[k])
    low = low.astype(object)
    sums, products = sums.astype(object), products.astype(object)
    # back to the unshifted origin
    return sums + rows * low, products + np.outer(low, sums) + np.outer(sums, low) + rows * np.outer(low, low)


def _limbs(v: int) -> tuple[int, int, int]:
    low = v & ((1 << _LIMB) - 1)
    v >>= _LIMB
    return low, v & ((1 << _LIMB) - 1), v >> _LIMB


_SUMS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("low", pa.int64()), ("mid", pa.int64()), ("high", pa.int64())])


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's sums: i = j = -1 for the rows, i = -1 for a dimension, i <= j for a pair."""
    n, sums, products = 0, None, None
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):  # planes stay in the cache
            s, p = cross_products(_matrix(batch["x"].slice(at, 4096)))
            sums, products = (s, p) if sums is None else (sums + s, products + p)
        n += batch.num_rows
    if not n:
        return
    values = [(-1, -1, n), *((-1, j, v) for j, v in enumerate(sums)), *((i, j, products[i, j]) for i in range(len(sums)) for j in range(i, len(sums)))]
    yield from pa.Table.from_pylist([dict(zip(_SUMS.names, (i, j, *_limbs(int(v))), strict=True)) for i, j, v in values], _SUMS).to_batches()


def scatter(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, P): rows, sums of the dimensions and sums of their products of the vectors in column x, all exact."""
    limbs = ("low", "mid", "high")
    total = fit.select("x").mapInArrow(_scatter, "i int, j int, low long, mid long, high long").groupBy("i", "j").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in limbs))
    value = {(r.i, r.j): int(r.low) + (int(r.mid) << _LIMB) + (int(r.high) << 2 * _LIMB) for r in total.collect()}
    n = value.get((-1, -1), 0)
    width = sum(i == -1 for i, _ in value) - 1 if n else 0
    return n, [value[-1, j] for j in range(width)], [[value[min(i, j), max(i, j)] for j in range(width)] for i in range(width)]


def components(n: int, sums: list[int], products: list[list[int]], most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(unit eigenvectors as columns, eigenvalues, trace) of the covariance, the largest first; each vector's largest entry is positive."""
    centred = [[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(len(sums))] for i in range(len(sums))]  # int / int rounds once
    values, vectors = np.linalg.eigh(np.array(centred))
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    trace = math.fsum(centred[i][i] for i in range(len(sums)))
    least = trace * len(sums) * np.finfo(float).eps
    return vectors * np.where(lead < 0, -1.0, 1.0), np.where(values > least, values, 0.0), trace


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: int64 where that holds every step of a sum of squares, else Python ints."""
    most = max(abs(int(x.max())), abs(int(x.min()))) * n + max(map(abs, sums)) if x.size else 0
    if most * most * max(1, x.shape[1]) < _LONG:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _project(centred: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    if centred.dtype == object:
        return np.array([[v / n for v in row] for row in centred], float).reshape(centred.shape) @ basis
    return (centred / n) @ basis


def whitened(df: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = 4) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error and deviation_digits for each kept row and component."""
    rows = df.select(F.col(key).cast("long").alias("vec_id"), fixed_point(F.col(vector)).alias("x")).where(F.size("x") > 0)
    distinct = staged(rows.select("x").distinct())
    size = distinct.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"
    if size is None:
        return df.sparkSession.createDataFrame([], schema)
    same = F.size("x") == size.d
    fit = distinct.where(same)
    n, sums, products = scatter(fit)
    vectors, values, trace = components(n, sums, products, most)
    basis = vectors / np.sqrt(np.where(values > 0, values, np.inf))
    explained = values / trace if trace > 0 else np.zeros(len(values))
    live = int((values > 0).sum())
    pairs = [(a, b) for a in range(live) for b in range(a, live)]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(live + len(pairs))
        for batch in batches:
            y = _project(_centred(_matrix(batch["x"]), n, sums), n, basis[:, :live])
            total += np.concatenate([y.sum(axis=0), [(y[:, a] * y[:, b]).sum() for a, b in pairs]])
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(total)), pa.int32()), "v": pa.array(total)})

    error = 0.0
    if live:  # measured on the fit list, from the numbers that are returned
        found = {r.k: r.v / n for r in fit.select("x").mapInArrow(moments, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
        error = max(abs(found[live + k] - found[a] * found[b] - (a == b)) for k, (a, b) in enumerate(pairs))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centred = _centred(_matrix(batch["x"]), n, sums)
            y = _project(centred, n, basis)
            k, r = y.shape[1], batch.num_rows
            exact = [int(v) for v in (centred * centred).sum(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["vec_id"].take(pa.array(np.repeat(np.arange(r), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)),
                    pa.array(np.full(r * k, n, np.int64)),
                    pa.array([v if v < _LONG else None for v in exact for _ in range(k)], pa.int64()),
                    pa.array(y.ravel()),
                    pa.array(np.tile(explained, r)),
                    pa.array(np.full(r * k, error)),
                    pa.array([str(v) for v in exact for _ in range(k)], pa.string()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"],
            )

    return rows.where(same).mapInArrow(apply, schema)
