"""Embedding whitening by bit-sliced scatter: the bit planes of each dimension, packed across rows into words, give exact
cross-products by weighted counts of the bits that two planes share; they are centred as integers before the
eigenvectors are taken."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotmark.llm.common import materialise

SCALE, COMPONENTS = 256, 4
BLOCK = 8192  # rows whose bits are sliced together, fewer where vectors are long
LIMB = 60  # bits of the lower part of a cross-product, so that sums of both parts fit a decimal
_LONG = 2**63


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of each column, products of each pair of columns summed over the rows) of a matrix of longs, as Python integers.

    Columns are shifted to start at 0. Word w of plane (j, k) holds bit k of column j for 64 rows; the products of columns i
    and j are the counts of bits that their planes share, weighted by both planes' powers of two."""
    m, d = x.shape
    least = x.min(axis=0)
    y = x.astype(np.uint64) - least.astype(np.uint64)  # wraps, so it is right for any two longs
    bits = [int(v).bit_length() for v in y.max(axis=0)]
    words = -(-m // 64)
    planes, column, power = np.zeros((sum(bits), words), np.uint64), np.repeat(np.arange(d), bits), np.concatenate([np.arange(b) for b in bits]).astype(int)
    for k in range(max(bits, default=0)):
        own = np.flatnonzero(power == k)
        packed = np.zeros((len(own), words * 8), np.uint8)
        part = np.packbits(((y[:, column[own]] >> np.uint64(k)) & np.uint64(1)).astype(np.uint8).T, axis=1)
        packed[:, : part.shape[1]] = part
        planes[own] = packed.view(np.uint64)
    kind = np.int64 if 2 * max(bits, default=0) + m.bit_length() < 62 else object
    weight = np.array([1 << int(k) for k in power], dtype=kind)
    shared, total = np.zeros((d, d), dtype=kind), np.zeros(d, dtype=kind)
    np.add.at(total, column, np.bitwise_count(planes).sum(axis=1).astype(kind) * weight)
    for a in range(len(planes)):
        j = column[a]
        counts = np.bitwise_count(planes[a] & planes[a:]).sum(axis=1).astype(kind) * weight[a:] * weight[a]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(column[a:])) + 1])
        sums = np.add.reduceat(counts, starts)
        sums[0] += sums[0] - counts[0]  # within a column each pair of planes counts both ways
        shared[j, column[a:][starts]] += sums
    shared = np.where(np.arange(d)[:, None] <= np.arange(d), shared, shared.T).astype(object)
    total, least = total.astype(object), least.astype(object)
    shift = np.outer(least, total)
    return total + m * least, shared + shift + shift.T + m * np.outer(least, least)


def _matrices(batches: Iterator[pa.RecordBatch], column: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    rows = max(64, min(BLOCK, 4_000_000 // d))
    for b in batches:
        for part in (b.slice(i, rows) for i in range(0, b.num_rows, rows)):
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)


def integer_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(256 c) of each entry c of the vectors that are not null and have no null or non-finite entry."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad)
    return rows.filter(F.coalesce(sound, F.lit(False))).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"))


@dataclass
class Whitening:
    """What is learnt from a list of integer vectors: their number, exact sums, and the leading eigenvectors (columns) and
    eigenvalues of their covariance, with its trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        most = max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))))
        small = self.n * most + max(map(abs, self.sums)) < _LONG
        return x * self.n - np.array(self.sums, dtype=np.int64) if small else x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        """Sums of squares of each row, exact; None where a long can't hold it."""
        most = max((abs(int(v)) for v in (centred.min(initial=0), centred.max(initial=0))))
        if centred.dtype == np.int64 and centred.shape[1] * most**2 < _LONG:
            return (centred * centred).sum(axis=1).tolist()
        own = centred.astype(object)
        return [s if s < _LONG else None for s in (own * own).sum(axis=1).tolist()]

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.vectors / np.sqrt(self.values)


def fit_whitening(fit: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """Of the vectors ``x`` (all of length ``d``) in ``fit``; None if there are none. Each task counts shared bits of its rows; the
    driver gets the sums, whose number depends on ``d`` alone. Components without variance are left out."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        for _, x in _matrices(batches, 0, d):
            own, both = cross_products(x)
            n, sums, products = n + len(x), sums + own, products + both
        if n:
            i, j = np.triu_indices(d)
            values = [n, *sums.tolist(), *products[i, j].tolist()]
            high, low = zip(*(divmod(v, 1 << LIMB) for v in values), strict=True)
            kind = pa.decimal128(38, 0)
            places = [pa.array([-1, *[-1] * d, *i.tolist()], pa.int32()), pa.array([-1, *range(d), *j.tolist()], pa.int32())]
            yield pa.RecordBatch.from_arrays([*places, *(pa.array(list(map(Decimal, v)), kind) for v in (high, low))], ["i", "j", "high", "low"])

    parts = fit.select("x").mapInArrow(scatter, "i int, j int, high decimal(38,0), low decimal(38,0)")
    found = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    got = {(r["i"], r["j"]): (int(r["high"]) << LIMB) + int(r["low"]) for r in found}
    if not got:
        return None
    n, sums = got[-1, -1], [got[-1, j] for j in range(d)]
    covariance = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            covariance[i, j] = covariance[j, i] = (n * got[i, j] - sums[i] * sums[j]) / (n * n)  # one rounding of an exact ratio
    trace = sum(n * got[i, i] - sums[i] ** 2 for i in range(d)) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(), 0) * d * np.finfo(float).eps]
    return Whitening(n, sums, np.ascontiguousarray(vectors[:, order]), values[order], trace)


def identity_error(fit: DataFrame, d: int, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened ``fit`` minus the identity."""
    k = len(model.values)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for _, x in _matrices(batches, 0, d):
            w = model.project(model.centred(x))
            total += np.column_stack([w.T @ w, w.sum(axis=0)])
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    out = np.zeros((k, k + 1))
    for r in fit.select("x").mapInArrow(moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"] / model.n
    mean = out[:, k]  # next to nothing: the vectors are centred before they are projected
    return float(np.abs(out[:, :k] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per sound vector and leading component: vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained and
    identity_error; see ``Whitening``. Fitted on each distinct integer vector once, however many copies it has.

    Null vectors, empty ones and those with null or non-finite entries take no part, nor do vectors of another length than the
    commonest (of equally common ones the longest). Entries beyond a long count as the nearest long, and a deviation that a
    long can't hold is null. Where no component has variance, as for a single vector or an empty table, there are no rows. Ids are
    passed on, null or repeated, and other columns are ignored."""
    rows = integer_vectors(embeddings, id_col, vector_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    size = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = size["d"] if size else 1
    rows = rows.filter(F.size("x") == d)
    fit = materialise(rows.select("x").distinct(), "fit-vectors")
    model = fit_whitening(fit, d, components) if size else None
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    sent, error = rows.sparkSession.sparkContext.broadcast(model), identity_error(fit, d, model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        k = len(own.values)
        for part, x in _matrices(batches, 1, d):
            centred = own.centred(x)
            w, deviation = own.project(centred), own.deviations(centred)
            m = len(x)
            arrays = [
                part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, own.n), pa.int64()),
                pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(w.ravel()),
                pa.array(np.tile(own.values / own.trace, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
