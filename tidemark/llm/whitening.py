"""Embedding whitening by spectrum slicing.

Spark makes the sums and the centred second moments of all vectors; the leading eigenpairs of their covariance, a matrix
of width x width whatever the number of rows, come from ``slicing``; a last pass projects every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches
from tidemark.llm.slicing import EPS, leading
from tidemark.llm.vectors import common_width, entries, floored, matrix

SCALE, OFFSET = 64, 1_000_000


def _x(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    at, v = matrix(batch.column("vector"), width)
    return at, floored(v, SCALE) + OFFSET


@dataclass(frozen=True)
class Whitening:
    """What is fitted: rows, exact sums a dimension, eigenvalues (falling) and their vectors as columns, the trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, without the loss of digits that a large common offset brings."""
        whole = self.sums // self.n
        return (x - whole) - (self.sums - whole * self.n) / self.n

    @property
    def alive(self) -> np.ndarray:
        """Whether a component has any variance; one that double precision can't tell from zero has none."""
        return self.values > 64 * max(self.width, 16) * EPS * self.values.max(initial=0.0)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN for a component without variance."""
        scale = np.where(self.alive, 1 / np.sqrt(np.where(self.alive, self.values, 1)), np.nan)
        return self.centred(x) @ (self.vectors * scale)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n * x - sum)^2 over the dimensions; None beyond a long."""
        largest = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums.tolist()), default=0)
        if self.width * largest**2 < 1 << 63:
            return (((self.n * x - self.sums) ** 2).sum(axis=1)).tolist()
        whole = self.sums // self.n
        near = int(np.abs(x - whole).max(initial=0)) + 1
        if self.width * (near * self.n) ** 2 < 1 << 63:
            return (((x - whole) * self.n - (self.sums - whole * self.n)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - self.sums.astype(object)) ** 2).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in exact]


def _sums(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(width, np.int64)
        for b in batches:
            _, x = _x(b, width)
            n, sums = n + len(x), sums + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"at": range(-1, width), "total": [n, *sums.tolist()]}, pa.schema([("at", pa.int32()), ("total", pa.int64())]))

    return run


ROWS = pa.schema([("at", pa.int32()), ("cells", pa.list_(pa.float64()))])


def _cells(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"at": list(total), "cells": list(total.values())}, ROWS)


def _moments(width: int, of) -> callable:
    """A task's sum of outer products of the rows that of(x) makes; row -1 has their plain sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            _, x = _x(b, width)
            if len(x):
                y = of(x)
                both = np.vstack([y.sum(axis=0), y.T @ y])
                total = both if total is None else total + both
        if total is not None:
            yield _cells({i - 1: r for i, r in enumerate(total)})

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for at, cells in zip(b.column("at").to_pylist(), b.column("cells"), strict=True):
            cells = np.asarray(cells.values)
            total[at] = total[at] + cells if at in total else cells
    if total:
        yield _cells(total)


def _summed_moments(vectors: DataFrame, width: int, of, size: int) -> np.ndarray:
    """size + 1 rows over all tasks, added up by row before they reach the driver."""
    parts = vectors.mapInArrow(_moments(width, of), "at int, cells array<double>")
    found = parts.repartition("at").mapInArrow(_added, "at int, cells array<double>").collect()  # size + 1 rows
    out = np.zeros((size + 1, size))
    for r in found:
        out[r["at"] + 1] += np.array(r["cells"])
    return out


def fit(vectors: DataFrame, components: int) -> Whitening | None:
    """Sums, covariance and its leading eigenpairs over all rows of vectors (vec_id, vector); None if none is valid."""
    width = common_width(vectors, "vector")
    if not width:
        return None
    found = vectors.mapInArrow(_sums(width), "at int, total long").groupBy("at").agg(F.sum("total").alias("total")).collect()  # width + 1 rows
    totals = {r["at"]: r["total"] for r in found}
    if not totals:
        return None
    n, sums = totals[-1], np.array([totals[i] for i in range(width)], np.int64)
    bare = Whitening(n, sums, np.zeros(0), np.zeros((width, 0)), 0.0)
    found = _summed_moments(vectors, width, bare.centred, width)
    mean = found[0] / n  # what rounding has left
    covariance = found[1:] / n - np.outer(mean, mean)
    values, columns = leading(covariance, components)
    return Whitening(n, sums, values, columns, float(np.trace(covariance)))


def identity_error(vectors: DataFrame, w: Whitening) -> float | None:
    """The largest absolute entry of the covariance of all whitened rows less the identity; components without variance
    don't count, and None if there is no other."""
    alive = w.alive
    k = int(alive.sum())
    if not k:
        return None
    found = _summed_moments(vectors, w.width, lambda x: w.project(x)[:, alive], k)
    mean = found[0] / w.n
    return float(np.abs(found[1:] / w.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each valid row and leading component.

    Rows with a null vector, or null or non-finite entries, go, and so do vectors of another length than the most
    frequent one (of equally frequent ones the longest). Null and repeated vec_ids stay as rows of their own. There are at most as many
    components as dimensions. One without variance (fewer rows than dimensions, equal rows) has whitened null and isn't
    part of identity_error; without any variance explained is null. deviation is null beyond a long. Entries beyond 2**34
    raise. An empty table gives an empty result; further columns are ignored.
    """
    spark = embeddings.sparkSession
    small_batches(spark)
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), entries("embedding").alias("vector"))
    w = fit(vectors, components)
    if w is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(vectors, w)
    schema = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("all", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _x(b, w.width)
            flat = pa.array(w.project(x).ravel(), from_pandas=True)  # NaN becomes null
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(w.values), flat)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(at)), pa.array(w.deviation(x), pa.int64()), lists], schema=schema)

    rows = vectors.mapInArrow(run, "vec_id long, deviation long, all array<double>")
    explained = F.array(*[F.lit(float(e / w.trace) if w.trace > 0 else None).cast("double") for e in np.maximum(w.values, 0)])
    out = rows.select("vec_id", "deviation", F.posexplode("all").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
