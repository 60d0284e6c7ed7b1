"""Whitening of vectors by a bidiagonal qd solver (operator 11).

Entries become whole numbers ``floor(scale * c) + offset``; the distinct whole-number vectors are
the fit list. Its count and sums are exact. Every task centres its rows with them and
reduces them block by block to one triangular R (QR of the R so far over the next
block); the tasks' R are reduced in groups until one group is left, so what reaches the driver is
a bounded number of matrices of the vectors' dimension. There R is made bidiagonal, dqds
finds the singular values, twisted factorisations the directions (``bidiagonal.py``): V = R'R / n
is never formed, so its condition is not squared. A last pass over the fit list measures
how far the whitened vectors' covariance is from the identity.

Centred rows are (n x - S) / n with n x - S in whole numbers, so nothing is lost by an offset.
The whitened columns have mean zero, as the centred rows' sum is zero exactly.

Defined cases: vectors that are null, hold null or non-finite entries or have another length
than most kept ones (ties: the shortest) are dropped. Entries saturate at 2^30 in size
before the offset. Repeated rows stay and share their numbers; they enter the fit list once.
Components whose eigenvalue is zero to double precision have no whitened value and are not
returned, so a table with one distinct vector, or none, gives an empty result. A deviation
beyond a long is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bidiagonal import EPS, right_singular
from .common import bound_batches, stored
from .vectors import dimension, finite

MOST, SCALE, OFFSET = 16, 64, 1_000_000
LIMIT = 1 << 30
GROUP = 64
_LONG = 2**63 - 1


def whole_vector(column: Column, scale: int, offset: int) -> Column:
    """The vector's entries as whole numbers, saturated so that they fit 32 bits."""
    def entry(c: Column) -> Column:
        small = F.greatest(F.least(F.floor(c.cast("double") * scale).cast("double"), F.lit(float(LIMIT))), F.lit(float(-LIMIT)))
        return (small + offset).cast("int")
    return F.transform(column, entry)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def scaled_gaps(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact (whole numbers of any size where 64 bits could be left)."""
    if n * 2**32 + max(map(abs, sums)) > _LONG:
        return n * x.astype(object) - np.array(sums, object)
    return n * x - np.array(sums, np.int64)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return scaled_gaps(x, n, sums).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n x - S)^2, exact; nothing beyond a long."""
    gaps = scaled_gaps(x, n, sums)
    if len(gaps) and int(np.abs(gaps).max()) ** 2 * gaps.shape[1] > _LONG:
        gaps = gaps.astype(object)
        return [int(d) if d <= _LONG else None for d in (gaps * gaps).sum(1)]
    return np.einsum("ij,ij->i", gaps, gaps).tolist()


def _totals(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Count and sums of the fit list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(dim, dtype=np.int32)), pa.array(x.sum(0)), pa.array(np.full(dim, len(x)))],
                ["position", "total", "members"])

    added = fit.mapInArrow(run, "position int, total long, members long").groupBy("position").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("members").alias("members"))
    rows = sorted(added.collect(), key=lambda r: r["position"])  # one row a dimension
    return (rows[0]["members"] if rows else 0), [int(r["total"]) for r in rows]


def _upper(*blocks: np.ndarray) -> np.ndarray:
    """R of the QR factorisation of the blocks under one another, square."""
    r = np.linalg.qr(np.vstack(blocks), mode="r")
    dim = r.shape[1]
    return r if len(r) == dim else np.vstack([r, np.zeros((dim - len(r), dim))])


def triangle(fit: DataFrame, dim: int, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred fit list: in tasks block by block, then in groups of tasks."""
    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            rows = centred(_matrix(batch.column(0), dim), n, sums)
            for at in range(0, len(rows), 16 * dim):
                block = rows[at:at + 16 * dim]
                r = _upper(block) if r is None else _upper(r, block)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())],
                                             ["part", "r"])

    def read(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw).reshape(dim, dim)

    def reduce_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.sort_values("part")["r"]
        return pd.DataFrame({"part": [int(key[0])], "r": [_upper(*map(read, own)).tobytes()]})

    kind = "part long, r binary"
    found = stored(fit.mapInArrow(reduce_rows, kind), "triangles")
    while found.count() > GROUP:
        groups = found.groupBy(F.floor(F.col("part") / GROUP).alias("group")).applyInPandas(reduce_group, kind)
        found = stored(groups, "triangles")
    return _upper(*[read(r["r"]) for r in sorted(found.collect(), key=lambda r: r["part"])])  # at most GROUP matrices


def _identity_error(fit: DataFrame, dim: int, n: int, sums: list[int], basis: np.ndarray) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity."""
    k = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = centred(_matrix(batch.column(0), dim), n, sums) @ basis
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k, dtype=np.int32)), pa.array((z.T @ z).reshape(-1))], ["place", "total"])

    added = fit.mapInArrow(run, "place int, total double").groupBy("place").agg(F.sum("total").alias("total"))
    covariance = np.zeros(k * k)
    for r in added.collect():  # components squared
        covariance[r["place"]] = r["total"] / n
    return float(np.abs(covariance.reshape(k, k) - np.eye(k)).max())


def whiten(vectors: DataFrame, most: int = MOST, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """For each kept row of ``vectors`` (vec_id, embedding) and component: vec_id, component (from 1 by
    falling eigenvalue), n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    bound_batches(spark)
    kept = vectors.select("vec_id", "embedding").filter(finite(F.col("embedding")))
    kind = T.StructType([kept.schema["vec_id"]] + T.StructType.fromDDL(
        "component int, n long, deviation long, whitened double, explained double, identity_error double").fields)
    dim = dimension(kept)
    if dim is None:
        return spark.createDataFrame([], kind)
    kept = kept.filter(F.size("embedding") == dim).select("vec_id", whole_vector(F.col("embedding"), scale, offset).alias("x"))
    fit = stored(kept.select("x").distinct(), "fitlist")
    n, sums = _totals(fit, dim)
    values, directions = right_singular(triangle(fit, dim, n, sums), min(most, dim))
    k = int((values[:most] > values[0] * 4 * dim * EPS).sum()) if values[0] > 0 else 0
    if k == 0:
        return spark.createDataFrame([], kind)
    basis = directions[:, :k] / (values[:k] / np.sqrt(n))
    explained = (values[:k] / values[0]) ** 2 / ((values / values[0]) ** 2).sum()
    error = _identity_error(fit, dim, n, sums, basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), dim)
            z = centred(x, n, sums) @ basis
            rows = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(x) * k, n)), pa.array(deviations(x, n, sums), pa.int64()).take(rows),
                 pa.array(z.reshape(-1)), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))], kind.names)

    return kept.mapInArrow(run, kind)
