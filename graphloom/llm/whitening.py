"""Whitening of embeddings by a distributed singular value decomposition.

Entries become integers first (floor(scale * c) + offset), so counts, sums and deviations are exact.  The rows are centred
before anything is multiplied: (n * x - S) / n, whose numerator is exact.  MLlib's computeSVD of the centred rows gives the
components; a singular value s becomes the eigenvalue s^2 / n.  The total variance comes from the exact deviations,
not from the decomposition, so that `explained` doesn't inherit its errors.

What reaches the driver is one sum a dimension and matrices of dimension x dimension, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Least singular value that counts, as a share of the largest; below it a component is rounding noise and can't be whitened.
LEAST = 1e-6
#: Largest entry as an integer: 2^52, up to which doubles are exact.
MOST = 1 << 52


@dataclass
class Whitening:
    """n rows with sums S were fitted; column i of `components` (dimensions x components) has `eigenvalues[i]`; `total` is the covariance's trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    total: float


def whole_numbers(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, x (array of long), stored: the rows whose vector can be used.

    Null vectors and vectors with null or non-finite entries go, and so do empty ones and those whose length isn't the commonest (of
    equals the longest), which have no place in one covariance.  Repeated rows and null ids stay.  Other columns are never read.
    Entries beyond 2^52 / scale raise.
    """

    def run(batches):
        for b in batches:
            ids, found = [], []
            for i, v in zip(b.column(0), b.column(1)):
                if not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                c = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(c).all():
                    x = np.floor(scale * c) + offset
                    if np.abs(x).max() > MOST:
                        raise OverflowError(f"an entry of vector {i.as_py()} is too large to be a whole number")
                    ids.append(i.as_py())
                    found.append(x.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["vec_id", "x"])

    rows = stored(vectors.select(F.col(vec_id).cast("long"), F.col(embedding).cast("array<double>")).mapInArrow(run, "vec_id long, x array<long>"))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    return rows.where(F.size("x") == lengths[0]["d"]) if len(lengths) > 1 else rows


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The rows' vectors as one matrix; they are of one length and without nulls."""
    return batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def column_sums(rows: DataFrame) -> tuple[int, np.ndarray]:
    """The number of rows and the exact sum of each dimension.  A sum beyond 64 bits raises."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(x.shape[1]), pa.int32()), pa.array(x.sum(axis=0)), pa.array([b.num_rows] * x.shape[1], pa.int64())], names=["at", "s", "n"]
                )

    found = rows.select("vec_id", "x").mapInArrow(run, "at int, s long, n long").groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("at").collect()
    return (found[0]["n"], np.array([r["s"] for r in found], np.int64)) if found else (0, np.zeros(0, np.int64))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S as whole numbers: 64-bit where that is exact, Python's own beyond."""
    x64 = x.astype(np.float64)
    if x.size and max(np.abs(x64).max() * n, np.abs(sums.astype(np.float64)).max()) > 2**61:
        return x.astype(object) * n - sums.astype(object)
    return x * n - sums


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """The sum over dimensions of (n * x - S)^2 for each row, exact."""
    apart = centred(x, n, sums)
    if apart.dtype != object and apart.size and apart.shape[1] * float(np.abs(apart).max()) ** 2 > 2**62:
        apart = apart.astype(object)
    return (apart * apart).sum(axis=1).tolist()


def fit(rows: DataFrame, most: int | None = None) -> Whitening:
    """The whitening of rows of whole_numbers.  `most` components are kept, or all that are not rounding noise; constant rows and empty tables have none."""
    n, sums = column_sums(rows)
    d = len(sums)
    if not n:
        return Whitening(0, sums, np.zeros((0, 0)), np.zeros(0), 0.0)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b)
                apart = (centred(x, n, sums) / n).astype(np.float64)
                total = str(sum(deviations(x, n, sums)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(apart), pa.list_(pa.float64())), pa.array([total] + [None] * (b.num_rows - 1), pa.string())], names=["v", "deviation"]
                )

    moved = stored(rows.select("vec_id", "x").mapInArrow(run, "v array<double>, deviation string"))
    exact = moved.agg(F.sum(F.col("deviation").cast("decimal(38,0)"))).first()[0]
    total = float(int(exact)) / float(n) ** 3
    if not total:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    vectors = MLUtils.convertVectorColumnsFromML(moved.select(array_to_vector("v").alias("v")), "v")
    # With all d components asked for, MLlib decomposes the Gramian in full rather than by iterations that stop at a tolerance.
    svd = RowMatrix(vectors, n, d).computeSVD(d, computeU=False, rCond=LEAST)
    components = svd.V.toArray()
    components = components * np.where(components[np.abs(components).argmax(axis=0), range(components.shape[1])] < 0, -1.0, 1.0)
    return Whitening(n, sums, components[:, :most], svd.s.toArray()[:most] ** 2 / n, total)


def whiten(rows: DataFrame, fitted: Whitening) -> DataFrame:
    """vec_id, deviation (exact), whitened (array of double, one entry a component) of every row.  A deviation beyond 64 bits raises."""
    n, sums, by = fitted.n, fitted.sums, fitted.components / np.sqrt(fitted.eigenvalues)

    def run(batches):
        for b in batches:
            x = _matrix(b) if b.num_rows else np.zeros((0, len(sums)), np.int64)
            out = (centred(x, n, sums) / n).astype(np.float64) @ by if n else np.zeros((b.num_rows, 0))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(deviations(x, n, sums), pa.int64()), pa.array(list(out), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"]
            )

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, k: int) -> float:
    """The largest absolute entry of the whitened rows' covariance (divisor n) minus the identity, from sums of products of rows centred again; 0 without rows or components."""

    def sums(batches):
        for b in batches:
            if b.num_rows and k:
                yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(_matrix(b).sum(axis=0)), pa.array([b.num_rows] * k, pa.int64())], names=["i", "s", "n"])

    only = whitened.select(F.lit(0), "whitened")
    found = only.mapInArrow(sums, "i int, s double, n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    if not found:
        return 0.0
    n, mean = found[0]["n"], np.array([r["s"] for r in found]) / found[0]["n"]

    def products(batches):
        for b in batches:
            if b.num_rows:
                w = _matrix(b) - mean
                yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array((w.T @ w).ravel())], names=["ij", "p"])

    cells = only.mapInArrow(products, "ij int, p double").groupBy("ij").agg(F.sum("p").alias("p")).orderBy("ij").collect()
    return float(np.abs(np.array([c["p"] for c in cells]).reshape(k, k) / n - np.eye(k)).max())


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a vector and component; a table without usable vectors, or with constant ones, gives none."""
    rows = whole_numbers(table(spark, sf_dir, "embeddings"))
    fitted = fit(rows, COMPONENTS)
    k = len(fitted.eigenvalues)
    out = stored(whiten(rows, fitted))
    explained = F.array(*[F.lit(float(e / fitted.total)) for e in fitted.eigenvalues]) if k else F.array().cast("array<double>")
    return (
        out.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
        .select(
            "vec_id", (F.col("i") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
            F.element_at(explained, F.col("i") + 1).alias("explained"), F.lit(identity_error(out, k)).alias("identity_error"),
        )
    )
