"""Operator 13: whitening of embeddings by their principal components.

1. Entries become whole numbers, whose sums per dimension are exact at any order of rows.
2. Rows are centred (n * x - S is exact, and divided by n last) and go to Spark MLlib's ``computeSVD``
   as a distributed matrix; its right vectors are the components, and a singular value s stands for the
   eigenvalue s * s / n, as the covariance has the divisor n.
3. The total variance comes from the exact deviations, apart from the decomposition.
4. Rows are projected batch by batch. What the driver and each task hold is the components, a
   few rows as long as a vector.

Defined results: a vector that is null, or holds a null, a NaN or an infinity, goes; so does one that hasn't the length most
vectors have (the longer of equally frequent ones). Ids aren't looked at, so null and repeated ones stay, and rows that
repeat count each. Components without variance are left out: those of one row, of equal rows, and beyond the rank. No
row, or no component, gives no row. Entries over 2**57 are an overflow error. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.shipping import shipped

MOST = 32
#: Whole numbers are entries times this, plus that.
SCALE, SHIFT = 64, 1_000_000
#: A component whose eigenvalue is below this part of the first one is rounding alone.
RANK = 1e-12


@dataclass(frozen=True)
class Whitening:
    """The fit: n rows, sums S per dimension, components as columns, their eigenvalues, and the covariance's trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace


def numbers(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x (whole numbers) of the rows that stay."""
    own = rows.select(rows["vec_id"].alias("vec_id"), rows[vector].cast("array<double>").alias("c")).where("c is not null")
    bad = F.exists("c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    own = own.where(~F.coalesce(bad, F.lit(True)))
    lengths = own.groupBy(F.size("c").alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("d")).take(1)
    own = own.where(F.size("c") == (lengths[0]["d"] if lengths else 0))
    return own.select("vec_id", F.transform("c", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def sums(rows: DataFrame, column: str, kind: str = "long") -> np.ndarray:
    """The sum of each place of an array column, one row per task and place before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = _matrix(batch.column(0)).sum(axis=0)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["place", "part"])

    parts = shipped(rows.select(column)).mapInArrow(run, f"place int, part {kind}")
    return np.array([r["whole"] for r in parts.groupBy("place").agg(F.sum("part").alias("whole")).orderBy("place").collect()])


def deviations(x: Column | str, n: int, total: np.ndarray) -> Column:
    """n * x - S of each dimension, exact."""
    whole = F.array(*[F.lit(int(s)) for s in total]).cast("array<bigint>")
    return F.zip_with(x, whole, lambda v, s: v * F.lit(n).cast("long") - s)


def squared(values: Column | str) -> Column:
    """The sum of squares, exact up to 38 digits."""
    def square(v: Column) -> Column:
        return (v.cast("decimal(19,0)") * v.cast("decimal(19,0)")).cast("decimal(38,0)")

    return F.aggregate(values, F.lit(0).cast("decimal(38,0)"), lambda acc, v: (acc + square(v)).cast("decimal(38,0)"))


def row_matrix(rows: DataFrame, column: str) -> RowMatrix:
    """MLlib's distributed matrix of an array column; rows don't leave the JVM."""
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v"))


def fit(rows: DataFrame, most: int = MOST) -> Whitening:
    """The fit over all rows of :func:`numbers`."""
    n = rows.count()
    total = sums(rows, "x") if n else np.zeros(0, dtype=np.int64)
    empty = Whitening(n, total, np.zeros((len(total), 0)), np.zeros(0), 0.0)
    if not len(total):
        return empty
    centred = rows.select(deviations("x", n, total).alias("d"))
    variance = centred.agg(F.sum(squared("d")).cast("decimal(38,0)").alias("v")).first()["v"]
    if not variance:
        return empty
    found = row_matrix(centred.select(F.transform("d", lambda v: v / F.lit(float(n))).alias("c")), "c").computeSVD(min(most, len(total)), computeU=False, rCond=1e-15)
    values = np.array(found.s.toArray()) ** 2 / n
    real = values > RANK * values[0]
    vectors = np.array(found.V.toArray())[:, : len(values)]
    return Whitening(n, total, vectors[:, real], values[real], float(variance) / float(n) ** 3)


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation and whitened (one entry a component) of every row."""
    weights = model.components / np.sqrt(model.eigenvalues)
    n = model.n

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = (_matrix(batch.column(2)) / n) @ weights
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, own.shape[1]), pa.int32()), pa.array(own.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["vec_id", "deviation", "whitened"])

    kind = dict(rows.dtypes)["vec_id"]
    own = rows.select("vec_id", deviations("x", n, model.sums).alias("d")).select("vec_id", squared("d").alias("deviation"), "d")
    return shipped(own).mapInArrow(run, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry of the covariance of ``whitened`` less the identity; centred, then multiplied, over n."""
    k = len(model.eigenvalues)
    means = F.array(*[F.lit(float(m)) for m in sums(rows, "whitened", "double") / model.n])
    centred = rows.select(F.zip_with("whitened", means, lambda v, m: v - m).alias("w"))
    covariance = np.array(row_matrix(centred, "w").computeGramianMatrix().toArray()) / model.n
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(rows: DataFrame, most: int = MOST, vector: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error: a row for each vector that stays and component."""
    own = numbers(rows, vector)
    model = fit(own, most)
    kind = dict(own.dtypes)["vec_id"]
    if not len(model.eigenvalues):
        return own.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    out = whitened(own, model)
    error = identity_error(out, model)
    share = F.array(*[F.lit(float(e)) for e in model.explained])
    placed = out.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return placed.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))
