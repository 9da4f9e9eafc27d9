"""Preparing evaluation data: replication, noise, canaries, class shifts, query families."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.session import ready


PRIME = 2147483647


def _mixed(x: np.ndarray) -> np.ndarray:
    """Three rounds of shift and multiply modulo a prime, in whole numbers that SQL can follow."""
    for shift, factor in ((15, 48271), (12, 69621), (14, 16807)):
        x = (x ^ (x >> shift)) * factor % PRIME
    return x


def normals(ids: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """A row of normal values for each id; value j depends on id, j and seed alone (Box and Muller's cosine)."""
    start = (ids.astype(np.int64)[:, None] * 1000003 + np.arange(dim) * 7919 + seed * 104729) % PRIME
    first = _mixed(start)
    second = _mixed((first + 3 * start + 12345) % PRIME)
    return np.sqrt(-2 * np.log((first + 1) / (PRIME + 1))) * np.cos(2 * np.pi * (second / PRIME))


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat))


def replicated(rows: DataFrame, n: int, id_col: str = "id", count: int | None = None) -> DataFrame:
    """n rows, of which number i is row i mod count; id_col runs from 0 to count - 1 and is renumbered."""
    size = count or rows.count()
    return rows.sparkSession.range(n).withColumnRenamed("id", "_i").join(rows, F.col("_i") % size == F.col(id_col)).drop(id_col).withColumnRenamed("_i", id_col)


def tiled(rows: DataFrame, times: int, deviation: float, seed: int = 42, id_col: str = "id", vector_col: str = "vector", stride: int | None = None) -> DataFrame:
    """Every row so often, with normal noise on each value (see normals()); copy c of id i gets id c * stride + i."""
    ready(rows.sparkSession)
    step = stride or rows.count()
    copies = rows.select(id_col, vector_col).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).select((F.col("_c") * step + F.col(id_col)).cast("long").alias(id_col), vector_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, sizes = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32), b.column(1).value_lengths().fill_null(0).to_numpy()
            if not len(flat):
                yield b
                continue
            noise = normals(b.column(0).to_numpy(), int(sizes.max()), seed)[np.arange(int(sizes.max())) < sizes[:, None]]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists((flat + deviation * noise).astype(np.float32), sizes)], names=b.schema.names)

    return copies.mapInArrow(task, copies.schema)


def repeated(rows: DataFrame, times: int, id_col: str = "id") -> DataFrame:
    """Every row so often in a row: copy c of id i gets id i * times + c."""
    names = [c for c in rows.columns if c != id_col]
    return rows.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).select((F.col(id_col) * times + F.col("_c")).alias(id_col), *names)


def injected(rows: DataFrame, ids: list[int], vector: list[float], id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """rows with one vector in the place of those of some ids."""
    return rows.withColumn(vector_col, F.when(F.col(id_col).isin(ids), F.array(*map(F.lit, vector)).cast("array<float>")).otherwise(F.col(vector_col)))


def shifted(vector: Column, condition: Column, by: float = 0.85, dims: int = 64) -> Column:
    """vector with its first dims values raised where a condition holds."""
    return F.when(condition, F.transform(vector, lambda v, i: F.when(i < dims, v + F.lit(by).cast("float")).otherwise(v))).otherwise(vector)


def sliced(vector: Column, dims: int) -> Column:
    return F.slice(vector, 1, dims)


def vote_batch(queries: DataFrame, families: int = 8, threshold: int = 40) -> DataFrame:
    """queries: qid, qvec. With a family in turn and one threshold for all."""
    return queries.select("qid", "qvec", (F.col("qid") % families).cast("int").alias("family"), F.lit(threshold).alias("threshold"))


def fixed_count(queries: DataFrame, n: int) -> DataFrame:
    """n queries by repeating or cutting: qid runs from 0 in both."""
    return replicated(queries, n, "qid")


def synthetic(spark: SparkSession, n: int, dim: int, seed: int = 42, parts: int | None = None) -> DataFrame:
    """n normal vectors of length 1: id, vector; a row depends on its id and the seed alone."""
    ready(spark)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            out = normals(ids, dim, seed)
            out = (out / np.sqrt((out * out).sum(1, keepdims=True))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(out.ravel(), np.full(len(ids), dim))], names=["id", "vector"])

    return spark.range(0, n, 1, parts).mapInArrow(task, "id long, vector array<float>")


def orthogonal_weights(dim: int, rank: int, seed: int = 42) -> np.ndarray:
    """Orthonormal columns from the QR decomposition of normal values."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, rank)))[0]


def clustered(n: int, dim: int, queries: int, centres: int = 100, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Base and query vectors around normal centres, in place of a downloaded set."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(100, 50, (centres, dim))
    draw = lambda m: (middle[rng.integers(0, centres, m)] + rng.normal(0, 15, (m, dim))).astype(np.float32)
    return draw(n), draw(queries)
