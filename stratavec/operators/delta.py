"""The mutable part: an append-only log of operations, what is live in it, and searches merged with a base index."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratavec.functions.distance import score
from stratavec.operators.knn import batch_search, exact_knn
from stratavec.session import stored
from stratavec.sources.index import Index, build, concatenated, numbered

INSERT, DELETE = 1, 2
LOG_DDL = "seq long, op tinyint, id long, vector array<float>"


def live(log: DataFrame) -> DataFrame:
    """Inserts that no later delete of their id hides: seq, id, vector. An equi-join with one row per deleted id."""
    deletes = log.filter(F.col("op") == DELETE).groupBy("id").agg(F.max("seq").alias("deleted"))
    rows = log.filter(F.col("op") == INSERT).join(deletes, "id", "left")
    return rows.filter(F.col("seq") > F.coalesce("deleted", F.lit(-1))).select("seq", "id", "vector")


def sizes(log: DataFrame, flush_threshold: int = 0) -> DataFrame:
    """One row: live and total inserts, and whether a flush is due."""
    total = log.filter(F.col("op") == INSERT).agg(F.count(F.lit(1)).alias("total"))
    alive = live(log).agg(F.count(F.lit(1)).alias("live"))
    return alive.crossJoin(total).withColumn("needs_flush", F.col("live") >= flush_threshold)


def delta_knn(log: DataFrame, queries: DataFrame | np.ndarray, k: int, dim: int) -> DataFrame:
    """The k nearest live entries of each query, ties by seq: qid, rank, id, score, dist. Ids may repeat."""
    entries = live(log)
    found = exact_knn(entries, queries, k, dim, "seq").withColumnRenamed("id", "seq")
    return found.join(log.filter(F.col("op") == INSERT).select("seq", "id"), "seq").select("qid", "rank", "id", score(F.col("dist")).alias("score"), "dist")


def search_merged(index: Index, log: DataFrame, queries: DataFrame | np.ndarray, k: int) -> DataFrame:
    """The k best of base and log together: qid, rank, id, score, src (0 base, 1 log).

    Each side's k best are taken first; of equal ids the base's stays, else the better ranked; then
    the order is score, side, rank on that side.
    """
    base = batch_search(index, queries, k).select("qid", "id", "score", F.lit(0).alias("src"), F.col("rank").alias("at"))
    delta = delta_knn(log, queries, k, index.spec.dim).select("qid", "id", "score", F.lit(1).alias("src"), F.col("rank").alias("at"))
    one = Window.partitionBy("qid", "id").orderBy("src", "at")
    rows = base.unionByName(delta).withColumn("n", F.row_number().over(one)).filter("n = 1")
    order = Window.partitionBy("qid").orderBy("score", "src", "at")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "rank", "id", "score", "src")


class Delta:
    """A log in a folder that all executors share: one Parquet part per append, one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, dim: int, flush_threshold: int) -> None:
        self.spark, self.path, self.dim, self.flush_threshold = spark, path.rstrip("/"), dim, flush_threshold
        self._append(spark.createDataFrame([], LOG_DDL))
        self._last: int | None = None

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG_DDL).parquet(self.path)

    def _append(self, rows: DataFrame) -> None:
        rows.select("seq", F.col("op").cast("tinyint").alias("op"), "id", "vector").write.mode("append").parquet(self.path)

    def _next(self, n: int) -> int:
        """The first of the next n sequence numbers. The log is looked at once, when it is opened; there is one writer."""
        if self._last is None:
            self._last = self.log().agg(F.max("seq")).first()[0] or 0
        self._last += n
        return self._last - n + 1

    def insert(self, records: DataFrame) -> None:
        """records: id, vector, in the order of id. All vectors must have the index's length."""
        rows = records.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
        if not rows.filter(F.col("vector").isNull() | (F.size("vector") != self.dim)).isEmpty():
            raise ValueError(f"every vector must have {self.dim} values")
        rows = numbered(rows, "id")
        self._append(rows.select((F.col("row_idx") + self._next(rows.count())).alias("seq"), F.lit(INSERT).alias("op"), "id", "vector"))

    def delete_rows(self, ids: DataFrame) -> DataFrame:
        """Hides all live entries of the ids in a frame, of any size; which of them had any: id."""
        found = live(self.log()).select("id").join(ids.select(F.col("id").cast("long").alias("id")), "id", "left_semi").distinct()
        found = numbered(found, "id")
        self._append(found.select((F.col("row_idx") + self._next(found.count())).alias("seq"), F.lit(DELETE).alias("op"), "id", F.lit(None).cast("array<float>").alias("vector")))
        return found.select("id")

    def delete(self, ids: list[int]) -> list[int]:
        """The same for a list of ids."""
        asked = self.spark.createDataFrame([(int(i),) for i in ids], "id long")
        return sorted(r[0] for r in self.delete_rows(asked).collect())

    def size(self) -> int:
        return live(self.log()).count()

    def total(self) -> int:
        return self.log().filter(F.col("op") == INSERT).count()

    def needs_flush(self) -> bool:
        return self.size() >= self.flush_threshold

    def backup(self, path: str) -> None:
        live(self.log()).select("seq", "id", "vector").write.mode("overwrite").parquet(path)

    @classmethod
    def restore(cls, spark: SparkSession, path: str, target: str, dim: int, flush_threshold: int) -> Delta:
        """A buffer in target with the entries of a backup."""
        out = cls(spark, target, dim, flush_threshold)
        out._append(spark.read.parquet(path).withColumn("op", F.lit(INSERT)))
        out._last = None
        return out

    def drain(self) -> DataFrame:
        """The live entries, stored; the log goes on in a new folder, empty."""
        rows = stored(live(self.log()), "drained")
        self.path = f"{self.path.split('@')[0]}@{uuid.uuid4().hex}"
        self._append(self.spark.createDataFrame([], LOG_DDL))
        self._last = None
        return rows

    def flush(self, index: Index) -> Index:
        """The index with all live entries added as rows; the log is drained."""
        rows = build(self.drain(), index.spec, order_by="seq")
        more = Index(rows, index.spec, index.weights, index.budget)
        return concatenated([index, more])
