"""The engine: named indexes and their delta buffers behind one object."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from stratavec.functions.spec import IndexSpec
from stratavec.functions.transform import encode
from stratavec.operators import knn, voting
from stratavec.operators.delta import Delta, search_merged
from stratavec.session import ready, shared_folder
from stratavec.sources import index as indexes


class NotInitialized(RuntimeError):
    """The engine is closed."""


class IndexNotFound(KeyError):
    """No index, or no delta buffer, of that name."""


class InvalidOperation(ValueError):
    """Arguments that make no sense."""


class Engine:
    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.open = ready(spark), True
        self.indexes: dict[str, indexes.Index] = {}
        self.deltas: dict[str, Delta] = {}

    def _index(self, name: str) -> indexes.Index:
        if not self.open:
            raise NotInitialized
        if name not in self.indexes:
            raise IndexNotFound(name)
        return self.indexes[name]

    def _delta(self, name: str) -> Delta:
        self._index(name)
        if name not in self.deltas:
            raise IndexNotFound(f"{name} has no delta buffer")
        return self.deltas[name]

    def compile_index(self, records: DataFrame, path: str, spec: IndexSpec, **columns) -> None:
        indexes.compile_index(records, path, spec, **columns)

    def load_index(self, name: str, path: str, weights: np.ndarray | None = None) -> indexes.Index:
        """Replaces an index of that name."""
        if not self.open:
            raise NotInitialized
        if name in self.indexes:
            self.indexes[name].rows.unpersist()
        self.indexes[name] = indexes.load_index(self.spark, path, weights)
        return self.indexes[name]

    def register(self, name: str, index: indexes.Index) -> None:
        self.indexes[name] = index

    def info(self, name: str) -> dict:
        return self._index(name).info()

    def size(self, name: str) -> int:
        """All rows, deleted ones included."""
        return self._index(name).size()

    def batch_search(self, name: str, queries: DataFrame | np.ndarray, k: int, **options) -> DataFrame:
        return knn.batch_search(self._index(name), queries, k, **options)

    def search(self, name: str, query: np.ndarray, k: int) -> DataFrame:
        return knn.search(self._index(name), query, k)

    def query_grid(self, name: str, queries: DataFrame, k_vote: int = voting.VOTES, gates: bool = True) -> tuple[DataFrame, int]:
        """The masks of all rows, and how many rows have votes of k_vote families."""
        masks = voting.query_grid(self._index(name), queries, gates)
        return masks, voting.resonant(masks, k_vote).first()["resonant"]

    #: There is no device here; the same plans run.
    cuda_batch_search = batch_search
    cuda_query_grid = query_grid

    def cuda_available(self) -> bool:
        return False

    def tier_column(self, name: str, tier: int) -> DataFrame:
        """row_idx and the code columns of one tier."""
        index = self._index(name)
        before = set(index.spec.code_columns(tier - 1)) if tier else set()
        return index.rows.select("row_idx", *[c for c in index.spec.code_columns(tier) if c not in before])

    def ids(self, name: str) -> DataFrame:
        return self._index(name).rows.select("row_idx", "id")

    def metadata(self, name: str) -> DataFrame:
        return self._index(name).rows.select("row_idx", "meta")

    def encode(self, records: DataFrame, spec: IndexSpec, vector_col: str = "vector") -> DataFrame:
        return encode(records, spec, vector_col)

    def set_partitions(self, name: str, n: int) -> None:
        if n <= 0:
            raise InvalidOperation("a positive number of partitions is needed")
        index = self._index(name)
        index.rows = index.rows.repartition(n)

    def set_energy_budget(self, name: str, budget: float) -> None:
        if not 0 < budget <= 1:
            raise InvalidOperation("an energy budget is above 0 and at most 1")
        self._index(name).budget = budget

    def tombstone_base(self, name: str, condition) -> None:
        self.indexes[name] = indexes.tombstoned(self._index(name), condition)

    def create_delta(self, name: str, flush_threshold: int = 10_000, path: str | None = None) -> Delta:
        """A buffer for an index; a path that has a log already goes on with it."""
        index = self._index(name)
        self.deltas[name] = Delta(self.spark, path or f"{shared_folder(self.spark)}/delta-{uuid.uuid4().hex}", index.spec.dim, flush_threshold)
        return self.deltas[name]

    def insert(self, name: str, records: DataFrame) -> None:
        self._delta(name).insert(records)

    def delete(self, name: str, ids: list[int]) -> list[int]:
        return self._delta(name).delete(ids)

    def delete_rows(self, name: str, ids: DataFrame) -> DataFrame:
        """delete() for a frame of ids of any size."""
        return self._delta(name).delete_rows(ids)

    def delta_size(self, name: str) -> int:
        return self._delta(name).size()

    def needs_flush(self, name: str) -> bool:
        return self._delta(name).needs_flush()

    def search_merged(self, name: str, queries: DataFrame | np.ndarray, k: int) -> DataFrame:
        index = self._index(name)
        return search_merged(index, self._delta(name).log(), queries, k) if name in self.deltas else knn.batch_search(index, queries, k)

    def backup_delta(self, name: str, path: str) -> None:
        self._delta(name).backup(path)

    def restore_delta(self, name: str, path: str, flush_threshold: int = 10_000) -> Delta:
        index = self._index(name)
        self.deltas[name] = Delta.restore(self.spark, path, f"{shared_folder(self.spark)}/delta-{uuid.uuid4().hex}", index.spec.dim, flush_threshold)
        return self.deltas[name]

    def flush(self, name: str) -> None:
        self.indexes[name] = self._delta(name).flush(self._index(name))

    def compact(self, paths: list[str], target: str) -> None:
        indexes.compact(self.spark, paths, target)

    def drop(self, name: str) -> None:
        self._index(name).rows.unpersist()
        del self.indexes[name]
        self.deltas.pop(name, None)

    def close(self) -> None:
        for name in list(self.indexes):
            self.drop(name)
        self.open = False
