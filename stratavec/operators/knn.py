"""Top-k search: a scan of codes with bounded per-task results, then reranking of the candidates.

The query batch is an argument of the call, so it is held by the driver and sent to the tasks with
the plan. Each task keeps the best candidates of its own rows, packed as one value for each query, so
what is shuffled is at most tasks x queries x candidates, by query. Codes of inactive tiers and the
half vectors aren't read by the scan. The candidates, of which there are at most queries x max(100,
3k), go back to the tasks to be reranked while they have at most CANDIDATE_BYTES: the positions that
they lie between are pushed down to the payload, which is stored in the order of positions, and only
their rows leave the JVM. Beyond that size they are joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratavec.functions.distance import score
from stratavec.functions.spec import FLOAT, ONE_BIT, IndexSpec
from stratavec.functions.transform import codes, encode, matrix, rotate, unpack_words
from stratavec.session import ready, stored
from stratavec.sources.index import Index

LEAST_CANDIDATES = 100
ROWS = 1 << 14
PACKED = "qid long, found binary"
SCANNED = "qid long, row_idx long, code_dist double"
CANDIDATE_BYTES = 64 << 20
QUERY_BYTES = 64 << 20
RANGES = 64
SPARSE = 4
INT_MAX = 2147483647


@dataclass
class Queries:
    """A batch at hand."""

    ids: np.ndarray
    vectors: np.ndarray


def collect_queries(queries: DataFrame | np.ndarray, dim: int) -> Queries:
    """queries: an array of rows, or a frame of qid and qvec, which must fit in QUERY_BYTES."""
    found = blocks(queries, dim)
    if len(found) != 1:
        raise ValueError(f"a batch of over {QUERY_BYTES} bytes must be asked in blocks")
    return found[0] if isinstance(found[0], Queries) else _collected(found[0].collect(), dim)


def _collected(rows: list, dim: int) -> Queries:
    rows = sorted(rows, key=lambda r: r[0])
    return Queries(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float32).reshape(-1, dim))


def blocks(queries: DataFrame | np.ndarray, dim: int) -> list[Queries | DataFrame]:
    """The batch as it is if it fits in QUERY_BYTES, else frames that each do, dealt by the hash of qid."""
    if isinstance(queries, Queries):
        return [queries]
    if not isinstance(queries, DataFrame):
        return [Queries(np.arange(len(queries), dtype=np.int64), np.asarray(queries, np.float32).reshape(-1, dim))]
    most = max(1, QUERY_BYTES // (4 * dim))
    rows = queries.select(F.col("qid").cast("long").alias("qid"), F.col("qvec").cast("array<float>").alias("qvec"))
    found = rows.limit(most + 1).collect()
    if len(found) <= most:
        return [_collected(found, dim)]
    n = -(-2 * rows.count() // most)  # blocks of half the size, as hashes deal unevenly
    return [rows.filter(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) for i in range(n)]


def ones(words: np.ndarray) -> np.ndarray:
    """Bits set in signed words; numpy would count those of the magnitude."""
    return np.bitwise_count(words.view(np.uint64)).astype(np.int32)


def _distances(columns: list[np.ndarray], spec: IndexSpec, query: dict[str, np.ndarray], z: np.ndarray, names: list[str]) -> Iterator[np.ndarray]:
    """Scan distances of a chunk of rows, a query at a time."""
    if spec.q_mode == FLOAT:
        rows = np.concatenate(columns, 1).astype(np.float64)
        for one in z[:, : rows.shape[1]]:
            yield np.trunc(np.minimum(((rows - one) ** 2).sum(1) * 1000, INT_MAX))
    elif spec.q_mode == ONE_BIT and spec.dim <= 32:
        rows = np.where(unpack_words(columns, spec), 1.0, -1.0)
        for one in z:
            yield np.trunc(np.minimum(((rows - one) ** 2).sum(1) * 1000, INT_MAX))
    elif spec.q_mode == ONE_BIT:
        words, asked, n = [c.view(np.uint64) for c in columns], [query[n].view(np.uint64) for n in names], len(columns[0])
        total, bits, count = np.empty(n, np.uint16), np.empty(n, np.uint64), np.empty(n, np.uint8)
        for i in range(len(z)):
            for k, (c, q) in enumerate(zip(words, asked, strict=True)):
                np.bitwise_count(np.bitwise_xor(c, q[i], out=bits), out=count)
                np.add(total, count, out=total) if k else np.copyto(total, count)
            yield total
    else:
        half = len(names) // 2
        for i in range(len(z)):
            total = np.zeros(len(columns[0]), np.int32)
            for s, m, sn, mn in zip(columns[:half], columns[half:], names[:half], names[half:], strict=True):
                qs, qm = query[sn][i], query[mn][i]
                total += 4 * ones(m & qm & (s ^ qs)) + ones(m ^ qm)
            yield total


class Best:
    """The best rows of one query by (distance, row), from chunk to chunk. Rows beyond the bound that the kept ones set aren't looked at again, and nothing is sorted before the end."""

    def __init__(self, keep: int) -> None:
        self.keep, self.bound, self.size, self.rows, self.distances = keep, np.inf, 0, [], []

    def add(self, row: np.ndarray, d: np.ndarray) -> None:
        if self.size < self.keep <= len(d):
            self.bound = min(self.bound, self._kth(d))
        near = np.flatnonzero(d <= self.bound)
        if len(near):
            self.rows.append(row[near])
            self.distances.append(d[near])
            self.size += len(near)
            if self.size > 4 * self.keep:
                self._cut()

    def _kth(self, d: np.ndarray) -> float:
        if d.dtype == np.uint16:  # few values: counted, not sorted
            return int(np.searchsorted(np.cumsum(np.bincount(d)), self.keep))
        return np.partition(d, self.keep - 1)[self.keep - 1]

    def _cut(self) -> None:
        rows, d = np.concatenate(self.rows), np.concatenate(self.distances)
        self.bound = self._kth(d)
        near = d <= self.bound
        self.rows, self.distances = [rows[near]], [d[near]]
        self.size = int(near.sum())

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.rows:
            return np.zeros(0, np.int64), np.zeros(0)
        row, d = np.concatenate(self.rows), np.concatenate(self.distances).astype(np.float64)
        order = np.lexsort((row, d))[: self.keep]
        return row[order], d[order]


def scan_task(spec: IndexSpec, names: list[str], queries: Queries, keep: int):
    """Task over row_idx and code columns: for each query the best rows of the task by (distance, row_idx)."""
    z = rotate(queries.vectors, spec)
    query = {k: v for k, v in codes(z, spec).items() if k in names} if spec.q_mode != FLOAT else {}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(keep) for _ in queries.ids]
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                row = part.column(0).to_numpy()
                if spec.q_mode == FLOAT:
                    columns = [matrix(c, spec.widths[i]) for i, c in enumerate(part.columns[1:])]
                else:
                    columns = [c.to_numpy() for c in part.columns[1:]]
                for i, d in enumerate(_distances(columns, spec, query, z, names)):
                    best[i].add(row, d)
        yield _packed(queries.ids, [b.found() for b in best])

    return task


def _packed(ids: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A row for each query that has found any: its positions, then their distances."""
    rows = [(q, row.astype(np.int64).tobytes() + d.astype(np.float64).tobytes()) for q, (row, d) in zip(ids, best, strict=True) if len(row)]
    return pa.RecordBatch.from_arrays([pa.array([q for q, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["qid", "found"])


def _unpacked(found: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(found, np.int64, len(found) // 16), np.frombuffer(found, np.float64, offset=len(found) // 2)


def merge_task(keep: int):
    """Task over qid, found of whole queries: the best of all tasks, by (distance, position)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for q, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(q, []).append(_unpacked(found))
        best = []
        for parts in held.values():
            row, d = map(np.concatenate, zip(*parts, strict=True))
            order = np.lexsort((row, d))[:keep]
            best.append((row[order], d[order]))
        yield _packed(np.array(list(held), np.int64), best)

    return task


def scan(index: Index, queries: Queries, keep: int, last_tier: int | None = None, live_only: bool = True) -> DataFrame:
    """The keep best live rows of each query by (code distance, position): qid, found (packed)."""
    ready(index.rows.sparkSession)
    names = index.spec.code_columns(index.last_tier if last_tier is None else last_tier)
    rows = index.rows.filter("is_live") if live_only else index.rows
    found = rows.select("row_idx", *names).mapInArrow(scan_task(index.spec, names, queries, keep), PACKED)
    return found.repartition("qid").mapInArrow(merge_task(keep), PACKED)


@dataclass
class Candidates:
    """Pairs of a query (its place in the batch) and a position, in the order of positions."""

    row: np.ndarray
    query: np.ndarray
    distance: np.ndarray


def candidates_of(found: DataFrame, queries: Queries) -> Candidates:
    place = {int(q): i for i, q in enumerate(queries.ids)}
    parts = [(place[r[0]], *_unpacked(bytes(r[1]))) for r in found.collect()]  # at most CANDIDATE_BYTES
    row = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])
    order = np.argsort(row, kind="stable")
    query = np.concatenate([np.zeros(0, np.int64), *(np.full(len(p[1]), p[0]) for p in parts)])
    return Candidates(row[order], query[order], np.concatenate([np.zeros(0), *(p[2] for p in parts)])[order])


def between(column: str, values: np.ndarray, most: int = RANGES):
    """A condition that the sorted values meet: at most so many ranges, with the widest gaps left out."""
    if not len(values):
        return F.expr("false")
    gaps = np.diff(values)
    cuts = np.sort(np.argsort(gaps, kind="stable")[::-1][: most - 1])
    cuts = cuts[gaps[cuts] > 1]
    ranges = zip(values[np.r_[0, cuts + 1]].tolist(), values[np.r_[cuts, len(values) - 1]].tolist(), strict=True)
    return F.expr(" OR ".join(f"({column} BETWEEN {a} AND {b})" for a, b in ranges))


def candidate_rows(index: Index, found: Candidates, *names: str) -> DataFrame:
    """row_idx, id and the named columns of the candidates' rows, and of a few others where candidates are dense. Their ranges of positions are pushed down to the scan."""
    source = index.payload if index.payload is not None and set(names) <= set(index.payload.columns) else index.rows
    some = np.unique(found.row)
    rows = source.select("row_idx", "id", *names).filter(between("row_idx", some))
    if len(some) * SPARSE > (some[-1] - some[0] if len(some) else 0):
        return rows  # mostly candidates: the task leaves out the rest
    side = index.rows.sparkSession.createDataFrame(pa.table({"row_idx": pa.array(some, pa.int64())}))
    return rows.join(F.broadcast(side), "row_idx", "left_semi")


def rerank_candidates(spec: IndexSpec, half: bool, queries: Queries, found):
    """Task over row_idx, id and the half vector or all codes of candidates' rows: each pair's exact or asymmetric distance. found: a broadcast of Candidates."""
    z = rotate(queries.vectors, spec)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Candidates = found.value
        for b in batches:
            for at in range(0, b.num_rows, 1 << 12):
                part = b.slice(at, 1 << 12)
                row = part.column(0).to_numpy()
                first, last = (np.searchsorted(pairs.row, row, side) for side in ("left", "right"))
                n = last - first
                which = np.repeat(np.arange(len(row)), n)
                pair = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                query = pairs.query[pair]
                values = matrix(part.column(2), spec.dim) if half else code_values(part.columns[2:], spec)
                d = (queries.vectors[query] - values[which]).astype(np.float64) if half else z[query][:, : spec.tiers[-1]] - values[which][:, : spec.tiers[-1]]
                columns = [pa.array(queries.ids[query]), part.column(0).take(pa.array(which)), pa.array(pairs.distance[pair]), part.column(1).take(pa.array(which)), pa.array(np.einsum("ij,ij->i", d, d))]
                yield pa.RecordBatch.from_arrays(columns, names=["qid", "row_idx", "code_dist", "id", "dist"])

    return task


def code_values(columns: list[pa.Array], spec: IndexSpec) -> np.ndarray:
    """Codes as the values that they stand for."""
    words = [c.to_numpy() for c in columns]
    if spec.q_mode == ONE_BIT:
        return np.where(unpack_words(words, spec), 1.0, -1.0)
    n = len(words) // 2
    return unpack_words(words[n:], spec) * np.where(unpack_words(words[:n], spec), 1.0, -1.0)


def unpack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over qid, found: a row for each candidate."""
    for b in batches:
        for q, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            row, d = _unpacked(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), q)), pa.array(row), pa.array(d)], names=["qid", "row_idx", "code_dist"])


def rerank_task(spec: IndexSpec, names: list[str], half: bool, queries: Queries):
    """Task over qid, row_idx, code_dist, id and the half vector or all codes: the exact or asymmetric distance."""
    z, place = rotate(queries.vectors, spec), {int(q): i for i, q in enumerate(queries.ids)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.array([place[q] for q in b.column(0).to_pylist()], int)
            if half:
                d = (queries.vectors[at] - matrix(b.column(4), spec.dim)).astype(np.float64)
            else:
                values, last = code_values(b.columns[4:], spec), spec.tiers[-1]
                d = z[at][:, :last] - values[:, :last]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array((d * d).sum(1))], names=["qid", "row_idx", "code_dist", "id", "dist"])

    return task


def candidate_count(k: int) -> int:
    return max(LEAST_CANDIDATES, 3 * k)


def batch_search(index: Index, queries: DataFrame | np.ndarray, k: int, candidates: int | None = None, use_half: bool = True, pad: bool = False) -> DataFrame:
    """The k nearest rows of each query: qid, rank, id, score, dist, row_idx.

    Candidates are ordered by (code distance, row_idx) and results by (rerank distance, code
    distance, row_idx). Float mode isn't reranked and scores 0. Without queries, rows, or a positive
    k, the result is empty; pad gives rows of id -1 and the largest score for what is missing.
    """
    parts = blocks(queries, index.spec.dim)
    if len(parts) > 1:
        return reduce(DataFrame.unionByName, [stored(batch_search(index, p, k, candidates, use_half, pad), "found") for p in parts])
    asked = collect_queries(parts[0], index.spec.dim)
    spark = index.rows.sparkSession
    keep = 0 if k <= 0 else candidates or candidate_count(k)
    if not len(asked.ids) or keep == 0:
        return spark.createDataFrame([], "qid long, rank int, id long, score int, dist double, row_idx long")
    exact = index.spec.q_mode == FLOAT
    keep = k if exact else keep
    half = use_half and index.has_half
    names = [] if exact else ["vec_h"] if half else index.spec.code_columns()
    near, few = scan(index, asked, keep), 16 * len(asked.ids) * keep <= CANDIDATE_BYTES
    if few:
        pairs = candidates_of(near, asked)
        rows = candidate_rows(index, pairs, *names)
    else:
        near = near.mapInArrow(unpack_task, SCANNED)
        rows = (index.whole() if half else index.rows).select("row_idx", "id", *names).join(near, "row_idx")
    if exact:
        near = spark.createDataFrame(pa.table({"qid": asked.ids[pairs.query], "row_idx": pairs.row, "code_dist": pairs.distance})) if few else near
        rows = rows.join(F.broadcast(near), "row_idx") if few else rows
        order = Window.partitionBy("qid").orderBy("code_dist", "row_idx")
        found = rows.withColumn("rank", F.row_number().over(order)).select("qid", "rank", "id", F.lit(0).alias("score"), F.col("code_dist").alias("dist"), "row_idx")
    else:
        ddl = "qid long, row_idx long, code_dist double, id long, dist double"
        if few:
            ranked = rows.mapInArrow(rerank_candidates(index.spec, half, asked, spark.sparkContext.broadcast(pairs)), ddl)
        else:
            ranked = rows.select("qid", "row_idx", "code_dist", "id", *names).mapInArrow(rerank_task(index.spec, names, half, asked), ddl)
        order = Window.partitionBy("qid").orderBy("dist", "code_dist", "row_idx")
        found = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found = found.select("qid", "rank", "id", score(F.col("dist")).alias("score"), "dist", "row_idx")
    return padded_results(found, asked.ids, k) if pad else found


def search(index: Index, query: np.ndarray, k: int) -> DataFrame:
    """A batch of one."""
    return batch_search(index, np.asarray(query).reshape(1, -1), k)


def padded_results(found: DataFrame, ids: np.ndarray, k: int) -> DataFrame:
    """found with a row for each query and rank up to k."""
    spark = found.sparkSession
    every = spark.createDataFrame([(int(q),) for q in ids], "qid long").withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return every.join(found, ["qid", "rank"], "left").select("qid", "rank", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(INT_MAX)).alias("score"), "dist", "row_idx")


def exact_task(queries: Queries, dim: int, keep: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(keep) for _ in queries.ids]
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                row, x = part.column(0).to_numpy(), matrix(part.column(1), dim).astype(np.float64)
                for i, q in enumerate(queries.vectors.astype(np.float64)):
                    best[i].add(row, ((x - q) ** 2).sum(1))
        for i, (row, d) in enumerate(b.found() for b in best):
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), queries.ids[i])), pa.array(row), pa.array(d)], names=["qid", "id", "dist"])

    return task


def exact_knn(records: DataFrame, queries: DataFrame | np.ndarray, k: int, dim: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Exact neighbours by squared distance of raw vectors, ties by id: qid, rank, id, dist."""
    ready(records.sparkSession)
    parts = blocks(queries, dim)
    if len(parts) > 1:
        return reduce(DataFrame.unionByName, [stored(exact_knn(records, p, k, dim, id_col, vector_col), "found") for p in parts])
    asked = collect_queries(parts[0], dim)
    found = records.select(F.col(id_col).cast("long"), vector_col).mapInArrow(exact_task(asked, dim, k), "qid long, id long, dist double")
    order = Window.partitionBy("qid").orderBy("dist", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "rank", "id", "dist")


def row_profile(index: Index, queries: DataFrame | np.ndarray, nth: int) -> DataFrame:
    """Each row's Hamming distances to all queries, summed up without leaving its task: row_idx, id, least, most, and the nth smallest (null of fewer queries)."""
    ready(index.rows.sparkSession)
    parts, names = blocks(queries, index.spec.dim), index.spec.code_columns()
    if len(parts) > 1:  # how many queries are at each distance: as many rows as there are distances, of whatever batch
        counts = hamming_pairs(index, queries).groupBy("row_idx", "id", "dist").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("row_idx").orderBy("dist"))
        rows = counts.withColumn("upto", upto).groupBy("row_idx", "id")
        return rows.agg(F.min("dist").cast("long").alias("least"), F.max("dist").cast("long").alias("most"), F.min(F.when(F.col("upto") >= nth, F.col("dist"))).cast("long").alias("nth"))
    asked = collect_queries(parts[0], index.spec.dim)
    words = [codes(rotate(asked.vectors, index.spec), index.spec)[n].view(np.uint64) for n in names]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1 << 10):
                part = b.slice(at, 1 << 10)
                rows = [c.to_numpy().view(np.uint64) for c in part.columns[2:]]
                d = sum(np.bitwise_count(r[:, None] ^ q[None, :]).astype(np.int32) for r, q in zip(rows, words, strict=True))
                near = pa.array(np.partition(d, nth - 1, 1)[:, nth - 1].astype(np.int64)) if nth <= d.shape[1] else pa.nulls(len(d), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(d.min(1).astype(np.int64)), pa.array(d.max(1).astype(np.int64)), near], names=["row_idx", "id", "least", "most", "nth"])

    if not len(asked.ids):
        none = F.lit(None).cast("long")
        return index.rows.select("row_idx", "id", none.alias("least"), none.alias("most"), none.alias("nth"))
    return index.rows.select("row_idx", "id", *names).mapInArrow(task, "row_idx long, id long, least long, most long, nth long")


def hamming_pairs(index: Index, queries: DataFrame | np.ndarray, beside: tuple[str, ...] = ()) -> DataFrame:
    """Every query against every row, by the bits that differ: qid, row_idx, id, dist, and columns beside them. Queries are the broadcast side while they fit in QUERY_BYTES."""
    names = index.spec.code_columns()
    parts = blocks(queries, index.spec.dim)
    if len(parts) > 1:  # too large to be sent along: encoded where it is, and met part by part
        spec = replace(index.spec, half=False)
        side = encode(queries.select(F.col("qid").cast("long").alias("qid"), F.col("qvec").cast("array<float>").alias("vector")), spec)
        side = stored(side.select("qid", *(F.col(n).alias(f"q_{n}") for n in names)), "query-codes")
    else:
        asked = collect_queries(parts[0], index.spec.dim)
        words = codes(rotate(asked.vectors, index.spec), index.spec)
        side = index.rows.sparkSession.createDataFrame([(int(q), *(int(words[n][i]) for n in names)) for i, q in enumerate(asked.ids)], ", ".join(["qid long", *(f"q_{n} long" for n in names)]))
        side = F.broadcast(side)
    distance = sum((F.bit_count(F.col(n).bitwiseXOR(F.col(f"q_{n}"))) for n in names[1:]), F.bit_count(F.col(names[0]).bitwiseXOR(F.col(f"q_{names[0]}"))))
    return index.rows.select("row_idx", "id", *beside, *names).crossJoin(side).select("qid", "row_idx", "id", distance.alias("dist"), *beside)
