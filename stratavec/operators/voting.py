"""Voting by query families: a row's mask has a family's bit set if one of its queries is near enough. Map-only, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavec.functions.distance import hamming, ternary
from stratavec.functions.spec import FLOAT, ONE_BIT, UnsupportedLayout
from stratavec.functions.transform import codes, matrix, rotate
from stratavec.operators.knn import ROWS, blocks, collect_queries
from stratavec.session import ready
from stratavec.sources.index import Index

FAMILIES = 8
VOTES = 5
LITERAL_TERMS = 256
CHUNK = 1 << 13


@dataclass
class Votes:
    """A batch that is at hand already: vectors, and each one's family and threshold."""

    vectors: np.ndarray
    families: list[int]
    thresholds: list[int]


def _batch(queries: DataFrame | Votes, dim: int):
    if isinstance(queries, Votes):
        return collect_queries(queries.vectors, dim), queries.families, queries.thresholds
    found = sorted(queries.select("qid", "qvec", "family", "threshold").collect(), key=lambda r: r["qid"])
    asked = collect_queries(np.array([r["qvec"] for r in found], np.float32).reshape(-1, dim), dim)
    return asked, [r["family"] for r in found], [r["threshold"] for r in found]


def _gate(names: list[str]) -> Column:
    """The row's word 0 has its highest bit set; with masks, that dimension is active too."""
    return (F.col("w0") < 0) if "w0" in names else (F.col("s0") < 0) & (F.col("m0") < 0)


def _near(words: list[tuple[np.ndarray, ...]], query: list[tuple[np.ndarray, ...]], i: int, most: int, room: tuple[np.ndarray, ...]) -> np.ndarray | None:
    """Which rows are within most of query i; None if no row is. Distances only grow, so a chunk is left as soon as all its rows are beyond."""
    total, bits, count = (x[: len(words[0][0])] for x in room)
    for k, (row, q) in enumerate(zip(words, query, strict=True)):
        if len(row) == 1:
            np.bitwise_count(np.bitwise_xor(row[0], q[0][i], out=bits), out=count)
            np.copyto(total, count) if k == 0 else np.add(total, count, out=total)
        else:
            np.bitwise_and(np.bitwise_xor(row[0], q[0][i], out=bits), row[1] & q[1][i], out=bits)
            one = 4 * np.bitwise_count(bits).astype(np.uint16) + np.bitwise_count(row[1] ^ q[1][i])
            np.copyto(total, one) if k == 0 else np.add(total, one, out=total)
        if (k % 2 or k + 1 == len(words)) and int(total.min()) > most:
            return None
    return total <= most


def _vote_task(spec, names: list[str], query: dict[str, np.ndarray], families: list[int], thresholds: list[int]):
    half = len(names) if spec.q_mode == ONE_BIT else len(names) // 2
    pairs = [(n,) if spec.q_mode == ONE_BIT else (n, m) for n, m in zip(names, names[half:] or names, strict=False)][:half]
    asked = [tuple(query[n].view(np.uint64) for n in p) for p in pairs]
    turns = [(family, [i for i, f in enumerate(families) if f == family and thresholds[i] >= 0]) for family in range(FAMILIES)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = np.empty(CHUNK, np.uint16), np.empty(CHUNK, np.uint64), np.empty(CHUNK, np.uint8)
        for b in batches:
            columns = {n: b.column(2 + i).to_numpy().view(np.uint64) for i, n in enumerate(names)}
            mask = np.zeros(b.num_rows, np.int32)
            for at in range(0, b.num_rows, CHUNK):
                some = slice(at, at + CHUNK)
                words = [tuple(columns[n][some] for n in p) for p in pairs]
                for family, batch in turns:
                    hit = np.zeros(len(words[0][0]), bool)
                    for i in batch:
                        near = _near(words, asked, i, thresholds[i], room)
                        if near is not None:
                            hit |= near
                    mask[some][hit] |= 1 << family
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(mask)], names=["row_idx", "id", "mask"])

    return task


def query_grid(index: Index, queries: DataFrame | Votes, gates: bool = True) -> DataFrame:
    """queries: qid, qvec, family, threshold; or the same as Votes. A row per index row: row_idx, id, mask (0 to 255), votes.

    Rows that are deleted, or whose code has bit 63 unset, get mask 0 unless gates is False.
    Families outside 0 to 7 contribute nothing. A few queries become one expression that stays in
    generated code; many go through numpy.
    """
    spec = index.spec
    if spec.q_mode == FLOAT:
        raise UnsupportedLayout("voting needs binary codes")
    ready(index.rows.sparkSession)
    if isinstance(queries, DataFrame) and len(parts := blocks(queries, spec.dim)) > 1:
        each = [query_grid(index, queries.join(p.select("qid"), "qid", "left_semi"), gates) for p in parts]
        rows = reduce(DataFrame.unionByName, each).groupBy("row_idx", "id").agg(F.bit_or("mask").alias("mask"))
        return rows.withColumn("votes", F.bit_count("mask"))
    asked, families, thresholds = _batch(queries, spec.dim)
    names = spec.code_columns(index.last_tier if gates else None)
    query = codes(rotate(asked.vectors, spec), spec)
    open_ = (F.col("is_live") & _gate(names)) if gates else F.lit(True)
    if len(families) * len(names) <= LITERAL_TERMS:
        terms = []
        for i, (family, most) in enumerate(zip(families, thresholds, strict=True)):
            if not 0 <= family < FAMILIES:
                continue
            rows, literals = [F.col(n) for n in names], [F.lit(int(query[n][i])) for n in names]
            half = len(names) // 2
            d = hamming(rows, literals) if spec.q_mode == ONE_BIT else ternary(rows[:half], rows[half:], literals[:half], literals[half:])
            terms.append(F.when(d <= most, F.lit(1 << family)).otherwise(F.lit(0)))
        mask = reduce(lambda a, b: a.bitwiseOR(b), terms, F.lit(0))
        out = index.rows.select("row_idx", "id", F.when(open_, mask).otherwise(F.lit(0)).alias("mask"))
    else:
        rows = index.rows.filter(open_).select("row_idx", "id", *names)
        out = rows.mapInArrow(_vote_task(spec, names, query, families, thresholds), "row_idx long, id long, mask int")
        if gates:  # closed rows don't leave the JVM
            out = out.unionByName(index.rows.filter(~open_).select("row_idx", "id", F.lit(0).alias("mask")))
    return out.withColumn("votes", F.bit_count("mask"))


def resonant(masks: DataFrame, votes: int = VOTES) -> DataFrame:
    """One row: resonant (rows with at least so many families) and nonzero (rows with any)."""
    return masks.agg(F.count_if(F.col("votes") >= votes).alias("resonant"), F.count_if(F.col("mask") != 0).alias("nonzero"))


def radius_vote(records: DataFrame, queries: DataFrame, dim: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The same vote by exact squared distance, at most 4 x threshold / dim: id, mask, votes."""
    ready(records.sparkSession)
    if isinstance(queries, DataFrame) and len(parts := blocks(queries, dim)) > 1:
        each = [radius_vote(records, queries.join(p.select("qid"), "qid", "left_semi"), dim, id_col, vector_col) for p in parts]
        rows = reduce(DataFrame.unionByName, each).groupBy("id").agg(F.bit_or("mask").alias("mask"))
        return rows.withColumn("votes", F.bit_count("mask"))
    asked, families, thresholds = _batch(queries, dim)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                x, mask = matrix(part.column(1), dim).astype(np.float64), np.zeros(part.num_rows, np.int32)
                for q, family, most in zip(asked.vectors.astype(np.float64), families, thresholds, strict=True):
                    if 0 <= family < FAMILIES:
                        mask |= (((x - q) ** 2).sum(1) <= 4.0 * most / dim).astype(np.int32) << family
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(mask)], names=["id", "mask"])

    out = records.select(F.col(id_col).cast("long").alias("id"), vector_col).mapInArrow(task, "id long, mask int")
    return out.withColumn("votes", F.bit_count("mask"))
