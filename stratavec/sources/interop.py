"""Binary files of vector tools: index headers and columns, operation logs, delta dumps, .fvecs / .ivecs and .npy.

Codecs work on bytes. Files of fixed-size rows are split among tasks by Spark's own reader of binary
records; logs go through the binaryFile source, a file per row, as their rows differ in size.
"""

from __future__ import annotations

import io
import math
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.functions.spec import FLOAT, IndexSpec, UnsupportedLayout
from stratavec.session import ready

#: The header's layout (little-endian, unaligned) and the record kinds of a log (big-endian).
HEADER = struct.Struct("<4sbqqii8ibxx")
MAGIC = b"PLAN"
INSERT, DELETE = 1, 2


def header_bytes(spec: IndexSpec, rows: int) -> bytes:
    tiers = [*spec.tiers, *[0] * (8 - len(spec.tiers))]
    return HEADER.pack(MAGIC, spec.planet_id, rows, spec.radius, spec.dim, len(spec.tiers), *tiers, spec.q_mode)


def parse_header(raw: bytes, half: bool = False) -> tuple[IndexSpec, int]:
    """The spec and the number of rows."""
    if len(raw) < HEADER.size:
        raise UnsupportedLayout("a header has 64 bytes")
    magic, planet, rows, radius, dim, n, *rest = HEADER.unpack(raw[: HEADER.size])
    if magic != MAGIC:
        raise UnsupportedLayout("no index header")
    return IndexSpec(dim, tuple(rest[:n]), rest[8], half, planet, radius), rows


def longs(raw: bytes) -> np.ndarray:
    """An ids or metadata file."""
    return np.frombuffer(raw, "<i8")


def tier_bytes(columns: list[np.ndarray], q_mode: int) -> bytes:
    """A tier's file from its columns: words row by row (all sign words of a row before its mask words), or floats."""
    rows = np.concatenate(columns, 1) if q_mode == FLOAT else np.stack(columns, 1)
    return rows.astype("<f4" if q_mode == FLOAT else "<i8").tobytes()


def parse_tier(raw: bytes, width: int, q_mode: int) -> list[np.ndarray]:
    """The columns of a tier's file: one matrix of floats, or a column per word."""
    if q_mode == FLOAT:
        return [np.frombuffer(raw, "<f4").reshape(-1, width)]
    words = -(-width // 64) * (2 if q_mode else 1)
    return list(np.frombuffer(raw, "<i8").reshape(-1, words).T)


def half_bytes(vectors: np.ndarray) -> bytes:
    return np.asarray(vectors, np.float32).astype("<f2").tobytes()


def parse_half(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<f2").reshape(-1, dim).astype(np.float32)


def log_bytes(operations: Iterable[tuple[int, int, list[float] | None]]) -> bytes:
    """Operations (kind, id, vector) in log form."""
    out = io.BytesIO()
    for kind, key, vector in operations:
        out.write(struct.pack(">bq", kind, key))
        if kind == INSERT:
            out.write(np.asarray(vector, ">f4").tobytes())
    return out.getvalue()


def parse_log(raw: bytes, dim: int) -> Iterator[tuple[int, int, int, list[float] | None]]:
    """seq, kind, id, vector of each whole record; reading stops at a torn or unknown one."""
    at, seq = 0, 0
    while at + 9 <= len(raw):
        kind, key = struct.unpack_from(">bq", raw, at)
        at += 9
        vector = None
        if kind == INSERT:
            if at + 4 * dim > len(raw):
                return
            vector = np.frombuffer(raw, ">f4", dim, at).astype(np.float32).tolist()
            at += 4 * dim
        elif kind != DELETE:
            return
        seq += 1
        yield seq, kind, key, vector


def dump_bytes(rows: Iterable[tuple[int, list[float]]], dim: int) -> bytes:
    """A delta dump of (id, vector)."""
    found = list(rows)
    return struct.pack(">ii", dim, len(found)) + b"".join(struct.pack(">q", i) + np.asarray(v, ">f4").tobytes() for i, v in found)


def parse_dump(raw: bytes) -> tuple[int, list[tuple[int, list[float]]]]:
    dim, n = struct.unpack_from(">ii", raw)
    row = np.dtype([("id", ">i8"), ("vector", ">f4", (dim,))])
    return dim, [(int(r["id"]), r["vector"].astype(np.float32).tolist()) for r in np.frombuffer(raw, row, n, 8)]


def vecs_bytes(rows: np.ndarray) -> bytes:
    """.fvecs of floats, .ivecs of whole numbers."""
    rows = np.asarray(rows)
    kind = "<f4" if rows.dtype.kind == "f" else "<i4"
    return np.concatenate([np.full((len(rows), 1), rows.shape[1], "<i4").view("<i4"), rows.astype(kind).view("<i4")], 1).tobytes()


def parse_vecs(raw: bytes, floats: bool = True) -> np.ndarray:
    if not raw:
        return np.zeros((0, 0), np.float32 if floats else np.int32)
    dim = int(np.frombuffer(raw, "<i4", 1)[0])
    rows = np.frombuffer(raw, "<i4").reshape(-1, dim + 1)
    if (rows[:, 0] != dim).any():
        raise UnsupportedLayout("rows of different lengths")
    body = np.ascontiguousarray(rows[:, 1:])
    return body.view("<f4") if floats else body


def npy_bytes(rows: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, rows, allow_pickle=False)
    return out.getvalue()


def parse_npy(raw: bytes) -> np.ndarray:
    return np.load(io.BytesIO(raw), allow_pickle=False)


def _files(spark: SparkSession, path: str, decode, schema: str) -> DataFrame:
    """Rows of all files at a path, by a function of their bytes; a file is one task's work."""
    ready(spark)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield decode(name, raw)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(task, schema)


def read_vecs(spark: SparkSession, path: str, floats: bool = True) -> DataFrame:
    """path, row (from 0 in its file), vector of .fvecs or .ivecs files. A single file is split among tasks; of several, each is one task's work."""
    kind = pa.float32() if floats else pa.int32()
    files = [(r[0], r[1]) for r in spark.read.format("binaryFile").load(path).select("path", "length").take(2)]
    if len(files) == 1 and files[0][1]:
        dim = int(np.frombuffer(spark.sparkContext.binaryRecords(path, 4).first(), "<i4")[0])
        rows = _decoded(records(spark, path, 4 + 4 * dim), {"vector": pa.list_(kind)}, f"vector array<{'float' if floats else 'int'}>", lambda raw, n: [list(parse_vecs(raw, floats))])
        return rows.select(F.lit(files[0][0]).alias("path"), "row", "vector")

    def decode(name: str, raw: bytes) -> pa.RecordBatch:
        rows = parse_vecs(raw, floats)
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(np.arange(len(rows))), pa.array(list(rows), pa.list_(kind))], names=["path", "row", "vector"])

    return _files(spark, path, decode, f"path string, row long, vector array<{'float' if floats else 'int'}>")


def read_log(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """path, seq, op, id, vector of binary operation logs."""

    def decode(name: str, raw: bytes) -> pa.RecordBatch:
        rows = list(parse_log(raw, dim))
        columns = [[r[i] for r in rows] for i in range(4)]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int8()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.list_(pa.float32()))], names=["path", "seq", "op", "id", "vector"])

    return _files(spark, path, decode, "path string, seq long, op tinyint, id long, vector array<float>")


def records(spark: SparkSession, path: str, size: int) -> DataFrame:
    """row (from 0), raw: the rows of one file of rows of a fixed size. The file is split among tasks, whatever its length."""
    ready(spark)
    found = spark.sparkContext.binaryRecords(path, size).zipWithIndex()
    return spark.createDataFrame(found.map(lambda r: (r[1], bytearray(r[0]))), "row long, raw binary")


def _decoded(rows: DataFrame, fields: dict[str, pa.DataType], ddl: str, decode) -> DataFrame:
    """row and the columns that decode makes of the bytes of many rows, one after another."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = decode(b"".join(b.column(1).to_pylist()), b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True))], names=["row", *fields])

    return rows.mapInArrow(task, f"row long, {ddl}")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """row, vector of a two-dimensional .npy file of floats in row order. Only its header goes through the driver.

    Rows are read as records that divide both the header's and a row's length, and put together
    again by row where these are shorter than a row.
    """
    raw = b"".join(spark.sparkContext.binaryRecords(path, 64).take(16))
    head = io.BytesIO(raw)
    version = np.lib.format.read_magic(head)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if fortran or len(shape) != 2 or kind.kind != "f":
        raise UnsupportedLayout("a matrix of floats in row order is needed")
    before, width = head.tell(), shape[1] * kind.itemsize
    if not shape[0] or not width:
        return spark.createDataFrame([], "row long, vector array<float>")
    step = math.gcd(before, width)
    place = F.col("row") * step - before
    parts = records(spark, path, step).filter(place >= 0)
    if step == width:
        rows = parts.select((place / width).cast("long").alias("row"), "raw")
    else:
        parts = parts.select(F.floor(place / width).alias("row"), (place % width).alias("k"), "raw")
        whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.hex("raw").alias("raw")))), lambda x: x["raw"]), "")
        rows = parts.groupBy("row").agg(F.unhex(whole).alias("raw"))
    return _decoded(rows, {"vector": pa.list_(pa.float32())}, "vector array<float>", lambda raw, n: [list(np.frombuffer(raw, kind).reshape(n, -1).astype(np.float32))])


def read_columns(spark: SparkSession, ids: str, meta: str, tiers: list[str], spec: IndexSpec, half: str | None = None) -> DataFrame:
    """Index rows from column files, joined by position; each file is split among tasks."""
    whole = lambda name: ({name: pa.int64()}, f"{name} long", lambda raw, n: [longs(raw)])
    rows = _decoded(records(spark, ids, 8), *whole("id")).join(_decoded(records(spark, meta, 8), *whole("meta")), "row")
    at = 0
    for k, (path, width) in enumerate(zip(tiers, spec.widths, strict=True)):
        words = -(-width // 64)
        if spec.q_mode == FLOAT:
            names, size, kind, ddl = [f"t{k}"], 4 * width, pa.list_(pa.float32()), "array<float>"
        else:
            names, kind, ddl = [f"{c}{i}" for c in ("sm" if spec.q_mode else "w") for i in range(at, at + words)], pa.int64(), "long"
            size = 8 * len(names)
        found = _decoded(
            records(spark, path, size), dict.fromkeys(names, kind), ", ".join(f"{n} {ddl}" for n in names),
            lambda raw, n, w=width, q=spec.q_mode: [list(parse_tier(raw, w, q)[0])] if q == FLOAT else [np.ascontiguousarray(c) for c in parse_tier(raw, w, q)],
        )
        rows, at = rows.join(found, "row"), at + words
    if half:
        rows = rows.join(_decoded(records(spark, half, 2 * spec.dim), {"vec_h": pa.list_(pa.float32())}, "vec_h array<float>", lambda raw, n, d=spec.dim: [list(parse_half(raw, d))]), "row")
    names = [*spec.code_columns(), *["vec_h"] * bool(half)]
    return rows.select(F.col("row").alias("row_idx"), "id", "meta", (F.col("meta").bitwiseAND(F.lit(1)) == 0).alias("is_live"), *names)
