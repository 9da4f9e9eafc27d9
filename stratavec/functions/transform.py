"""The orthogonal transform and the codes: matrices on the driver, batches of rows in numpy, and twins as SQL expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavec.functions.spec import FLOAT, ONE_BIT, IndexSpec
from stratavec.session import ready

ACTIVE_FROM = np.float32(0.20)


def hadamard(n: int) -> np.ndarray:
    """The normalised Sylvester matrix of a power of two."""
    i = np.arange(n)
    return (1.0 - 2.0 * (np.bitwise_count(i[:, None] & i[None, :]) % 2)) / np.sqrt(n)


def cosine(n: int) -> np.ndarray:
    """The orthonormal type-II discrete cosine transform."""
    k, j = np.arange(n)[:, None], np.arange(n)[None, :]
    out = np.sqrt(2.0 / n) * np.cos(np.pi * (2 * j + 1) * k / (2 * n))
    out[0] = np.sqrt(1.0 / n)
    return out


def block(width: int) -> np.ndarray:
    """The rotation of one tier: Hadamard for a power of two, else Hadamard times cosine."""
    u = width & -width
    return hadamard(width) if u == width else np.kron(hadamard(u), cosine(width // u))


def rotation(spec: IndexSpec) -> np.ndarray:
    """The matrix R of the whole transform: z = R x, signs included. Dimensions past the last tier are only signed."""
    out, low = np.eye(spec.dim), 0
    for high in spec.tiers:
        out[low:high, low:high] = block(high - low)
        low = high
    return out * np.array(spec.signs)[None, :]


def rotate(x: np.ndarray, spec: IndexSpec) -> np.ndarray:
    return np.asarray(x, np.float64) @ rotation(spec).T


def back_project(z: np.ndarray, spec: IndexSpec) -> np.ndarray:
    """The inverse of rotate(): the matrix is orthogonal."""
    return np.asarray(z, np.float64) @ rotation(spec)


def pack_words(bits: np.ndarray, spec: IndexSpec) -> list[np.ndarray]:
    """Bits of all dimensions as signed 64-bit words, the lowest bit first."""
    out = []
    for _, a, b in spec.words:
        part = np.zeros((len(bits), 64), np.uint8)
        part[:, : b - a] = bits[:, a:b]
        out.append(np.packbits(part, axis=1, bitorder="little").view("<i8").ravel())
    return out


def msb_bytes(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as bytes with the first bit highest, as analysis tools pack them; a last byte is filled with zeros."""
    return np.packbits(np.asarray(bits, bool), axis=1)


def unpack_words(words: list[np.ndarray], spec: IndexSpec) -> np.ndarray:
    out = np.zeros((len(words[0]), spec.dim), bool)
    for w, (_, a, b) in zip(words, spec.words, strict=False):
        out[:, a:b] = np.unpackbits(np.ascontiguousarray(w).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : b - a]
    return out


def threshold(z: np.ndarray) -> np.ndarray:
    """Per row the magnitude from which a dimension is active."""
    return np.sort(np.abs(z), axis=1)[:, int(np.float32(z.shape[1]) * ACTIVE_FROM)]


def codes(z: np.ndarray, spec: IndexSpec) -> dict[str, np.ndarray | list]:
    """The code columns of rotated rows."""
    if spec.q_mode == FLOAT:
        return {f"t{k}": list(z[:, a:b].astype(np.float32)) for k, (a, b) in enumerate(zip((0, *spec.tiers), spec.tiers, strict=False))}
    sign = z >= 0
    if spec.q_mode == ONE_BIT:
        return {f"w{i}": w for i, w in enumerate(pack_words(sign, spec))}
    active = np.abs(z) >= threshold(z)[:, None]
    return {f"s{i}": w for i, w in enumerate(pack_words(sign & active, spec))} | {f"m{i}": w for i, w in enumerate(pack_words(active, spec))}


def to_half(x: np.ndarray) -> np.ndarray:
    """Rounded to half precision, ties to even, as floats; what rounds to zero has no sign, as in half() and the SQL."""
    return np.asarray(x, np.float32).astype(np.float16).astype(np.float32) + np.float32(0)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """An array column as rows of floats; wrong lengths and nulls are errors."""
    if column.null_count or len(column.flatten()) != len(column) * dim or (len(column) and set(column.value_lengths().to_pylist()) != {dim}):
        raise ValueError(f"every vector must have {dim} values")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)


def code_fields(spec: IndexSpec) -> list[T.StructField]:
    kind = T.ArrayType(T.FloatType()) if spec.q_mode == FLOAT else T.LongType()
    out = [T.StructField(c, kind) for c in spec.code_columns()]
    return out + ([T.StructField("vec_h", T.ArrayType(T.FloatType()))] if spec.half else [])


def encode(df: DataFrame, spec: IndexSpec, vector_col: str = "vector") -> DataFrame:
    """df without vector_col, with the code columns (and the half vector) in its place."""
    ready(df.sparkSession)
    rest = [c for c in df.columns if c != vector_col]
    schema = T.StructType([df.schema[c] for c in rest] + code_fields(spec))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(len(rest)), spec.dim)
            out = codes(rotate(x, spec), spec)
            columns = [pa.array(v, pa.list_(pa.float32()) if spec.q_mode == FLOAT else pa.int64()) for v in out.values()]
            if spec.half:
                columns.append(pa.array(list(to_half(x)), pa.list_(pa.float32())))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names=schema.names)

    return df.select(*rest, vector_col).mapInArrow(task, schema)


def rotated(df: DataFrame, spec: IndexSpec, vector_col: str = "vector", inverse: bool = False) -> DataFrame:
    """df with vector_col rotated (or rotated back), as doubles."""
    ready(df.sparkSession)
    rest = [c for c in df.columns if c != vector_col]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(vector_col, T.ArrayType(T.DoubleType()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(len(rest)).flatten().to_numpy(zero_copy_only=False).reshape(-1, spec.dim)
            z = back_project(x, spec) if inverse else rotate(x, spec)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(list(z), pa.list_(pa.float64()))], names=schema.names)

    return df.select(*rest, vector_col).mapInArrow(task, schema)


# SQL twins, for single tiers of a power of two and for reading codes


def signed(x: Column, spec: IndexSpec) -> Column:
    """x with the transform's signs."""
    return F.zip_with(x, F.array(*map(F.lit, spec.signs)), lambda a, s: a * s)


def walsh(x: Column, width: int) -> Column:
    """The normalised Walsh-Hadamard transform of an array of a power of two."""
    sign = lambda i, j: 1 - 2 * (F.bit_count(i.bitwiseAND(j)) % 2)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(F.transform(x, lambda v, j: v * sign(i, j)), F.lit(0.0), lambda a, v: a + v) / F.lit(float(np.sqrt(width))))


def sign_word(z: Column, low: int = 0, high: int = 64) -> Column:
    """The word of the signs of z[low:high]."""
    bits = F.sequence(F.lit(0), F.lit(high - low - 1))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.when(F.get(z, i + low) >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))


def active_threshold(z: Column, dim: int) -> Column:
    """The magnitude from which a dimension of z is active."""
    return F.get(F.sort_array(F.transform(z, lambda v: F.abs(v))), F.lit(int(np.float32(dim) * ACTIVE_FROM)))


def half(x: Column) -> Column:
    """A value rounded to half precision, ties to even."""
    ulp = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)) - 10)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.bround(x / ulp) * ulp).cast("float")


def unpacked(word: Column, width: int = 64) -> Column:
    """A word's bits as +1 and -1."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (2 * F.call_function("getbit", word, i) - 1).cast("double"))


def normalised(x: Column) -> Column:
    """x over its length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(x, lambda v: v / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def padded(x: Column, width: int = 64) -> Column:
    """x with zeros up to width."""
    return F.concat(x, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(width) - F.size(x), F.lit(0))))


def oriented(x: np.ndarray, spec: IndexSpec, bit: int = 63) -> np.ndarray:
    """Rows turned round where their code's bit would be 0."""
    z = rotate(x, spec)[:, bit]
    return np.where((z < 0)[:, None], -x, x)
