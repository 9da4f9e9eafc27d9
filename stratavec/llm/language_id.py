"""Language identification by string kernels: blended-spectrum presence kernels, Nystroem landmarks, kernel ridge regression.

A text is the set of its character 1-, 2- and 3-grams (letters lower-cased, all else as a space),
hashed into a fixed number of places. The kernel of two texts is the size of the intersection over
the root of both sizes' product. Landmarks are a bounded sample of the labelled texts; the
Nystroem map from a text's kernels with them spans the space in which one ridge regression per
language is fitted, each against the rest. A batch of texts is scored by two matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratavec.llm.arrays import batch
from stratavec.session import pick, ready, stored

PLACES = 1 << 13
ORDERS = 3
LANDMARKS_EACH = 48
ROWS_EACH = 300
SPREAD = 4
LANGUAGES = 200
RIDGE = 1e-3
SHARPNESS = 6.0
UNKNOWN = "und"
ROWS = 128
CHUNK = 1 << 20
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    if not _LETTERS:
        table = np.full(0x110000, 32, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                table[cp] = ord(c.lower()[0])
        _LETTERS.append(table)
    return _LETTERS[0]


def presence(text: str | None, out: np.ndarray) -> bool:
    """Sets the places of the text's n-grams to 1 in out; whether it has letters."""
    table, any_letter = letters(), False
    for at in range(0, len(text or ""), CHUNK):
        points = table[np.frombuffer(text[at : at + CHUNK + ORDERS - 1].encode("utf-32-le", "surrogatepass"), np.uint32)]
        any_letter = any_letter or bool((points != 32).any())
        grams = np.zeros(len(points), np.uint32)
        for n in range(min(ORDERS, len(points))):
            grams = (grams[: len(points) - n] + points[n:]) * FACTORS[n]
            out[((grams ^ (grams >> np.uint32(15))) * FACTORS[0]) >> np.uint32(32 - PLACES.bit_length() + 1)] = 1
    return any_letter


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.maximum(a.sum(1), 1))[:, None] * np.sqrt(np.maximum(b.sum(1), 1))[None, :]
    return (a @ b.T) / size


class Model:
    """Landmarks, and a column of weights on their kernels for each language."""

    def __init__(self, x: np.ndarray, langs: list[str], landmarks: np.ndarray) -> None:
        """x: presence rows of labelled texts; landmarks: which of them are."""
        self.langs = sorted(set(langs))
        self.landmarks = x[landmarks]
        self.weights = np.zeros((len(self.landmarks), len(self.langs)), np.float32)
        if len(self.langs):
            values, vectors = np.linalg.eigh(_kernel(self.landmarks, self.landmarks).astype(np.float64))
            root = vectors / np.sqrt(np.maximum(values, 1e-6))
            z = _kernel(x, self.landmarks) @ root
            y = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
            weight = (1 / np.maximum((y > 0).sum(0), 1))[np.argmax(y, 1)]
            weight = weight[:, None] / weight.mean()
            beta = np.linalg.solve(z.T @ (z * weight) + RIDGE * len(x) * np.eye(z.shape[1]), z.T @ (y * weight))
            self.weights = (root @ beta).astype(np.float32)

    def margins(self, texts: list[str | None]) -> tuple[np.ndarray, list[bool]]:
        """The one-versus-rest value of each text and language, around 1 for a language's own texts however many there are, and which texts have letters."""
        x = np.zeros((len(texts), PLACES), np.float32)
        known = [presence(t, row) for row, t in zip(x, texts, strict=True)]
        return _kernel(x, self.landmarks) @ self.weights, known

    def told(self, texts: list[str | None], least: float) -> list[bool]:
        """Whether a text has letters and a language with a margin of at least so much. A single language has no rest to be told from: letters do."""
        if not self.langs:
            return [False] * len(texts)
        f, known = self.margins(texts)
        if len(self.langs) == 1:
            return known
        return (np.array(known, bool) & (f.max(1) >= least)).tolist()

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        f, known = self.margins(texts)
        f = SHARPNESS * f.astype(np.float64)
        p = np.exp(f - f.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [(self.langs[k], float(p[i, k])) if known[i] else (UNKNOWN, 0.0) for i, k in enumerate(best)]


def bits_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over lang, rank, text: the presence of each whole text as bits."""
    for b in batches:
        bits = []
        for t in b.column(2).to_pylist():
            presence(t, row := np.zeros(PLACES, np.uint8))
            bits.append(np.packbits(row).tobytes())
        yield batch({"lang": pa.string(), "rank": pa.int32(), "bits": pa.binary()}, b.column(0), b.column(1), bits)


def fit(rows: DataFrame) -> Model:
    """rows: doc_id, text, lang. At most ROWS_EACH different texts of each of LANGUAGES languages, those with the smallest hash of doc_id and text, so that no order matters.

    How many different ones there are, about, tells below which hash a few times as many lie, so that
    few rows are ranked however many there are; rows that repeat doc_id, text and language are one, before they are ranked and
    again before they are collected.
    """
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("different")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    near = F.pmod("h", F.lit(1 << 31)) < F.lit(float(SPREAD * ROWS_EACH << 31)) / F.col("different")
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 31)), "h", "doc_id")
    ids = rows.select("lang", "doc_id", "h").join(F.broadcast(counts), "lang").filter(near).select("lang", "doc_id", "h").distinct()
    ids = stored(ids.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ROWS_EACH), "language-sample")
    chosen = rows.join(F.broadcast(ids), ["lang", "doc_id", "h"]).select("lang", "rank", "text").dropDuplicates(["lang", "rank"])
    found = sorted((r["lang"], r["rank"], r["bits"]) for r in chosen.mapInArrow(bits_task, "lang string, rank int, bits binary").collect())
    x = np.array([np.unpackbits(np.frombuffer(bits, np.uint8)) for *_, bits in found], np.float32).reshape(-1, PLACES)
    return Model(x, [lang for lang, *_ in found], np.array([i for i, (_, rank, _) in enumerate(found) if rank <= LANDMARKS_EACH], int))


RESULT = {"doc_id": pa.int64(), "held_out": pa.bool_(), "lang_pred": pa.string(), "score": pa.float64()}


def predict_task(model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                found = model.value.predict(part.column(2).to_pylist())
                yield batch(RESULT, part.column(0), part.column(1), [x for x, _ in found], [s for _, s in found])

    return task


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    rows = pick(docs, id_col, text_col, lang_col).toDF("doc_id", "text", "lang").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))


def _fitted(rows: DataFrame):
    known = rows.filter("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    return rows.sparkSession.sparkContext.broadcast(fit(known.select("doc_id", "text", "lang")))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Learns from texts with a known language whose crc32(doc_id) mod 4 is not 2: a bounded sample of
    them (see fit()); every whole text is predicted. Null texts and texts without letters are `und` with score 0, as is every text if
    nothing can be learned. A null doc_id is not held out and not learned from. Repeated rows each
    give their row; an empty table gives an empty result. Other columns are ignored.
    """
    ready(docs.sparkSession)
    rows = _rows(docs, id_col, text_col, lang_col)
    return rows.select("doc_id", "held_out", "text").mapInArrow(predict_task(_fitted(rows)), "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, min_margin: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, all columns as they are, whose one-versus-rest margin is at least min_margin for some language: near 1 for texts in it, near 0 for others."""
    ready(docs.sparkSession)
    model, at, names = _fitted(_rows(docs, id_col, text_col, lang_col)), docs.columns.index(text_col), docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, ROWS):
                part = b.slice(start, ROWS)
                yield part.filter(pa.array(model.value.told(part.column(at).to_pylist(), min_margin), pa.bool_()))

    return plain.mapInArrow(task, plain.schema).toDF(*names)
