"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of lexicon words (a short fixed list, and words and word
beginnings that a part of the labelled rows shows to be telling), how near they stand to the second
person, capitals, punctuation, and signs of obfuscation. Words that a worker doesn't know yet are
looked at together, a group of texts at a time; a text's features are sums over its words' rows. The labelled sample is split three ways:
one part for the lexicon, one for the trees, one for calibration.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.llm.arrays import batch
from stratavec.llm.boosting import Boosted, Isotonic
from stratavec.llm.bpe import groups
from stratavec.session import pick, ready, small, stored

SAMPLE = 12_000
LEXICON = 2_000
LEAST_TOXIC = 4
LEAST_RATIO = 2.0
NEAR_WORDS = 3
CACHE_ENTRIES = 250_000
BROADCAST_BYTES = 8 << 20
#: Insults, and words of the second person.
INSULTS = "idiot idiots stupid moron morons loser losers trash pathetic disgusting worthless clown clowns scum dumb fool fools ugly garbage filth filthy vermin disgrace hate shut imbecile creep jerk lame freak freaks liar liars"
SECOND_PERSON = "you your yours yourself yourselves du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes ti tuyo tuya vosotros"
OBFUSCATED = regex.compile(r"\p{L}[*@$!0-9#]+\p{L}|(\p{L})\1\1|\p{L}[._-]\p{L}[._-]\p{L}")
LETTERS = regex.compile(r"[^\p{L}\p{N}]+")
COLUMNS = ("fixed", "learned", "start", "weight", "second", "capitals", "all_caps", "bang", "question", "punctuation", "obfuscated", "digits", "letters", "length")
#: Bits of a character: looked up, upper case, letter, neither letter nor number, digit, may obfuscate inside a word.
SEEN, UPPER, ALPHA, OTHER, DIGIT, INNER = 1, 2, 4, 8, 16, 32
FEATURES = ("log_words", "log_fixed", "log_learned", "log_start", "near_second", "near_any", *COLUMNS)


def plain(word: str) -> str:
    return LETTERS.sub("", word).lower()


def items(word: str) -> list[str]:
    """What the lexicon knows a word by: itself, and its beginnings."""
    w = plain(word)
    return [w, *(f"{w[:n]}~" for n in (4, 5, 6) if len(w) > n)] if len(w) > 2 else []


class Scanner:
    """Features of texts, given the learned lexicon: item to log ratio."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon, self.insults, self.second = lexicon, set(INSULTS.split()), set(SECOND_PERSON.split())
        self.telling = {*lexicon, *self.insults, *self.second}
        self.starts = {i[:-1] for i in lexicon if i.endswith("~")}
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(COLUMNS)), np.float32)
        self.kinds = np.zeros(sys.maxunicode + 1, np.uint8)

    def _kinds(self, codes: np.ndarray) -> np.ndarray:
        """What each character is, as bits."""
        kinds = self.kinds[codes]
        if not kinds.all():
            for code in np.unique(codes[kinds == 0]).tolist():
                c = chr(code)
                self.kinds[code] = SEEN | UPPER * c.isupper() | ALPHA * c.isalpha() | OTHER * (not c.isalnum()) | DIGIT * c.isdigit() | INNER * (c in "*@$!0123456789#._-")
            kinds = self.kinds[codes]
        return kinds

    def _learn(self, words: list[str]) -> None:
        """Rows of words that have none, all at once."""
        if not words:
            return
        at = len(self.rows)
        if at + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(len(self.table), len(words)), len(COLUMNS)), np.float32)])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        size = np.fromiter(map(len, words), np.int64, len(words))
        first, kinds = np.cumsum(size) - size, self._kinds(codes)
        count = lambda mask: np.add.reduceat(mask, first, dtype=np.int64)
        upper, alpha, other = (count(kinds & bit != 0) for bit in (UPPER, ALPHA, OTHER))
        place = np.arange(len(codes)) - np.repeat(first, size)
        odd = (kinds & INNER != 0) & (place > 0) & (place < np.repeat(size, size) - 1)  # only words with one of these, or a character three times, can be obfuscated
        odd[2:] |= (codes[2:] == codes[1:-1]) & (codes[2:] == codes[:-2]) & (place[2:] >= 2)
        new = self.table[at : at + len(words)]
        new[:, :5] = 0
        new[:, 5:] = np.stack([upper, (alpha > 1) & (upper == alpha), count(codes == ord("!")), count(codes == ord("?")), other, np.zeros_like(size), count(kinds & DIGIT != 0), alpha, size], 1)
        for k in np.flatnonzero(count(odd)).tolist():
            new[k, 10] = bool(OBFUSCATED.search(words[k]))
        telling, starts = self.telling, self.starts
        for k, (word, mixed) in enumerate(zip(words, other.tolist(), strict=True)):
            w = plain(word) if mixed else word.lower()
            if w in telling or w[:4] in starts or w[:5] in starts or w[:6] in starts:
                known = items(word)
                weight = max((self.lexicon.get(i, 0.0) for i in known), default=0.0)
                new[k, :5] = (w in self.insults, w in self.lexicon, any(i in self.lexicon for i in known[1:]), weight, w in self.second)
        self.rows.update(zip(words, range(at, at + len(words)), strict=True))

    def _features(self, words: list[str]) -> np.ndarray:
        found = self.table[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))]
        total, n = found.sum(0, dtype=np.float64), max(1, len(words))
        near = 0
        if total[:3].any() and total[4]:
            hit, second = np.flatnonzero(found[:, :3].any(1)), np.flatnonzero(found[:, 4])
            k = np.searchsorted(second, hit)
            gap = np.minimum(np.abs(second[np.minimum(k, len(second) - 1)] - hit), np.abs(second[np.maximum(k - 1, 0)] - hit))
            near = int((gap <= NEAR_WORDS).sum())
        return np.array([np.log1p(len(words)), *np.log1p(total[:3]), near / n, float(near > 0), *(total / n)])

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text."""
        out = []
        for some in groups(texts):
            split = [t.split() for t in some]
            if len(self.rows) > CACHE_ENTRIES:
                self.rows.clear()
            self._learn(list(set().union(*split).difference(self.rows)))
            out += map(self._features, split)
        return np.array(out).reshape(-1, len(FEATURES))


class Model:
    def __init__(self, lexicon: dict[str, float], x: np.ndarray, y: np.ndarray, tuning: np.ndarray) -> None:
        self.lexicon = lexicon
        self.trees = Boosted().fit(x[~tuning], y[~tuning])
        self.curve = Isotonic(self.trees.margin(x[tuning]), y[tuning])
        self.scanner = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"scanner": None}

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.scanner is None:
            self.scanner = Scanner(self.lexicon)
        f = self.trees.margin(self.scanner.features(texts))
        return np.clip(self.curve(f) + 1e-6 * np.tanh(f / 10), 0.0, 1.0)


def item_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over text, toxic: in how many toxic and other texts each item stands."""
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for b in batches:
        for text, toxic in zip(*(c.to_pylist() for c in b.columns), strict=True):
            counts[toxic].update({i for w in set((text or "").split()) for i in items(w)})
    every = list({*counts[0], *counts[1]})
    for at in range(0, len(every), 50_000):
        some = every[at : at + 50_000]
        yield batch({"item": pa.string(), "t": pa.int64(), "c": pa.int64()}, some, [counts[1][i] for i in some], [counts[0][i] for i in some])


def feature_task(lexicon: dict[str, float]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon)
        for b in batches:
            yield batch({"fold": pa.int32(), "toxic": pa.int32(), "x": pa.list_(pa.float64())}, b.column(0), b.column(1), scanner.features(b.column(2).to_pylist()).tolist())

    return task


def fit(labelled: DataFrame) -> Model:
    """labelled: doc_id, text, toxic (0 or 1), at most SAMPLE rows, stored. A third each for lexicon, trees and calibration, by the hash of doc_id."""
    folded = labelled.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)).cast("int"))
    sizes = {(r["fold"], r["toxic"]): r["count"] for r in folded.groupBy("fold", "toxic").count().collect()}
    toxic, other = sizes.get((0, 1), 0), sizes.get((0, 0), 0)
    counts = folded.filter("fold = 0").select("text", "toxic").mapInArrow(item_task, "item string, t long, c long").groupBy("item").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    ratio = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (other + 1.0))
    top = counts.filter(F.col("t") >= LEAST_TOXIC).withColumn("r", ratio).filter(F.col("r") >= LEAST_RATIO).orderBy(F.desc("r"), F.desc("t"), "item").limit(LEXICON)
    lexicon = {r["item"]: float(r["r"]) for r in top.collect()}
    rows = folded.filter("fold > 0").select("fold", "toxic", "text").mapInArrow(feature_task(lexicon), "fold int, toxic int, x array<double>").collect()
    rows.sort()
    x = np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES))
    return Model(lexicon, x, np.array([r["toxic"] for r in rows], float), np.array([r["fold"] == 2 for r in rows], bool))


RESULT = {"doc_id": pa.int64(), "held_out": pa.bool_(), "score": pa.float64(), "predicted": pa.int32()}


def score_task(model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                score = model.value.score(part.column(2).to_pylist())
                yield batch(RESULT, part.column(0), part.column(1), score, (score >= 0.5).astype(np.int32))

    return task


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    labels: doc_id, toxic; of several labels of a document the largest counts, and nulls don't.
    Learns from labelled documents whose crc32(doc_id) mod 5 is not 0: at most SAMPLE of those that
    docs has, with the smallest hash of doc_id and text; rows that repeat both are one of them. Null and empty texts are scored as texts without words. A null
    doc_id is not held out and never labelled. Without labels of both kinds the score is the same
    for all. Repeated rows each give their row; an empty table gives an empty result. Other columns
    are ignored.
    """
    spark = ready(docs.sparkSession)
    held = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    known = pick(labels, "doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held(F.col("doc_id")))
    known = stored(known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "labelled")
    known = F.broadcast(known) if small(known, F.lit(16), BROADCAST_BYTES) else known
    hashed = rows.withColumn("h", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    chosen = hashed.select("doc_id", "h").join(known, "doc_id").distinct().orderBy("h", "doc_id").limit(SAMPLE)
    chosen = F.broadcast(stored(chosen, "labelled-sample"))
    labelled = hashed.join(chosen, ["doc_id", "h"]).select("doc_id", "h", "text", "toxic").dropDuplicates(["doc_id", "h"])
    labelled = stored(labelled.select("doc_id", "text", "toxic"), "labelled-texts")
    model = spark.sparkContext.broadcast(fit(labelled))
    return rows.select("doc_id", held(F.col("doc_id")).alias("held_out"), "text").mapInArrow(score_task(model), "doc_id long, held_out boolean, score double, predicted int")
