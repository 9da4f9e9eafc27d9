"""Best-fit packing by patterns.

Texts become token ids, and texts beyond a sequence's length are cut into pieces. How many pieces
have each length is a histogram of as many bins as a sequence has places, whatever the corpus.
Patterns of two or three lengths that fill a sequence exactly are enumerated, and non-negative
least squares fits how often each is used to the histogram. The counts are rounded, and what is left
of the histogram is fitted again; the few pieces that then remain are packed by best fit, again as
patterns with counts. The plan is a small table: of each length, which run of its pieces goes to which sequences and where. Pieces of a
length are numbered in parallel and look their place up.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratavec.llm.arrays import batch
from stratavec.llm.bpe import byte_characters, groups_of
from stratavec.llm.rows import keyed
from stratavec.session import partitions, ready, stored

CAPACITY = 1024
END = 2
STEPS = 300
ROUNDS = 4
ONCE = 0.05
#: The byte-level pattern, without backtracking: where a run of letters, digits or signs ends, no shorter one is tried.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: From this length on, runs of white space are set apart before the pattern is asked: its stack has a bound.
LONG_RUN = 1 << 16


class ByteBpe:
    """Encoder for a byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_characters().items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(back.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.coder = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.runs, self.special = regex.compile(rf"\p{{White_Space}}{{{LONG_RUN},}}+"), tuple(special)

    def ids(self, text: str) -> bytes:
        return self.coder.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()

    def parts(self, text: str) -> Iterator[str]:
        """The text, cut around long runs of white space; the last of a run belongs to what follows, but not to a special token."""
        at = 0
        for m in self.runs.finditer(text):
            end = m.end() if m.end() == len(text) or text.startswith(self.special, m.end()) else m.end() - 1
            yield text[at : m.start()]
            yield text[m.start() : end]
            at = end
        yield text[at:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        return [self.ids(t) if len(t) < LONG_RUN else b"".join(map(self.ids, self.parts(t))) for t in texts]


_LOADED: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


PIECES = {"key": pa.int64(), "doc_id": pa.int64(), "copies": pa.int32(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}


def cut_task(path: str, capacity: int, end: int, with_ids: bool):
    """Task over key, doc_id, copies, text: the pieces of each text; only the first of a long text may be shorter."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, last = load(path), np.uint32(end).tobytes()
        for b in batches:
            done = [i + last for some in groups_of(b.column(3)) for i in coder.encode(some)]
            rows: list[tuple] = []
            for key, doc, copies, ids in zip(*(b.column(i).to_pylist() for i in range(3)), done, strict=True):
                n = len(ids) // 4
                ends = range(n % capacity or capacity, n + 1, capacity) if n > capacity else (n,)
                at = 0
                for k, e in enumerate(ends):
                    part = ids[4 * at : 4 * e]
                    rows.append((key, doc, copies, k, at, e - at, zlib.crc32(part), part if with_ids else None))
                    at = e
            yield batch(PIECES, *zip(*rows, strict=True) if rows else [[]] * len(PIECES))

    return task


def patterns(capacity: int, histogram: np.ndarray) -> list[tuple[int, ...]]:
    """All twos and threes of present lengths that fill a sequence exactly: at most about capacity squared / 12."""
    present = np.flatnonzero(histogram).tolist()
    have = set(present)
    out: list[tuple[int, ...]] = [(a, capacity - a) for a in present if 2 * a <= capacity and capacity - a in have]
    for k, a in enumerate(present):
        if 3 * a > capacity:
            break
        out += [(a, b, capacity - a - b) for b in present[k : bisect_right(present, (capacity - a) // 2)] if capacity - a - b in have]
    return out


def least_squares(histogram: np.ndarray, places: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """How often each pattern is used, not below zero, with the least sum of squared differences to the histogram, a length's difference weighing as its tokens.

    places: a row of lengths for each pattern, 0 where it has fewer. Accelerated projected gradients
    with restarts.
    """
    weight = np.arange(len(histogram)) / (len(histogram) - 1)
    pieces = lambda t: sum(np.bincount(column, t, len(histogram)) for column in places.T)
    back = lambda rest: (weight * rest)[places].sum(1)  # noqa: E731 - length 0 weighs nothing
    v = np.ones(len(places))
    for _ in range(30):  # the largest eigenvalue, by the power method
        v = back(pieces(v))
        size = float(np.linalg.norm(v))
        v /= size
    times, point, speed = np.zeros(len(places)), np.zeros(len(places)), 1.0
    for _ in range(steps):
        new = np.maximum(0.0, point - back(pieces(point) - histogram) / (1.02 * size))
        if ((point - new) * (new - times)).sum() > 0:
            speed = 1.0
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        point, times, speed = new + (speed - 1) / faster * (new - times), new, faster
    return times


def rounded(left: list[int], found: list[tuple[int, ...]], once: float) -> list[tuple[tuple[int, ...], int]]:
    """A least squares fit of patterns to a histogram as whole counts, the most used first, so that no length is used up twice.

    Counts are rounded down, and those from once to 1 stand for one.
    """
    if not found:
        return []
    times = least_squares(np.array(left), np.array([p + (0,) * (3 - len(p)) for p in found]))
    have, out = list(left), []
    for i in np.argsort(-times, kind="stable").tolist():
        if times[i] < once:
            break
        p = found[i]
        n = min(max(1, int(times[i])), *(have[x] // p.count(x) for x in p))
        if n:
            out.append((p, n))
            for x in p:
                have[x] -= n
    return out


def fitted(histogram: np.ndarray, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], list[int]]:
    """Patterns with counts, and what they leave of the histogram for best fit.

    What a fit leaves is fitted again, up to ROUNDS times. A round after which more sequences would
    be needed in all is not taken, and is the last.
    """
    used, left = [], histogram.astype(np.int64).tolist()
    least = sum(n for _, n in best_fit(list(left), capacity))
    for k in range(ROUNDS):
        more = rounded(left, patterns(capacity, np.array(left)), ONCE if k else 1.0)
        rest = list(left)
        for p, n in more:
            for x in p:
                rest[x] -= n
        needed = sum(n for _, n in used + more) + sum(n for _, n in best_fit(list(rest), capacity))
        if not more or needed > least:
            break
        used, left, least = used + more, rest, needed
    return used, left


def best_fit(left: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with counts for all of a histogram: the largest length first, with what fills its sequence best."""
    out = []
    present = [x for x in range(1, capacity + 1) if left[x]]
    while present:
        used = [present[-1]]
        room = capacity - used[0]
        while room:
            count = lambda x: left[x] - used.count(x)  # noqa: B023, E731
            if room <= capacity and left[room] and count(room) > 0:
                used.append(room)
                break
            pair = next((x for x in present[: bisect_right(present, room // 2)] if room - x > 0 and left[room - x] and count(x) > (room - x == x) and count(room - x) > 0), 0)
            if pair:
                used += [pair, room - pair]
                break
            fits = next((x for x in reversed(present[: bisect_right(present, room)]) if count(x) > 0), 0)
            if not fits:
                break
            used.append(fits)
            room -= fits
        times = min(left[x] // used.count(x) for x in set(used))
        out.append((tuple(used), times))
        for x in used:
            left[x] -= times
        present = [x for x in present if left[x]]
    return out


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Rows length, first piece of that length, how many, first sequence, offset: the place of every piece."""
    full = int(histogram[capacity])
    lower = histogram.copy()
    lower[capacity] = 0
    used, left = fitted(lower, capacity)
    used += best_fit(left, capacity)
    if full:
        used.append(((capacity,), full))
    rows, taken, sequence = [], [0] * (capacity + 1), 0
    for p, n in used:
        at = 0
        for x in p:
            rows.append((x, taken[x], n, sequence, at))
            taken[x] += n
            at += x
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


PLACED = {"sequence_id": pa.int64(), "offset": pa.int64()}


def place_task(table: np.ndarray, columns: int):
    """Task over rows that end with length and number: the sequence and offset of each, beside the other columns."""
    firsts = (table[:, 0] << 44) + table[:, 1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = (b.column(columns + i).to_numpy() for i in range(2))
            row = table[np.searchsorted(firsts, (length << 44) + number, "right") - 1]
            names = b.schema.names[:columns]
            yield pa.RecordBatch.from_arrays([*b.columns[:columns], pa.array(row[:, 3] + number - row[:, 1]), pa.array(row[:, 4])], names=[*names, *PLACED])

    return task


def best_fit_pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with_ids adds ids.

    path: a byte-level vocabulary file that every executor has. Every text, null as empty, ends with
    the id end, so an empty one is a piece of one token. Rows with a null doc_id, or that repeat
    one, are documents of their own. Sequences have at most capacity tokens (below 2^15), without
    gaps. An empty table gives an empty result. Other columns are ignored.
    """
    ready(docs.sparkSession)
    texts, _ = keyed(docs, id_col, text_col)
    buckets = partitions(texts)
    pieces = texts.select("key", "doc_id", "copies", "text").mapInArrow(cut_task(path, capacity, end, with_ids), "key long, doc_id long, copies int, piece int, start long, length long, ids_crc32 long, ids binary")
    pieces = stored(pieces.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), "pieces").withColumn("bucket", F.pmod(F.xxhash64("key", "piece"), F.lit(buckets)))
    counts = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most capacity rows
        histogram[length] = n
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    order = Window.partitionBy("length", "bucket").orderBy("key", "piece", "copy")
    rows = pieces.withColumn("rank", F.row_number().over(order)).join(before, ["length", "bucket"])
    out = ["doc_id", "piece", "start", "ids_crc32", *["ids"] * with_ids]
    rows = rows.select(*out, F.col("length").alias("size"), "length", (F.col("before") + F.col("rank") - 1).alias("number"))
    ddl = "doc_id long, piece int, start long, ids_crc32 long" + ", ids binary" * with_ids + ", length long, sequence_id long, offset long"
    placed = rows.mapInArrow(place_task(plan(histogram, capacity), len(out) + 1), ddl)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
