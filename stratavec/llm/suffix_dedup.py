"""Removal of repeated passages: a depth-limited radix sort of suffixes, by most-significant-digit passes.

Two suffixes need ordering only through the window length (100 bytes), since equal groups at that
depth are exactly the repeated windows; and a group of one leaves as soon as it is alone. Suffixes
travel in runs, and are sorted by their bytes, eight at a time:

1. Every window has an anchor: of the GRAM-byte strings in it, the one with the smallest hash, the
   leftmost of equals. The choice depends on the window's bytes alone, so equal windows have equal
   anchors at equal places. Consecutive windows mostly share their anchor, and travel as one run.
   Runs whose anchor no other run has leave here; a task sends one row for each anchor it has.
2. The bytes of the other runs meet by their anchor. Eight neighbouring windows share a core. The
   cores are sorted by most significant digits of eight bytes: each pass orders the groups that the
   passes before left together, and drops rows that stand alone. Where cores are equal, the few bytes
   beside the core are the last digits of each window. Equal windows are repeats but for the first.

Hashes choose anchors and tasks; what is equal is told from the bytes alone. Each task first sets
its own equal runs aside, after comparing their bytes, so a passage that a third of all documents
share arrives once from each. An anchor that so many different runs share that it is an eighth of
its bucket (at most eight a bucket are) is split: its windows go one by one, by their own hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.llm.arrays import KEEP, U64, batch, eight_hashes, eights, freeing, mix64, pack, sliced, split_by, unpack, utf8
from stratavec.llm.rows import keyed, repeated
from stratavec.session import partitions, ready, stored

WINDOW = 100
GRAM = 40
GROUP = 8
CHUNK = 1 << 19
FLUSH_BYTES = 1 << 22
PLACE_BITS = 24
HOT_RUNS = 1024
HOT_SHARE = 8
BLOBS = {"bucket": pa.int32(), "kind": pa.int32(), "blob": pa.binary()}
BLOBS_DDL = "bucket int, kind int, blob binary"
PARTIAL, REPEAT, RUN, HOT = 0, 1, 2, 3


class Roller:
    """Polynomial hashes of all slices of one length, to choose anchors by; nothing is told apart by them."""

    def __init__(self, size: int) -> None:
        base = 0x9E3779B97F4A7C15
        self.table = np.random.default_rng(20240607).integers(0, 1 << 64, 256, U64)
        self.powers = np.cumprod(np.r_[U64(1), np.full(size - 1, base, U64)])
        self.inverses = np.cumprod(np.r_[U64(1), np.full(size - 1, pow(base, -1, 1 << 64), U64)])

    def grams(self, data: np.ndarray, gram: int) -> np.ndarray:
        prefix = np.empty(len(data) + 1, U64)
        prefix[0] = 0
        np.cumsum(self.table[data] * self.powers[: len(data)], out=prefix[1:])
        return mix64((prefix[gram:] - prefix[:-gram]) * self.inverses[: len(data) - gram + 1])


_ROLLER: list[Roller] = []


def roller() -> Roller:
    if not _ROLLER:
        _ROLLER.append(Roller(CHUNK + 2048))
    return _ROLLER[0]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def _pieces(offsets: np.ndarray, window: int) -> Iterator[tuple[int, int, int, int]]:
    """Chunks of texts: (first text, text after the last, first window start, end of window starts), places in the data."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1
        if j > i:
            yield i, min(j, n), int(offsets[i]), int(offsets[min(j, n)])
            i = min(j, n)
        else:  # a long text in parts
            for at in range(int(offsets[i]), int(offsets[i + 1]), CHUNK):
                yield i, i + 1, at, min(at + CHUNK, int(offsets[i + 1]))
            i += 1


def runs_of(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each chunk's runs: text number, place in the data, windows but one, anchor's place from the first window."""
    roll = roller()
    for i, j, first, last in _pieces(offsets, window):
        end = min(int(offsets[j]), last + window - 1)
        part = data[first:end]
        if len(part) < window:
            continue
        grams = roll.grams(part, gram)
        low = U64((1 << PLACE_BITS) - 1)
        place = (grams & ~low) | np.arange(len(grams), dtype=U64)
        owner = (_sliding_min(place, window - gram + 1) & low).astype(np.int64)
        lo = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        hi = np.r_[lo[1:] - 1, len(owner) - 1]
        anchor = owner[lo]
        starts = np.maximum(offsets[i:j], first) - first
        ends = np.minimum(offsets[i + 1 : j + 1], end) - first
        text = np.searchsorted(starts, lo, "right") - 1
        text = np.where(lo > ends[text] - window, np.searchsorted(starts, hi, "right") - 1, text)
        lo, hi = np.maximum(lo, starts[text]), np.minimum(hi, ends[text] - window)
        ok = lo <= hi
        lo, hi, anchor, text = lo[ok], hi[ok], anchor[ok], text[ok]
        yield text + i, lo + first, hi - lo, anchor - lo


def _firsts(*digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """digits: most significant first. The order, and for each row in it whether any digit but the last two differs from the row before."""
    order = np.lexsort(digits[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for d in digits[:-2]:
        s = d[order]
        new[1:] |= s[1:] != s[:-1]
    return order, new


def _out(buckets: int, kind: int, key: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows for the documents with these keys, by a bucket of the key."""
    found = split_by((mix64(key.astype(U64)) % U64(buckets)).astype(np.int32), key, *columns)
    return batch(BLOBS, [b for b, _ in found], [kind] * len(found), [pack(*c) for _, c in found])


def _closer(key: np.ndarray) -> np.ndarray:
    """Keys in ascending order as differences, which compress better."""
    return np.diff(key, prepend=np.int64(0))


def _same_bytes(source: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the slices of these sizes at a and b are equal, eight bytes at a time."""
    same = np.ones(len(a), bool)
    left = np.arange(len(a))
    done = 0
    while len(left):
        keep = KEEP[np.minimum(size[left] - done, 8)]
        equal = (source[a[left] + done] & keep) == (source[b[left] + done] & keep)
        same[left[~equal]] = False
        done += 8
        left = left[equal & (size[left] > done)]
    return same


def set_aside(data: np.ndarray, key: np.ndarray, at: np.ndarray, place: np.ndarray, more: np.ndarray, to_anchor: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Which runs stay, and which are equal to one that stays and starts earlier. Equal runs are found by a hash and told by their bytes."""
    size = more + window
    order = np.lexsort((at, key, to_anchor, eight_hashes(data, place, size)))
    a, b = order[:-1], order[1:]
    same = (more[a] == more[b]) & (to_anchor[a] == to_anchor[b])
    near = np.flatnonzero(same)
    same[near] = _same_bytes(eights(data), place[a[near]], place[b[near]], size[a[near]])
    new = np.r_[True, ~same][: len(order)]
    return np.sort(order[new]), order[~new]


def anchor_codes(data: np.ndarray, place: np.ndarray, gram: int, buckets: int) -> np.ndarray:
    """Of each anchor: its bucket, then 32 more bits of its hash."""
    found = eight_hashes(data, place, np.full(len(place), gram))
    return ((found % U64(buckets)) << U64(32)) | ((found // U64(buckets)) & U64(0xFFFFFFFF))


def send_runs(buckets: int, window: int, gram: int):
    """Task over key, text: a row for each anchor of the task by the anchor's bucket; repeats, and runs of shared anchors, that the task itself found."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in sliced(whole, 1, FLUSH_BYTES)):
            keys, (data, offsets) = b.column(0).to_numpy(zero_copy_only=False), utf8(b.column(1))
            found = list(runs_of(data, offsets, window, gram))
            if not found:
                continue
            text, place, more, to_anchor = map(np.concatenate, zip(*found, strict=True))
            del found
            key, at = keys[text], place - offsets[text]
            stay, again = set_aside(data, key, at, place, more, to_anchor, window)
            yield _out(buckets, REPEAT, key[again], at[again], at[again] + more[again] + window)
            key, at, place, more, to_anchor = (c[stay] for c in (key, at, place, more, to_anchor))
            code = anchor_codes(data, place + to_anchor, gram, buckets)
            order, new = _firsts(code, key, at)
            count = np.diff(np.r_[np.flatnonzero(new), len(new)])
            rest, first = order[~new], order[new]
            yield _out(buckets, RUN, key[rest], at[rest], at[rest] + more[rest], at[rest] + to_anchor[rest])
            by_key = np.lexsort((at[first], key[first]))
            first, count = first[by_key], count[by_key].astype(np.uint32)
            bucket = (code[first] >> U64(32)).astype(np.int32)
            parts = split_by(bucket, (code[first] & U64(0xFFFFFFFF)).astype(np.uint32), key[first], at[first], more[first].astype(np.uint8), to_anchor[first].astype(np.uint8), count)
            yield batch(BLOBS, [x for x, _ in parts], [PARTIAL] * len(parts), [pack(c[0], _closer(c[1]), *c[2:]) for _, c in parts])

    return task


def _held(batches: Iterator[pa.RecordBatch], held: dict[int, list]) -> Iterator[pa.RecordBatch]:
    """Keeps partial blobs in held by their bucket, and passes on all else."""
    for b in batches:
        for bucket, kind, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if kind == PARTIAL:
                held.setdefault(bucket, []).append(blob)
            else:
                yield batch(BLOBS, [bucket], [kind], [blob])


def sort_runs(buckets: int):
    """Task over the anchors of whole buckets: the runs of those that several have, and which anchors are hot."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        yield from _held(batches, held)
        for bucket in list(held):
            rows = [unpack(blob, np.uint32, np.int64, np.int64, np.uint8, np.uint8, np.uint32) for blob in held.pop(bucket)]
            code, key, at, more, to_anchor, count = map(np.concatenate, zip(*((c, np.cumsum(k), *more) for c, k, *more in rows), strict=True))
            del rows
            order = np.argsort(code, kind="stable")
            cuts = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]])
            runs = np.add.reduceat(count[order].astype(np.int64), cuts)
            shared = order[np.repeat(runs, np.diff(np.r_[cuts, len(order)])) > 1]
            yield _out(buckets, RUN, key[shared], at[shared], at[shared] + more[shared], at[shared] + to_anchor[shared])
            hot = code[order][cuts[(runs >= HOT_RUNS) & (runs * HOT_SHARE >= runs.sum())]]
            if len(hot):
                yield batch(BLOBS, [bucket], [HOT], [pack((U64(bucket) << U64(32)) | hot.astype(U64))])

    return task


GATHERED = {"key": pa.int64(), "repeats": pa.binary(), "runs": pa.binary(), "hot": pa.binary()}


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over whole buckets of keys: for each key its repeats (start, end) and its runs (first and last window start, anchor), packed; hot anchors without a key."""
    held: dict[int, list] = {REPEAT: [], RUN: []}
    for b in batches:
        for kind, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if kind == HOT:
                yield batch(GATHERED, [None], [None], [None], [blob])
            else:
                held[kind].append(unpack(blob, *[np.int64] * (4 if kind == RUN else 3)))
    packed: list[dict[int, bytes]] = []
    for kind in (REPEAT, RUN):
        if held[kind]:
            key, *columns = map(np.concatenate, zip(*held.pop(kind), strict=True))
            _, number = np.unique(key, return_inverse=True)
            packed.append({int(c[0][0]): pack(*(_merged(c[1], c[2]) if kind == REPEAT else c[1:])) for _, c in split_by(number, key, *columns)})
        else:
            packed.append({})
    keys = sorted({*packed[0], *packed[1]})
    for i in range(0, len(keys), 10_000):
        some = keys[i : i + 10_000]
        yield batch(GATHERED, some, [packed[0].get(k) for k in some], [packed[1].get(k) for k in some], [None] * len(some))


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals in order, those that touch or overlap as one."""
    order = np.lexsort((end, start))
    start, end = start[order], end[order]
    if len(start):
        far = np.maximum.accumulate(end)
        cuts = np.flatnonzero(np.r_[True, start[1:] > far[:-1]])
        start, end = start[cuts], far[np.r_[cuts[1:] - 1, len(far) - 1]]
    return start, end


def send_windows(buckets: int, window: int, gram: int, hot: np.ndarray):
    """Task over key, text, runs: the bytes of the runs, by the bucket of their anchor; of hot anchors, of single windows by their own; and the repeats that the task itself found."""

    def sent(data: np.ndarray, runs: list[np.ndarray], by_window: bool) -> Iterator[pa.RecordBatch]:
        key, at, place, more, to_anchor = runs
        if not len(key):
            return
        stay, again = set_aside(data, key, at, place, more, to_anchor, window)
        yield _out(buckets, REPEAT, key[again], at[again], at[again] + more[again] + window)
        key, at, place, more, to_anchor = runs = [c[stay] for c in runs]
        route = eight_hashes(data, place, np.full(len(place), window)) if by_window else anchor_codes(data, place + to_anchor, gram, buckets) >> U64(32)
        yield _sent_bytes(buckets, window, data, route, *runs)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in sliced(whole, 1, FLUSH_BYTES)):
            keys, (data, offsets) = b.column(0).to_numpy(zero_copy_only=False), utf8(b.column(1))
            found = [unpack(blob, np.int64, np.int64, np.int64) for blob in b.column(2).to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            first, last, anchor = map(np.concatenate, zip(*found, strict=True))
            runs = [keys[row], first, offsets[row] + first, last - first, anchor - first]
            if len(hot):
                split = np.isin(anchor_codes(data, runs[2] + runs[4], gram, buckets), hot)
                which = np.repeat(np.flatnonzero(split), runs[3][split] + 1)
                step = np.arange(len(which)) - np.repeat(np.cumsum(runs[3][split] + 1) - runs[3][split] - 1, runs[3][split] + 1)
                yield from sent(data, [runs[0][which], runs[1][which] + step, runs[2][which] + step, np.zeros(len(which), np.int64), runs[4][which] - step], True)
                runs = [c[~split] for c in runs]
            yield from sent(data, runs, False)

    return task


def _sent_bytes(buckets: int, window: int, data: np.ndarray, route: np.ndarray, key, at, place, more, to_anchor) -> pa.RecordBatch:
    """The runs and their bytes, in as many eights as the longest has, by the bucket of route."""
    order = np.lexsort((at, key))
    source, blobs = eights(data), []
    parts = split_by((route[order] % U64(buckets)).astype(np.int32), *(c[order] for c in (key, at, more, to_anchor, place)))
    for _, (k, a, m, t, p) in parts:
        steps = 8 * np.arange(-(-(int(m.max()) + window) // 8))
        raw = source[p[:, None] + np.minimum(steps, np.maximum(len(data) - p, 0)[:, None])] & KEEP[np.clip((m + window)[:, None] - steps, 0, 8)]
        blobs.append(pack(_closer(k), a, m.astype(np.uint8), t.astype(np.uint8)) + raw.tobytes())
    return batch(BLOBS, [x for x, _ in parts], [PARTIAL] * len(parts), blobs)


def _received(blob: bytes) -> tuple[np.ndarray, ...]:
    """key, first window start, windows but one, anchor's place; and the bytes, a row for each run."""
    key, at, more, to_anchor = unpack(blob, np.int64, np.int64, np.uint8, np.uint8)
    raw = np.frombuffer(blob, np.uint8, -1, 8 + 18 * len(key)).reshape(len(key), -1)
    return np.cumsum(key), at, more.astype(np.int64), to_anchor.astype(np.int64), raw


def radix_groups(data: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Slices in the order of their bytes, as far as any other is equal: their numbers, and the number of their group.

    Most significant digits first, eight bytes a pass. A pass orders the groups in which the digit
    differs, and leaves out what then stands alone.
    """
    source = eights(data, ">u8")
    alive, group = np.arange(len(start)), np.zeros(len(start), np.int64)
    for done in range(0, size, 8):
        digit = source[start[alive] + done].astype(U64)
        if size - done < 8:
            digit >>= U64(8 * (8 - size + done))
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
        mixed = np.add.reduceat(digit != digit[first][group], first) > 0 if len(first) else np.zeros(0, bool)
        some = np.flatnonzero(mixed[group])
        order = some[np.lexsort((digit[some], group[some]))]
        alive[some], digit[some] = alive[order], digit[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])][: len(group)]
        group = np.cumsum(new) - 1
        many = (np.bincount(group) > 1)[group]
        alive, group = alive[many], group[many]
        group = np.cumsum(np.r_[True, group[1:] != group[:-1]][: len(group)]) - 1
        if not len(alive):
            break
    return alive, group


def repeated_windows(key: np.ndarray, at: np.ndarray, more: np.ndarray, to_anchor: np.ndarray, data: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs whose bytes stand in data at place: key, start and end of every stretch of windows that also start earlier.

    Windows go in groups of eight, aligned to the anchor: window i of a group covers the core, that
    all eight share, with 7 - i bytes before and i bytes behind it.
    """
    low, high = (to_anchor - more) // GROUP, to_anchor // GROUP
    n = high - low + 1
    which = np.repeat(np.arange(len(n)), n)
    number = low[which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    base = to_anchor[which] - GROUP * number - (GROUP - 1)
    core = place[which] + base + GROUP - 1
    size = window - GROUP + 1
    rows, group = radix_groups(data, core, size)
    which, base, core = which[rows], base[rows], core[rows]
    first, last = np.maximum(-base, 0), np.minimum(more[which] - base, GROUP - 1)
    before = eights(data, ">u8")[core - 8].astype(U64)
    behind = eights(data)[core + size]
    key, begin = key[which], at[which] + base
    start, stop = np.full(len(core), GROUP), np.full(len(core), -1)
    for i in range(GROUP):
        here = np.flatnonzero((first <= i) & (i <= last))
        order, new = _firsts(group[here], before[here] & KEEP[GROUP - 1 - i], behind[here] & KEEP[i], key[here], begin[here])
        again = here[order[~new]]
        start[again], stop[again] = np.minimum(start[again], i), i
    again = np.flatnonzero(stop >= 0)
    return key[again], begin[again] + start[again], begin[again] + stop[again] + window


def sort_windows(buckets: int, window: int):
    """Task over the runs of whole buckets: all windows but the first of each group of equals."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        yield from _held(batches, held)
        for bucket in list(held):
            rows = [_received(blob) for blob in held.pop(bucket)]
            width = np.concatenate([np.full(len(r[0]), r[4].shape[1]) for r in rows])
            data = np.concatenate([np.zeros(8, np.uint8), *(r[4].ravel() for r in rows), np.zeros(8, np.uint8)])
            columns = [np.concatenate([r[i] for r in rows]) for i in range(4)]
            del rows
            yield _out(buckets, REPEAT, *repeated_windows(*columns, data, 8 + np.cumsum(width) - width, window))

    return task


RESULT = {"key": pa.int64(), "doc_id": pa.int64(), "copies": pa.int32(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}


def _rest(text: np.ndarray, blobs: tuple[bytes | None, ...]) -> tuple[bytes, int]:
    """The bytes outside packed intervals, and how many separate stretches are gone."""
    found = [unpack(x, np.int64, np.int64) for x in blobs if x]
    if not found:
        return text.tobytes(), 0
    start, end = _merged(*map(np.concatenate, zip(*found, strict=True)))
    cuts = zip([0, *end], [*start, len(text)], strict=True)
    return b"".join(text[a:b].tobytes() for a, b in cuts), len(start)


def cut(with_text: bool):
    """Task over key, doc_id, copies, text, repeats, more: what is left of each text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(3))
            sizes, removed, spans, shas, kept = np.diff(offsets), [], [], [], []
            for row, blobs in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
                left, n = _rest(data[offsets[row] : offsets[row + 1]], blobs)
                removed.append(int(sizes[row]) - len(left))
                spans.append(n)
                shas.append(hashlib.sha256(left).hexdigest())
                kept.append(left if with_text else None)
            yield batch(RESULT, b.column(0), b.column(1), b.column(2), sizes, removed, spans, shas, kept)

    return task


def _gathered(blobs: DataFrame, buckets: int, name: str) -> DataFrame:
    return stored(blobs.repartitionById(buckets, F.col("bucket")).mapInArrow(freeing(gather), "key long, repeats binary, runs binary, hot binary"), name)


def repeats(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """texts: key (long, unique), text. A row per text with repeated bytes, stored: key, and two packed lists of their intervals."""
    texts = texts.select("key", "text")
    buckets = partitions(texts)
    runs = texts.mapInArrow(freeing(send_runs(buckets, window, gram)), BLOBS_DDL)
    runs = runs.repartitionById(buckets, F.col("bucket")).mapInArrow(freeing(sort_runs(buckets)), BLOBS_DDL)
    marks = _gathered(runs, buckets, "run-repeats")
    hot = [unpack(r[0], U64)[0] for r in marks.filter("hot IS NOT NULL").select("hot").collect()]  # at most HOT_SHARE anchors a bucket
    wanted = marks.filter("runs IS NOT NULL").select("key", "runs")
    task = send_windows(buckets, window, gram, np.concatenate([np.zeros(0, U64), *hot]))
    windows = texts.join(wanted.hint("merge"), "key").mapInArrow(freeing(task), BLOBS_DDL)
    windows = windows.repartitionById(buckets, F.col("bucket")).mapInArrow(freeing(sort_windows(buckets, window)), BLOBS_DDL)
    more = _gathered(windows, buckets, "window-repeats").select("key", F.col("repeats").alias("more"))
    marks = marks.filter("key IS NOT NULL").select("key", "repeats")
    return stored(marks.join(more, "key", "full").filter("repeats IS NOT NULL OR more IS NOT NULL"), "repeats")


def _beside(texts: DataFrame, found: DataFrame) -> DataFrame:
    return texts.join(found.hint("merge"), "key", "left")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the bytes kept if with_text.

    A byte goes if a window of so many bytes covers it that also starts earlier: in a smaller
    doc_id, or earlier in the same text. Null texts count as empty, and texts shorter than a window
    keep every byte. A null doc_id comes before all others; rows that share a doc_id are in the
    order of their texts, and rows that repeat doc_id and text are one document that gives as many
    equal rows. An empty table gives an empty result. Other columns are ignored. window may be from
    gram + 1 to gram + 255.
    """
    ready(docs.sparkSession)
    texts, _ = keyed(docs, id_col, text_col)
    rows = _beside(texts, repeats(texts, window, gram)).select("key", "doc_id", "copies", "text", "repeats", "more")
    out = rows.mapInArrow(cut(with_text), "key long, doc_id long, copies int, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return repeated(out).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text)


def shortened(docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs, whose id_col is unique and not null, with text_col reduced to what suffix_dedup() keeps of it.

    A character of which only some bytes are left is dropped whole. Null texts stay null. All other
    columns stay as they are.
    """
    ready(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("key", F.col(f"c{names.index(id_col)}").cast("long"))
    rows = _beside(plain, repeats(plain.select("key", F.col(f"c{at}").alias("text")), window, gram)).drop("key")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at)
            data, offsets = utf8(texts)
            kept = []
            for row, (ok, *blobs) in enumerate(zip(texts.is_valid().to_pylist(), *(c.to_pylist() for c in b.columns[-2:]), strict=True)):
                left, _ = _rest(data[offsets[row] : offsets[row + 1]], blobs)
                kept.append(left.decode("utf-8", "ignore") if ok else None)
            columns = [*b.columns[:-2]]
            columns[at] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-2])

    return rows.mapInArrow(task, plain.drop("key").schema).toDF(*names)
