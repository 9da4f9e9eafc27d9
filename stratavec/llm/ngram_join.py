"""N-gram Jaccard self-join: a blocked sparse product of the document by n-gram incidence matrix.

A document's row of the matrix has a one for each of its distinct word 5-grams, as 64-bit hashes.
Overlaps of two rows are entries of the product of the matrix with its transpose. Only entries that
the sizes allow to reach the threshold matter, and they are narrowed down exactly:

1. In hash order, a linked pair's two lower halves share a number of n-grams that follows from the
   sizes. The halves are dealt into column blocks by hash; a block tells each document which of its
   n-grams some other has, and in how many. A document with fewer shared ones than any partner
   would need links with nothing and leaves.
2. Of the shared n-grams of those that stay, rarest first, a linked pair has one in common among
   so many that the bound could still be met without them. They name candidates: documents joined
   through such n-grams form a candidate block.
3. Blocks are multiplied out: the incidence of a block's documents by the n-grams that at least two
   of them have, a slice of columns at a time, accumulating overlaps. Pairs below the bound are
   discarded; of those above it, a tree of each connected part is kept. A large block is cut into
   parts of bounded size, and pairs of parts are multiplied by different tasks.

Documents with equal n-gram sets are one class, represented by its smallest document. Copies in one
task are set aside before anything is dealt out, so a hot group arrives once from each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.llm.arrays import U64, batch, eight_hashes, freeing, mix64, pack, split_by, unpack, utf8
from stratavec.llm.components import components
from stratavec.llm.rows import keyed
from stratavec.session import partitions, ready, small, stored

GRAM = 5
PERCENT = 75
FLUSH = 1 << 19
BLOCK_GRAMS = 1 << 20
LEAST_GRAMS = 1 << 10
SLICE = 1 << 12
LONG_WORD = 1 << 8
GROUP_BYTES = 1 << 22
BROADCAST_BYTES = 16 << 20
BLOBS = {"bucket": pa.int32(), "kind": pa.int32(), "blob": pa.binary()}
BLOBS_DDL = "bucket int, kind int, blob binary"
ENTRY, META, SHARED, CANDIDATE = 0, 1, 2, 3
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
FACTORS = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words `[^\\x20\\x09-\\x0D]+` of texts that lie one after another, A-Z lower-cased, and the words' count in each text."""
    first, last = int(offsets[0]), int(offsets[-1])
    part = LOWER[data[first:last]]
    word = ~SPACE[part]
    edge = np.zeros(len(part) + 1, bool)
    edge[offsets - first] = True
    start = np.flatnonzero(word & (edge[:-1] | np.r_[True, ~word[:-1]]))
    end = np.flatnonzero(word & (edge[1:] | np.r_[~word[1:], True])) + 1
    out = eight_hashes(part, start, end - start)
    for k in np.flatnonzero(end - start > LONG_WORD):
        out[k] = int.from_bytes(hashlib.blake2b(part[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    counts = np.diff(np.searchsorted(start, offsets - first))
    return out, counts


def gram_sets(data: np.ndarray, offsets: np.ndarray, gram: int = GRAM) -> Iterator[np.ndarray]:
    """The sorted distinct n-grams of each text; of fewer words, the whole sequence as one; none without words."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + GROUP_BYTES, "right")) - 1)
        words, counts = word_hashes(data, offsets[i : j + 1])
        grams = sum((words[k : len(words) - gram + 1 + k] * FACTORS[k % 5] + U64(k) for k in range(gram)), U64(0)) if len(words) >= gram else words[:0]
        grams = mix64(grams)
        at = 0
        for c in counts.tolist():
            if c >= gram:
                yield np.unique(grams[at : at + c - gram + 1])
            elif c:
                yield mix64(np.array([sum((int(words[at + k]) * int(FACTORS[k % 5]) + k for k in range(c)), c << 32) % (1 << 64)], U64))
            else:
                yield words[:0]
            at += c
        i = j


def _half(n, percent):
    """How many of the smallest n-grams are dealt out: half, or more if the bound needs more."""
    need = -(-percent * n // 100)
    return np.maximum(n - need + 1, -(-n // 2))


@lru_cache(1 << 16)
def least_shared(n: int, percent: int = PERCENT) -> int:
    """n-grams that a text of n has in common, among both lower halves, with any linked one at least."""
    other = np.arange(-(-percent * n // 100), 100 * n // percent + 1, dtype=np.int64)
    overlap = np.maximum(-(-percent * (n + other) // (100 + percent)), np.maximum(-(-percent * other // 100), -(-percent * n // 100)))
    return int(max(1, min((int(_half(n, percent)) - n + overlap).min(), (_half(other, percent) - other + overlap).min())))


def _deal(buckets: int, key: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    found = split_by((value % U64(buckets)).astype(np.int32), key, (value // U64(buckets)).astype(np.uint32))
    return batch(BLOBS, [b for b, _ in found], [ENTRY] * len(found), [pack(np.diff(k, prepend=np.int64(0)), v) for _, (k, v) in found])


def _by_key(buckets: int, kind: int, key: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    found = split_by((mix64(key.astype(U64)) % U64(buckets)).astype(np.int32), key, *columns)
    return batch(BLOBS, [b for b, _ in found], [kind] * len(found), [pack(*c) for _, c in found])


def deal_task(buckets: int, gram: int, percent: int):
    """Task over key, text: lower halves by hash bucket; size, set digest and the task's first text of that set, for each text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        keys, values, meta, held = [], [], [], 0
        for b in batches:
            for key, grams in zip(b.column(0).to_pylist(), gram_sets(*utf8(b.column(1)), gram), strict=True):
                digest = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
                new = digest not in seen
                meta.append((key, len(grams), int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), seen.setdefault(digest, key)))
                if len(grams) and new:
                    half = int(_half(len(grams), percent))
                    keys.append(np.full(half, key, np.int64))
                    values.append(grams[:half])
                    held += half
                if held >= FLUSH or len(meta) >= FLUSH // 64:
                    if held:
                        yield _deal(buckets, np.concatenate(keys), np.concatenate(values))
                    yield _by_key(buckets, META, *np.array(meta, np.int64).T)
                    keys, values, meta, held = [], [], [], 0
        if held:
            yield _deal(buckets, np.concatenate(keys), np.concatenate(values))
        if meta:
            yield _by_key(buckets, META, *np.array(meta, np.int64).T)

    return task


def share_task(buckets: int):
    """Task over whole hash buckets: which n-grams more than one text has, told to these texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for bucket, kind, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == ENTRY:
                    key, value = unpack(blob, np.int64, np.uint32)
                    held.setdefault(bucket, []).append((np.cumsum(key), value))
                else:
                    yield batch(BLOBS, [bucket], [kind], [blob])
        for bucket in list(held):
            key, value = map(np.concatenate, zip(*held.pop(bucket), strict=True))
            order = np.argsort(value, kind="stable")
            key, value = key[order], value[order]
            cuts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
            sizes = np.diff(np.r_[cuts, len(value)])
            counts = np.repeat(sizes, sizes)
            many = counts > 1
            yield _by_key(buckets, SHARED, key[many], counts[many].astype(np.uint32), value[many], np.full(many.sum(), bucket, np.uint32))

    return task


STAYED = {"key": pa.int64(), "n": pa.int64(), "s1": pa.int64(), "s2": pa.int64(), "first": pa.int64(), "bucket": pa.int32(), "blob": pa.binary()}
STAYED_DDL = "key long, n long, s1 long, s2 long, first long, bucket int, blob binary"


def stay_task(buckets: int, percent: int):
    """Task over whole key buckets: a row for each text, and the candidate n-grams of those that can have links, by hash bucket."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {META: [], SHARED: []}
        for b in batches:
            for kind, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                held[kind].append(unpack(blob, *([np.int64] * 5 if kind == META else [np.int64, np.uint32, np.uint32, np.uint32])))
        if not held[META]:
            return
        meta = list(map(np.concatenate, zip(*held[META], strict=True)))
        for at in range(0, len(meta[0]), 50_000):
            some = [c[at : at + 50_000] for c in meta]
            yield batch(STAYED, *some, pa.nulls(len(some[0]), pa.int32()), pa.nulls(len(some[0]), pa.binary()))
        if not held[SHARED]:
            return
        key, count, value, bucket = map(np.concatenate, zip(*held.pop(SHARED), strict=True))
        order = np.lexsort((bucket, value, count, key))
        key, value, bucket = key[order], value[order], bucket[order]
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[cuts, len(key)])
        by_key = np.argsort(meta[0])
        total = meta[1][by_key][np.searchsorted(meta[0][by_key], key[cuts])]
        need = np.array([least_shared(n, percent) for n in total.tolist()], np.int64)
        take = np.maximum(sizes - need + 1, 0)
        chosen = np.arange(len(key)) - np.repeat(cuts, sizes) < np.repeat(take, sizes)
        whole = value[chosen].astype(U64) * U64(buckets) + bucket[chosen].astype(U64)
        found = split_by((whole % U64(buckets)).astype(np.int32), key[chosen], value[chosen])
        none = pa.nulls(len(found), pa.int64())
        yield batch(STAYED, none, none, none, none, none, [b for b, _ in found], [pack(*c) for _, c in found])

    return task


def candidate_task(buckets: int):
    """Task over whole hash buckets of candidate n-grams: each text with the smallest that shares one, by the text's bucket."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(bucket, []).append(unpack(blob, np.int64, np.uint32))
        for bucket in list(held):
            key, value = map(np.concatenate, zip(*held.pop(bucket), strict=True))
            order = np.lexsort((key, value))
            key, value = key[order], value[order]
            cuts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
            sizes = np.diff(np.r_[cuts, len(value)])
            yield _by_key(buckets, CANDIDATE, *_distinct(key, np.repeat(key[cuts], sizes)))

    return task


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of different keys."""
    some = a != b
    a, b = a[some], b[some]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    return a[new], b[new]


def pair_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over whole key buckets: the distinct candidate pairs of each text."""
    held = [unpack(blob, np.int64, np.int64) for b in batches for blob in b.column(2).to_pylist()]
    if held:
        yield batch({"a": pa.int64(), "b": pa.int64()}, *_distinct(*map(np.concatenate, zip(*held, strict=True))))


SETS = {"block": pa.int64(), "part": pa.int32(), "parts": pa.int32(), "key": pa.int64(), "grams": pa.binary()}


def sets_task(gram: int):
    """Task over block, part, parts, key, text: the text's n-grams in its place."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(SETS, *b.columns[:4], [g.tobytes() for g in gram_sets(*utf8(b.column(4)), gram)])

    return task


def linked(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]] | None, percent: int) -> list[tuple[int, int]]:
    """Links among left, or between left and right, as pairs that join the same documents together."""
    both = left + (right or [])
    keys, sizes = np.array([k for k, _ in both]), np.array([len(g) for _, g in both], np.int64)
    grams = np.concatenate([g for _, g in both])
    row = np.repeat(np.arange(len(both)), sizes)
    order = np.argsort(grams, kind="stable")
    grams, row = grams[order], row[order]
    new = np.r_[True, grams[1:] != grams[:-1]]
    column = np.cumsum(new) - 1
    wide = np.bincount(column)[column] > 1
    row, column = row[wide], column[wide]
    column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1 if len(column) else column
    n = len(left)
    overlap = np.zeros((n, len(both) - n if right else n), np.int32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, SLICE):
        i, j = np.searchsorted(column, [at, at + SLICE])
        part = np.zeros((len(both), min(SLICE, int(column[-1]) + 1 - at)), np.float32)
        part[row[i:j], column[i:j] - at] = 1
        np.add(overlap, part[:n] @ (part[n:] if right else part).T, out=overlap, casting="unsafe")  # a slice's counts are exact
    least = sizes[:n, None] + (sizes[n:] if right else sizes)[None, :]
    least *= percent
    least = -(-least // (100 + percent))  # 100 * overlap >= percent * (sizes - overlap), in whole numbers
    a, b = np.nonzero((overlap >= least) & (overlap > 0))
    if right:
        b = b + n
    root = np.arange(len(both))
    while True:  # each document takes the smallest label of those it links with
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return [(int(keys[i]), int(keys[r])) for i, r in enumerate(root) if i != r]


def product_task(percent: int):
    """Task over block, i, j, part, key, grams in the order of block, i, j: links of each part or pair of parts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, right, out = None, [], [], []
        for b in batches:
            for block, i, j, part, key, grams in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (block, i, j) != now:
                    if left and (now[1] == now[2] or right):
                        out += linked(left, right if now[1] != now[2] else None, percent)
                    now, left, right = (block, i, j), [], []
                (left if part == i else right).append((key, np.frombuffer(grams, U64)))
        if left and (now[1] == now[2] or right):
            out += linked(left, right if now[1] != now[2] else None, percent)
        for at in range(0, len(out), 50_000):
            yield batch({"a": pa.int64(), "b": pa.int64()}, *map(list, zip(*out[at : at + 50_000], strict=True)))

    return task


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, percent: int = PERCENT, unique: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Two documents link when their sets of word n-grams have a Jaccard similarity of percent / 100 or
    more; component_id is the smallest doc_id reachable by links. A text of fewer words than gram has
    the whole sequence as its one n-gram; null, empty and blank texts have none and link with
    nothing. A null doc_id comes before all others and is the component_id of its component. Rows
    that share a doc_id are documents of their own, unless they repeat the text too: those are one
    document that gives as many equal rows. An empty table gives an empty result. Other columns are
    ignored. unique: ids are known to be unique and not null.
    """
    ready(docs.sparkSession)
    texts, plain = keyed(docs, id_col, text_col, unique)
    buckets = partitions(texts)
    dealt = texts.select("key", "text").mapInArrow(freeing(deal_task(buckets, gram, percent)), BLOBS_DDL)
    shared = dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(freeing(share_task(buckets)), BLOBS_DDL)
    stayed = stored(shared.repartitionById(buckets, F.col("bucket")).mapInArrow(freeing(stay_task(buckets, percent)), STAYED_DDL), "stayed")
    meta = stayed.filter("key IS NOT NULL").select("key", "n", "s1", "s2", "first")
    # copies go by their task's first of them: a hot class is one row from each task
    firsts = stored(meta.filter("n > 0").groupBy("s1", "s2", "first").agg(F.min("key").alias("low")), "firsts")
    classes = firsts.join(firsts.groupBy("s1", "s2").agg(F.min("low").alias("rep")), ["s1", "s2"]).select("first", "rep")
    members = meta.withColumn("first", F.when(F.col("n") > 0, F.col("first"))).join(classes, "first", "left")
    members = stored(members.select("key", "n", F.coalesce("rep", "key").alias("rep")), "classes")
    pairs = stayed.filter("key IS NULL").select("bucket", "blob").repartitionById(buckets, F.col("bucket")).mapInArrow(freeing(candidate_task(buckets)), BLOBS_DDL)
    pairs = pairs.repartitionById(buckets, F.col("bucket")).mapInArrow(freeing(pair_task), "a long, b long")
    reps = members.select(F.col("key").alias("a"), F.col("rep").alias("ra"))
    pairs = pairs.join(reps, "a").join(reps.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    blocks = stored(components(pairs).join(members.select(F.col("key").alias("node"), "n"), "node"), "candidate-blocks")
    weight = F.sum(F.greatest(F.col("n"), F.lit(LEAST_GRAMS)))
    cuts = blocks.groupBy("component").agg(F.ceil(weight / BLOCK_GRAMS).cast("int").alias("parts"))
    places = blocks.join(cuts, "component").select(F.col("component").alias("block"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "parts", F.col("node").alias("key"))
    places = stored(places, "places")
    if small(places, F.lit(32), BROADCAST_BYTES):
        places = F.broadcast(places)
    sets = texts.select("key", "text").join(places, "key").select("block", "part", "parts", "key", "text").mapInArrow(freeing(sets_task(gram)), "block long, part int, parts int, key long, grams binary")
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sets = sets.select("block", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "key", "grams")
    sets = sets.repartition(buckets, "block", "i", "j").sortWithinPartitions("block", "i", "j")
    found = components(sets.mapInArrow(freeing(product_task(percent)), "a long, b long"))
    out = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component"))
    if plain:
        return out.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    ids = texts.select("key", "doc_id", "copies")
    out = out.join(ids, "key").join(ids.select(F.col("key").alias("component"), F.col("doc_id").alias("component_id")), "component")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "n_shingles", "component_id")
