"""BPE encoding and decoding with a contiguous rank array.

A word is a row of parts with the rank of each adjacent pair beside it. The smallest rank is looked
up again and again, the boundary that it names is deleted, and only the two neighbouring ranks are
refreshed. Many short words are merged at once, as rows of one matrix; words beyond LONG_WORD
symbols use a heap of ranks, as scanning a row of any length would be quadratic.

Texts are encoded by stretches without spaces, each of which is worked out once and then kept in a
bounded cache of the worker: words never cross a space, and neither normalising nor lower-casing
looks past one.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratavec.llm.arrays import batch
from stratavec.session import pick, ready

LONG_WORD = 64
ROWS = 8192
CACHE_ENTRIES = 250_000
GROUP_CHARS = 1 << 20
#: Below this character all versions of the Unicode tables agree on letters, digits, lower case and
#: composition; from here on the tokenizers library is asked to normalise and split.
OLD_SCRIPTS = "\u0530"
NONE = np.int32(2**31 - 1)


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Merger:
    """The merge table of a vocabulary, for symbols given as token ids."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]]) -> None:
        self.size = max(vocab.values()) + 1
        pairs = [(vocab[a] * self.size + vocab[b], vocab[a + b]) for a, b in merges]
        keys = np.array([k for k, _ in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = np.append(keys[self.order], np.int64(2**62))
        self.order = np.append(self.order, NONE)
        self.result = np.array([r for _, r in pairs], np.int32)
        self.ranks = {k: i for i, (k, _) in reversed(list(enumerate(pairs)))}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of adjacent parts; NONE where they don't merge or a part is missing (-1)."""
        key = np.where((a < 0) | (b < 0), np.int64(2**61), a.astype(np.int64) * self.size + b)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.order[at], NONE)

    def merge_rows(self, parts: np.ndarray) -> np.ndarray:
        """parts: a row per word, padded with -1. The same after all merges."""
        out, rows = np.full_like(parts, -1), np.arange(len(parts))
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        while len(rows) and parts.shape[1] > 1:
            at = ranks.argmin(1)
            line = np.arange(len(rows))
            best = ranks[line, at]
            ended = best == NONE
            if ended.any():
                out[rows[ended], : parts.shape[1]] = parts[ended]
                rows, parts, ranks, at, best = rows[~ended], parts[~ended], ranks[~ended], at[~ended], best[~ended]
                line = np.arange(len(rows))
                if not len(rows):
                    break
            parts[line, at] = self.result[best]
            width = parts.shape[1]
            places = np.arange(width - 1)
            parts = np.take_along_axis(parts, places + (places > at[:, None]), 1)
            if width == 2:
                out[rows, :1] = parts
                return out
            places = places[:-1]
            ranks = np.take_along_axis(ranks, places + (places >= at[:, None]), 1)
            has = at > 0
            ranks[line[has], at[has] - 1] = self.rank(parts[line[has], at[has] - 1], parts[line[has], at[has]])
            has = at < width - 2
            ranks[line[has], at[has]] = self.rank(parts[line[has], at[has]], parts[line[has], at[has] + 1])
        if len(rows):
            out[rows, : parts.shape[1]] = parts
        return out

    def merge_long(self, parts: list[int]) -> list[int]:
        """One word of any length."""
        n = len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get(parts[i] * self.size + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = int(self.result[r]), False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.ranks.get(parts[x] * self.size + parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p, ok in zip(parts, alive, strict=True) if ok]

    def merge(self, words: list[bytes], symbols: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        """The ids of each word: symbols and last give the token of a byte within a word and at its end."""
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(sizes, kind="stable")
        raw = np.frombuffer(b"".join([words[i] for i in order.tolist()]), np.uint8)
        ends = np.cumsum(sizes[order])
        flat = symbols[raw]
        flat[ends - 1] = last[raw[ends - 1]]
        out: list[np.ndarray] = [flat[:0]] * len(words)
        at = 0
        while at < len(order):
            width = int(sizes[order[at]])
            if width > LONG_WORD:
                out[order[at]] = np.array(self.merge_long(flat[ends[at] - width : ends[at]].tolist()), np.int32)
                at += 1
                continue
            limit = min(max(4, width + width // 4), LONG_WORD)
            to = min(at + ROWS, int(np.searchsorted(sizes[order], limit, "right")))
            some = sizes[order[at:to]]
            parts = np.full((to - at, int(some[-1])), -1, np.int32)
            parts[np.arange(parts.shape[1]) < some[:, None]] = flat[ends[at] - some[0] : ends[to - 1]]
            parts = self.merge_rows(parts)
            counts = (parts >= 0).sum(1)
            whole, stops = parts[parts >= 0], np.cumsum(counts).tolist()
            begin = 0
            for i, stop in zip(order[at:to].tolist(), stops, strict=True):
                out[i] = whole[begin:stop]
                begin = stop
            at = to
        return out


class WordBpe:
    """Encoder and decoder for a vocabulary with word ends: lower case, white space dropped."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.merger = Merger(model["vocab"], [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]])
        self.tokens = {i: t.encode() for t, i in model["vocab"].items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        chars, end = byte_characters(), model["end_of_word_suffix"]
        self.symbols = np.array([model["vocab"][chars[b]] for b in range(256)], np.int32)
        self.last = np.array([model["vocab"][chars[b] + end] for b in range(256)], np.int32)
        self.bytes = {c: b for b, c in chars.items()}
        self.path, self.library = path, None
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.merged: dict[str, tuple[bytes, bytes]] = {}
        self.alone = {c: (np.array([i], "<u4").tobytes(), c.encode()) for c, i in self.special.items()}

    def _split(self, stretch: str) -> list[str]:
        """Words of a stretch, and special tokens as they are."""
        if stretch.isascii():
            if stretch.isalpha():
                return [stretch.lower()]
            if stretch[:-1].isalpha() and stretch[-1] in ".,":
                return [stretch[:-1].lower(), stretch[-1]]
        out: list[str] = []
        for part in self.cut.split(stretch) if "<|" in stretch else [stretch]:
            if part in self.special:
                out.append(part)
            elif not part or max(part) < OLD_SCRIPTS:
                out += self.words.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
            else:
                if self.library is None:
                    self.library = Tokenizer.from_file(self.path)
                plain = self.library.normalizer.normalize_str(part)
                out += [bytes(map(self.bytes.__getitem__, w)).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]
        return out

    def learn(self, stretches: set[str]) -> None:
        """Makes the stretches known."""
        if len(self.known) + len(stretches) > CACHE_ENTRIES:
            self.known.clear()
            self.merged.clear()
        if not self.merged:
            self.merged.update(self.alone)
        new = [s for s in stretches if s not in self.known]
        split = [self._split(s) for s in new]
        merged, tokens = self.merged, self.tokens
        words = list({w for ws in split for w in ws if w not in merged})
        for w, ids in zip(words, self.merger.merge([w.encode() for w in words], self.symbols, self.last), strict=True):
            merged[w] = (ids.tobytes(), b" ".join([tokens[i] for i in ids.tolist()]))
        for s, ws in zip(new, split, strict=True):
            if len(ws) == 1:
                self.known[s] = merged[ws[0]]
            else:
                found = [merged[w] for w in ws]
                self.known[s] = (b"".join([i for i, _ in found]), b" ".join([d for _, d in found]))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids, as little-endian unsigned 32-bit integers, and the decoded text in UTF-8, of each text."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        known = self.known
        missing = {s for ss in split for s in ss if s not in known}
        if missing:
            held = {s: known[s] for ss in split for s in ss if s in known} if len(known) + len(missing) > CACHE_ENTRIES else {}
            self.learn(missing)
            known.update(held)
        out = []
        for ss in split:
            found = [known[s] for s in ss]
            out.append((b"".join([i for i, _ in found]), b" ".join([d for _, d in found if d])))
        return out

    def decode(self, ids: bytes) -> bytes:
        """The tokens of ids joined by spaces, word-end marks and all, as a vocabulary without a decoder gives them."""
        return b" ".join([self.tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The encoder of this worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def groups(texts: list[str | None], limit: int = GROUP_CHARS) -> Iterator[list[str]]:
    """The texts, nulls as empty, in groups of a bounded size (or of one)."""
    out, size = [], 0
    for t in texts:
        out.append(t or "")
        size += len(out[-1])
        if size >= limit:
            yield out
            out, size = [], 0
    if out:
        yield out


def encode_task(path: str, with_ids: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        schema = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.binary(), "decoded": pa.string()} if with_ids else {})
        for b in batches:
            done = [x for some in groups_of(b.column(1)) for x in coded(coder, some, with_ids)]
            yield batch(schema, b.column(0), *([x[i] for x in done] for i in range(len(schema) - 1)))

    return task


def groups_of(column: pa.Array) -> Iterator[list[str]]:
    for at in range(0, len(column), 256):
        yield from groups(column.slice(at, 256).to_pylist())


def coded(coder: WordBpe, texts: list[str], with_ids: bool) -> list[tuple]:
    return [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(d).hexdigest(), *((i, d.decode()) if with_ids else ())) for i, d in coder.encode(texts)]


def bpe_round(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids (little-endian unsigned 32-bit) and decoded.

    path: a vocabulary file with word ends that every executor has. Null and empty texts have no
    ids; their digests are those of no bytes. Null and repeated doc_ids give a row each, and an
    empty table an empty result. Other columns are ignored.
    """
    ready(docs.sparkSession)
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    more = ", ids binary, decoded string" if with_ids else ""
    return rows.mapInArrow(encode_task(path, with_ids), f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
