"""Exact dedup, repeated passages and the n-gram join against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF

from stratavec.llm import exact_dedup as exact
from stratavec.llm import ngram_join as nj
from stratavec.llm import suffix_dedup as sd
from stratavec.llm.arrays import unpack, utf8
from stratavec.llm.components import components
from stratavec.llm.exact_dedup import exact_dedup, identities
from stratavec.llm.ngram_join import ngram_join
from stratavec.llm.queries import ORACLE_SQL, QUERIES
from stratavec.llm.suffix_dedup import shortened, suffix_dedup

from .conftest import EDGES, EXPECT

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def brute_passages(rows, window=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - window + 1):
            w = raw[p : p + window]
            if w in seen:
                gone[p : p + window] = b"\1" * window
            seen.add(w)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    label = {i: i for i in sets}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in where[x] if j > i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def planted(seed, n=60):
    """Texts with copies, near copies around the threshold, shared passages across them, and short ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rng.choice([1, 3, 5, 8, 40, 150, 300]))]
        if rng.random() < 0.3:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        rows.append((i * 3, " ".join(w)))
    rng.shuffle(rows)
    return rows


def test_exact_matches_sql(spark):
    found = QUERIES["op6_exact_dedup"](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    wanted = con.execute(ORACLE_SQL["op6_exact_dedup"]).fetchall()
    assert sorted(map(tuple, found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == sorted(wanted)


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - {"op6_exact_dedup"}))
def test_queries_match_sql(spark, name):
    found = QUERIES[name](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    wanted = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(tuple, found.select(columns).collect()), key=str) == sorted(wanted.fetchall(), key=str)


def test_exact_names_every_text(docs_of, monkeypatch):
    named = []
    monkeypatch.setattr(exact, "identities", lambda texts, *a: named.append(texts.count()) or identities(texts, *a))
    assert exact.exact_dedup(docs_of([(1, "one"), (2, "two"), (3, "one"), (4, "x" * 9000)])).count() == 4 and named == [4]


def test_exact_edges(spark, edges, none, docs_of):
    rows = exact_dedup(edges).collect()
    assert len(rows) == EXPECT
    by = {(r["doc_id"], r["text_sha256"]): r for r in rows}
    two = hashlib.sha256(b"one two").hexdigest()
    assert by[(9, two)]["kept"] and by[(9, two)]["group_size"] == 4 and by[(None, two)]["keep_id"] == 9
    empty = hashlib.sha256(b"").hexdigest()
    assert by[(2, empty)]["kept"] and by[(1, empty)]["keep_id"] == 2 and by[(None, empty)]["keep_id"] == 2
    assert sum(r["kept"] for r in rows) == len({t or "" for _, t in EDGES})
    assert exact_dedup(none).count() == 0
    tied = exact_dedup(docs_of([(5, "same"), (5, "same")])).collect()
    assert sum(r["kept"] for r in tied) == 1 and {r["group_size"] for r in tied} == {2}


def test_exact_many_levels(docs_of):
    """Blocks of two bytes: texts that differ in one late block, or are pairs' prefixes of others, stay apart."""
    base = "abcdefgh" * 9
    rows = [(1, base), (2, base), (3, base[:-1] + "X"), (4, "X" + base[1:]), (5, base[:-1]), (6, base + base), (7, base[::-1])]
    found = {r["doc_id"]: r["keep_id"] for r in exact_dedup(docs_of(rows), block_bytes=2).collect()}
    assert found == {1: 2, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7}


@pytest.mark.parametrize("digest", [lambda *c: F.lit(7).cast("long"), lambda *c: F.pmod(F.xxhash64(*c), F.lit(3))], ids=["one", "three"])
def test_exact_whatever_the_hash(docs_of, digest):
    """With hashes that are all equal, or of three values only, contents alone tell texts apart."""
    base = "abcdefgh" * 3
    rows = [(1, base), (2, base), (3, base[:-1] + "X"), (4, "X" + base[1:]), (5, base[:-1]), (6, base + base), (7, base[::-1]), (8, None), (9, ""), (10, "ab"), (11, "ac"), (12, "ab")]
    found = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup(docs_of(rows), block_bytes=4, digest=digest).collect()}
    assert found == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1), 6: (6, 1), 7: (7, 1), 8: (9, 2), 9: (9, 2), 10: (12, 2), 11: (11, 1), 12: (12, 2)}


def test_passages_match_brute_force(spark):
    rows = [tuple(r) for r in table(spark).select("doc_id", "text").collect()]
    wanted = brute_passages(rows)
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op1_suffix_dedup"](spark, SF).collect()}
    assert found == wanted and sum(w[1] for w in wanted.values()) > 0


@pytest.mark.parametrize("seed", range(2))
def test_passages_planted(spark, docs_of, seed, monkeypatch):
    monkeypatch.setattr("stratavec.llm.suffix_dedup.CHUNK", 700)  # on the driver's side only; long texts are cut in any case
    rows = planted(seed, 40)
    rows += [(1001, "ab" * 300), (1003, "z" * 900), (1002, "z" * 150), (1004, rows[0][1] * 3)]
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup(docs_of(rows)).collect()}
    assert found == brute_passages(rows)


def in_process(rows, buckets, hot=()):
    """The tasks of repeats() one after another, without Spark: removed intervals by key."""
    rows = sorted(rows)
    table = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], names=["key", "text"])
    marks = list(sd.gather(sd.sort_runs(buckets)(sd.send_runs(buckets, 100, 40)([table]))))
    runs = {k: r for b in marks for k, r in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True) if r}
    some = [(i, t) for i, t in rows if i in runs]
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t]), pa.array([runs[i]])], names=["key", "text", "runs"]) for i, t in some]
    more = list(sd.gather(sd.sort_windows(buckets, 100)(sd.send_windows(buckets, 100, 40, np.array(hot, np.uint64))(batches)))) if batches else []
    out = defaultdict(list)
    for b in marks + more:
        for k, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if r:
                out[k] += zip(*unpack(r, np.int64, np.int64), strict=True)
    return out


@pytest.mark.parametrize("stub", [None, "one", "four"])
def test_passages_whatever_the_hash(stub, monkeypatch):
    """Bytes decide: with equal hashes for all, or for a quarter, the result is that of brute force."""
    if stub:
        monkeypatch.setattr(sd, "eight_hashes", lambda data, start, size: (data[start].astype(np.uint64) % np.uint64(4) if stub == "four" else np.zeros(len(start), np.uint64)))
    rows = planted(3, 40) + [(1001, "ab" * 300), (1003, "z" * 900), (1002, "z" * 150)]
    wanted, found = brute_passages(rows), in_process(rows, 3)
    for i, t in rows:
        gone = bytearray(len(t.encode()))
        for a, b in found[i]:
            gone[a:b] = b"\1" * (b - a)
        assert sum(gone) == wanted[i][1], i
    assert sum(w[1] for w in wanted.values()) > 0


def test_passages_of_hot_anchors(docs_of, monkeypatch):
    """A short passage before and behind which every text differs: its anchors are hot, and their windows go one by one."""
    monkeypatch.setattr(sd, "HOT_RUNS", 3)
    monkeypatch.setattr(sd, "HOT_SHARE", 10**9)
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = letters(130)
    rows = [(i, letters(rng.randint(0, 200)) + passage[: rng.choice([60, 110, 130])] + letters(rng.randint(0, 90))) for i in range(60)]
    rows += [(100 + i, t) for i, t in rows[:5]]
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup(docs_of(rows)).collect()}
    assert found == brute_passages(rows)


def test_radix_groups_are_in_byte_order():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    for size in (3, 8, 13, 16):
        start = np.arange(len(data) - size)
        found = sd.radix_groups(data, start, size)
        slices = [bytes(data[i : i + size]) for i in start]
        many = {s for s, n in Counter(slices).items() if n > 1}
        assert [slices[i] for i in found[0]] == sorted(s for s in slices if s in many)
        assert found[1].tolist() == [sorted(many).index(slices[i]) for i in found[0]]


def test_passages_of_a_very_long_text():
    """Over 2^20 bytes, in more parts than one, with copies of passages across their borders."""
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghij klmnop") for _ in range(1_150_000))
    text = text[:600_000] + text[524_200:524_400] + text[600_000:] + text[1_048_500:1_048_700]
    rows = [(1, text), (2, text[300:450])]
    wanted, found = brute_passages(rows), in_process(rows, 2)
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for a, b in found[i]:
            gone[a:b] = True
        assert int(gone.sum()) == wanted[i][1] > 0


def test_grams_of_a_very_long_text():
    rng = random.Random(10)
    text = " ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(250_000))
    (grams,) = nj.gram_sets(*utf8(pa.array([text])))
    assert len(text) > 1 << 20 and len(grams) == len(shingles(text))


def test_passages_edges(edges, none, docs_of):
    rows = suffix_dedup(edges).collect()
    assert len(rows) == EXPECT
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert by[2][0]["n_bytes"] == 0 and by[7][0]["n_removed"] == 4999 and by[10][0]["n_spans"] == 1
    assert suffix_dedup(none).count() == 0
    out = shortened(docs_of([(1, "é" * 200), (2, "x" + "é" * 200), (3, None)]), "doc_id", "text")
    assert out.columns == docs_of([]).columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "é", 2: "x", 3: None}


def test_join_matches_brute_force(spark):
    rows = [tuple(r) for r in table(spark).select("doc_id", "text").collect()]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op8_ngram_join"](spark, SF).collect()}
    assert found == brute_components(rows)


@pytest.mark.parametrize("seed", range(2))
def test_join_planted(docs_of, seed, monkeypatch):
    rows = planted(seed + 10, 80)
    monkeypatch.setattr(nj, "BLOCK_GRAMS", 2048)  # large candidate blocks are cut in parts
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join(docs_of(rows)).collect()}
    wanted = brute_components(rows)
    assert found == wanted and len({c for _, c in wanted.values()}) < len(rows)


def test_join_edges(edges, none):
    rows = ngram_join(edges).collect()
    assert len(rows) == EXPECT
    two = [r for r in rows if r["n_shingles"] == 1 and r["doc_id"] in (None, 4, 9)]
    assert len({r["component_id"] for r in two}) == 2  # those of "one two", whose smallest is the null doc_id, and "other words here"
    assert all(r["component_id"] == r["doc_id"] for r in rows if r["n_shingles"] == 0)
    assert ngram_join(none).count() == 0


def test_bound_on_shared_grams():
    """No linked pair shares fewer n-grams in both lower halves than least_shared() says, for either."""
    rng = np.random.default_rng(0)
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        a = set(rng.choice(10**6, n, replace=False).tolist())
        b = set(list(a)[: int(rng.integers(max(1, n * 3 // 4), n + 1))]) | set(rng.choice(10**6, int(rng.integers(0, n // 3 + 1)), replace=False).tolist())
        if 100 * len(a & b) >= 75 * len(a | b):
            lower = [set(sorted(x)[: int(nj._half(len(x), 75))]) for x in (a, b)]
            assert len(lower[0] & lower[1]) >= max(nj.least_shared(len(a)), nj.least_shared(len(b)))


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (30, 20), (20, 10), (10, 40)] + [(100 + i, 101 + i) for i in range(30)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 10: 10, 20: 10, 30: 10, 40: 10} | {100 + i: 100 for i in range(31)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_at_the_threshold_of_very_long_texts():
    """Sets of an overlap of 900,009 and a union of 1,200,012: exactly 0.75."""
    grams = np.arange(1_200_012, dtype=np.uint64)
    assert nj.linked([(1, grams[:-300_003]), (2, np.r_[grams[:900_009], grams[-300_003:]])], None, 75) == [(2, 1)]
    assert nj.linked([(1, grams[:-300_003])], [(2, np.r_[grams[:900_009], grams[-300_003:]])], 75) == [(2, 1)]
    assert nj.linked([(1, grams[:-300_003]), (2, np.r_[grams[:900_008], grams[-300_003:]])], None, 75) == []


def test_words_that_cancel_in_powers_of_a_base(docs_of):
    """The Thue-Morse word and its complement have equal polynomial hashes modulo 2^64, whatever the odd base."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word, word.translate(str.maketrans("ab", "ba")), word[:64], word[64:128], word[:200], word[:200] + "\0"]
    for some in (texts, [t * 40 for t in texts]):
        column = pa.array(some)
        hashes, counts = nj.word_hashes(*utf8(column))
        assert counts.tolist() == [1] * 6 and len(set(hashes.tolist())) == 6
    found = {r["doc_id"]: r["component_id"] for r in ngram_join(docs_of(enumerate(texts[:2]))).collect()}
    assert found == {0: 0, 1: 1}


def test_links_of_contained_sets_at_the_threshold():
    """Sets of 4k and 3k, the smaller within the larger: exactly 0.75, beyond what float32 can tell."""
    grams = np.arange(4 * 223_707, dtype=np.uint64)
    for k in (223_697, 223_699, 223_703, 223_707):
        assert nj.linked([(1, grams[: 4 * k]), (2, grams[: 3 * k])], None, 75) == [(2, 1)]
        assert nj.linked([(1, grams[: 4 * k]), (2, grams[: 3 * k - 1])], None, 75) == []
