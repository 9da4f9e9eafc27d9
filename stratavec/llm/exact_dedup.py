"""Exact deduplication by deterministic block naming, in DataFrame operations only.

Every text is cut into blocks of a fixed number of bytes, and every block gets an integer name; then
the names of adjacent blocks are paired, pairs get names in turn, and so on, until each text has one
name. Two texts of one length have one name only if they are identical.

A name is two integers: a 64-bit hash, and a number among the different contents of that hash. All
blocks are sorted by their hash, and the least and the greatest content of each are compared. Where
they are equal, all blocks of the hash are identical and its number is 0; where they differ, the
contents themselves are sorted and numbered. So contents travel once, a row per task and distinct
block, and a hot block is no more than a row from each task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavec.llm.rows import keyed
from stratavec.session import ready, stored

BLOCK_BYTES = 4096
Digest = Callable[..., Column]


def _numbered(hashed: DataFrame, contents: DataFrame, keys: list[str]) -> DataFrame:
    """hashed: rows with h, stored; contents: the same rows with h and keys. hashed with k, the number of a row's keys among the different ones of its h."""
    value = F.struct(*keys) if len(keys) > 1 else F.col(keys[0])
    mixed = contents.groupBy("h").agg(F.min(value).alias("low"), F.max(value).alias("high")).filter("low <> high")
    mixed = stored(mixed.select("h"), "mixed-hashes")
    if mixed.isEmpty():
        return hashed.withColumn("k", F.lit(0))
    several = contents.join(mixed, "h", "left_semi").select("h", *keys).distinct()
    several = stored(several.withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy(*keys))), "numbers")
    places = ["key", "at"]
    found = contents.join(several, ["h", *keys]).select(*places, F.col("k").alias("number"))
    return hashed.join(stored(found, "numbered-rows"), places, "left").withColumn("k", F.coalesce("number", F.lit(0))).drop("number")


def identities(texts: DataFrame, block_bytes: int = BLOCK_BYTES, digest: Digest = F.xxhash64) -> DataFrame:
    """texts: key (unique), doc_id, copies, text (not null). Returns key, doc_id, copies, sha, n (bytes), h, k: equal (n, h, k) means equal text."""
    raw = texts.select("key", "doc_id", "copies", F.encode("text", "UTF-8").alias("raw"))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / block_bytes)).cast("int")
    block = lambda i: F.substring("raw", i * block_bytes + 1, F.lit(block_bytes))
    rows = raw.select(
        "key", "doc_id", "copies", F.sha2("raw", 256).alias("sha"), F.octet_length("raw").alias("n"), count.alias("blocks"),
        F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), block)).alias("at", "block"),
    )
    rows = rows.withColumn("h", digest("block"))
    head = lambda c: F.when(F.col("at") == 0, F.col(c)).alias(c)
    first = stored(rows.select("key", head("doc_id"), head("copies"), head("sha"), "n", "blocks", "at", "h"), "block-hashes")
    first = _numbered(first, rows.select("key", "at", "h", "block"), ["block"])
    own = ["key", "doc_id", "copies", "sha", "n"]
    out = first.filter("blocks = 1").select(*own, "h", "k")
    level = first.filter("blocks > 1").select("key", "blocks", "at", "h", "k")
    most = first.agg(F.max("blocks")).first()[0] or 1
    named = None
    while most > 1:
        side = lambda c, odd, none: F.coalesce(F.max(F.when(F.col("at") % 2 == odd, F.col(c))), F.lit(none))
        pairs = level.groupBy("key", "blocks", F.floor(F.col("at") / 2).cast("int").alias("at"))
        pairs = pairs.agg(side("h", 0, 0).alias("ah"), side("k", 0, -1).alias("ak"), side("h", 1, 0).alias("bh"), side("k", 1, -1).alias("bk"))
        keys = ["ah", "ak", "bh", "bk"]
        pairs = stored(pairs.select("key", F.ceil(F.col("blocks") / 2).cast("int").alias("blocks"), "at", *keys, digest(*keys).alias("h")), "pairs")
        level = _numbered(pairs.drop(*keys), pairs, keys)
        done = level.filter("blocks = 1").select("key", "h", "k")
        named = done if named is None else named.unionByName(done)
        level, most = level.filter("blocks > 1"), (most + 1) // 2
    if named is None:
        return out
    return out.unionByName(first.filter("blocks > 1 AND at = 0").select(*own).join(named, "key").select(*own, "h", "k"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, digest: Digest = F.xxhash64, unique: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays. Null texts count as empty. A null doc_id
    sorts below all others. Of rows that repeat both doc_id and text, one is kept. An empty table
    gives an empty result. Columns besides the two named are ignored. unique: ids are known to be
    unique and not null.
    """
    ready(docs.sparkSession)
    texts, plain = keyed(docs, id_col, text_col, unique)
    rows = stored(identities(texts.withColumn("text", F.coalesce("text", F.lit(""))), block_bytes, digest), "identities")
    same = ["n", "h", "k"]
    groups = stored(rows.groupBy(*same).agg(F.max("key").alias("keep"), F.sum("copies").alias("group_size")), "groups")
    rows = rows.join(groups, same)
    if plain:
        return rows.select("doc_id", F.col("keep").alias("keep_id"), "group_size", (F.col("key") == F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"))
    ids = texts.select(F.col("key").alias("keep"), F.col("doc_id").alias("keep_id"))
    rows = rows.join(ids, "keep").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select("doc_id", "keep_id", "group_size", ((F.col("key") == F.col("keep")) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))
