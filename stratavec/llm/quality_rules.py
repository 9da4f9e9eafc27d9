"""Quality rules: base counts of each text, and a hashed n-gram log-likelihood ratio, in DataFrame operations only.

Words and adjacent word pairs are hashed into a fixed number of buckets. Two multinomials over the
buckets are counted over all documents: the trusted target (documents that labels mark as of good
quality) and the raw corpus (every document). A document's score is the mean over its n-grams of
log(p_target / p_raw), so that length doesn't matter; it is kept if no base rule fails and the score
reaches a fixed threshold. The bucket weights are one row of a fixed size, whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavec.session import pick, ready, small, stored

BUCKETS = 4096
SMOOTHING = 1.0
MIN_SCORE = -0.1
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[ \\t\\n\\x0B\\f\\r]+"
WORD_CHAR = "[^ \\t\\n\\x0B\\f\\r]"
SYMBOLS = "#*$%&|<>"
POSITION_BITS = 20
LOW = PACKED_WORDS = (1 << POSITION_BITS) - 1
BROADCAST_BYTES = 8 << 20


def _dropped(text: str, characters: str) -> Column:
    """How many of the characters a text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _same_key(a: Column, b: Column) -> Column:
    return F.coalesce(a.bitwiseAND(F.lit(~LOW)) == b.bitwiseAND(F.lit(~LOW)), F.lit(False))


def _covered(starts: Column) -> Column:
    """How many words the 3-word windows at these ascending starts cover together."""
    return F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("n"), x.alias("last")))["n"]


def with_counts(texts: DataFrame) -> DataFrame:
    """texts: doc_id, text (not null). Adds words' hashes (wh), n_words and the four base counts.

    Equal 3-word windows are found by sorting: a window's 64-bit hash keeps its upper bits and has
    its position in the lower ones, so that plain longs are sorted and equal windows become
    neighbours. Texts whose windows are all different aren't sorted. A text with too many words for the position, or with two windows that differ in
    the lower bits alone, sorts pairs of whole hash and position instead.
    """
    split = texts.select("doc_id", "text", F.array_remove(F.split("text", SPACE_RUN), "").alias("words"))
    split = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        _dropped("text", SPACES).alias("n_spaces"),
        F.length("text").alias("n_text"),
        _dropped("text", SYMBOLS).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD_CHAR)).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("wh"),
    )
    at = lambda i, k: F.get("wh", (i + k).cast("int"))
    grams = F.slice(F.transform("wh", lambda h, i: F.xxhash64(h, at(i, 1), at(i, 2))), 1, F.greatest(F.size("wh") - 2, F.lit(0)))
    rows = split.select(
        "doc_id", "n_words", "wh", "n_symbols",
        (F.col("n_text") - F.col("n_spaces")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        grams.alias("grams"),
    )
    again = F.size(F.array_distinct("grams")) < F.size("grams")
    rows = rows.withColumn("again", again)
    rows = rows.withColumn("packed", F.when(F.col("again"), F.sort_array(F.transform("grams", lambda h, i: h.bitwiseAND(F.lit(~LOW)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(LOW)))))))
    hit = lambda i: F.get("grams", i.bitwiseAND(F.lit(LOW)).cast("int"))
    mixed = F.exists(F.sequence(F.lit(1), F.size("packed")), lambda i: _same_key(F.get("packed", i - 1), F.get("packed", i)) & (hit(F.get("packed", i - 1)) != hit(F.get("packed", i))))
    near = F.filter("packed", lambda x, i: _same_key(F.get("packed", i - 1), x) | _same_key(F.get("packed", i + 1), x))
    rows = rows.withColumn("plain", (F.size("packed") <= PACKED_WORDS) & ~mixed).withColumn("near", F.when(F.col("plain"), near))
    starts = F.sort_array(F.transform("near", lambda x: x.bitwiseAND(F.lit(LOW))))
    pairs = F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    rows = rows.withColumn("pairs", F.when(F.col("again") & ~F.col("plain"), pairs))
    slow = F.filter("pairs", lambda x, i: F.coalesce(F.get("pairs", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("pairs", i + 1)["h"] == x["h"], F.lit(False)))
    slow_starts = F.sort_array(F.transform(slow, lambda x: x["i"]))
    rows = rows.withColumn("starts", F.when(F.col("plain"), starts).otherwise(slow_starts))
    return rows.select("doc_id", "n_words", "wh", "word_chars", "n_symbols", "n_dup_lines", F.when(F.col("again"), _covered(F.col("starts"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))


def _buckets(buckets: int) -> Column:
    """Bucket numbers, from 0, of all words and adjacent word pairs."""
    single = F.transform("wh", lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    double = F.transform("wh", lambda h, i: F.pmod(F.xxhash64(h, F.get("wh", i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(single, F.slice(double, 1, F.greatest(F.size("wh") - 1, F.lit(0))))


def bucket_weights(hashed: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """hashed: doc_id, wh of every document; trusted: doc_id, distinct. One row: w, the log ratio of each bucket; zeros if nothing is trusted."""
    flag = F.broadcast(trusted) if small(trusted, F.lit(16), BROADCAST_BYTES) else trusted
    rows = hashed.join(flag.withColumn("good", F.lit(1).cast("long")), "doc_id", "left").select(F.coalesce("good", F.lit(0)).alias("good"), F.explode(_buckets(buckets)).alias("b"))
    counts = rows.groupBy("b").agg(F.sum("good").alias("t"), F.count(F.lit(1)).alias("r"))
    spark = hashed.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").select("b", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("r", F.lit(0)).alias("r"))
    one = every.agg(F.sort_array(F.collect_list(F.struct("b", "t", "r"))).alias("rows"), F.sum("t").alias("ts"), F.sum("r").alias("rs"))
    s, total = F.lit(smoothing), F.lit(smoothing * buckets)
    ratio = lambda x: F.log((x["t"] + s) / (F.col("ts") + total)) - F.log((x["r"] + s) / (F.col("rs") + total))
    return one.select(F.transform("rows", lambda x: F.when(F.col("ts") > 0, ratio(x)).otherwise(F.lit(0.0))).alias("w"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, smoothing: float = SMOOTHING, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    labels: doc_id, quality; a document is trusted if any of its labels is 1. Null texts count as
    empty: all counts 0, base_failed true, kept false, score 0. Rows with a null doc_id are scored
    but never trusted; repeated rows each count. Without trusted documents every score is 0, so the
    base rules decide. Empty tables give an empty result. Other columns are ignored.
    """
    ready(docs.sparkSession)
    texts = pick(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    trusted = stored(pick(labels, "doc_id", "quality").filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct(), "trusted")
    hashed = texts.select("doc_id", "text", F.array_remove(F.split("text", SPACE_RUN), "").alias("words"))
    hashed = hashed.select("doc_id", F.transform("words", lambda w: F.xxhash64(w)).alias("wh"))
    weights = stored(bucket_weights(hashed, trusted, buckets, smoothing), "bucket-weights")
    rows = with_counts(texts).withColumn("buckets", _buckets(buckets)).withColumn("w", weights.scalar())
    mean = F.aggregate("buckets", F.lit(0.0), lambda a, b: a + F.get("w", b)) / F.size("buckets")
    rows = rows.withColumn("score", F.when(F.size("buckets") > 0, mean).otherwise(F.lit(0.0)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("score") >= min_score)).alias("kept"), "score")
