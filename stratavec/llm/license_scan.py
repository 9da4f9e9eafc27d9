"""License scans by diagonal voting, in DataFrame operations only.

All rolling word 2-grams of every text are hashed and joined to the positions of the same 2-grams
in the templates. A hit at word p of the text and word q of a template votes for the diagonal
p - q; a passage that follows the template without gaps gathers its votes on one diagonal, and
inserted or missing words only shift the diagonal a little. Votes are summed by diagonal, and each
diagonal is merged with its neighbours up to DRIFT further on, so a span is never longer than its
template and DRIFT. Where a span has enough of the template's 2-grams, it is verified: the hits that
rise in the text and in the template at once, in the longest such chain, must be a large enough
share of the template. A short phrase must be there whole: all its 2-grams on one diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratavec.session import pick, ready, stored

#: The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Passages of well-known licences, and the labels they give.
PASSAGES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "mpl",
    "the person who associated a work with this deed has dedicated the work to the public domain": "cc0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "creative commons zero": "cc0",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "all rights reserved": "reserved",
}
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
DRIFT = 6
SHARE = 0.6
WHOLE_WORDS = 5  # templates of fewer words must be there whole


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased: runs of digits, letters a-z and characters beyond ASCII."""
    return F.array_remove(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), SEPARATORS), "")


def templates(spark: SparkSession) -> DataFrame:
    """A row for each 2-gram of each template: its number, label, whether it is a base phrase, its words, the 2-gram and its position."""
    rows = [(i, text.split(), label, base) for i, (text, label, base) in enumerate([*((k, v, True) for k, v in PHRASES.items()), *((k, v, False) for k, v in PASSAGES.items())])]
    return spark.createDataFrame([(i, label, base, len(w), q, w[q], w[q + 1]) for i, w, label, base in rows for q in range(len(w) - 1)], "template int, label string, base boolean, size int, q int, w1 string, w2 string")


def _chain(near: Column) -> Column:
    """The most hits of diagonals (diagonal, found) that ascend both in the text and in the template: at most DRIFT + 1 times the template's 2-grams are looked at."""
    hits = F.array_sort(F.flatten(F.transform(near, lambda n: F.transform(n["found"], lambda q: F.struct((n["diagonal"] + q).alias("p"), q.alias("q"))))))
    best = lambda a: F.coalesce(F.array_max(F.transform(a, lambda y: y["n"])), F.lit(0))
    before = lambda a, x: F.filter(a, lambda y: (y["p"] < x["p"]) & (y["q"] < x["q"]))
    step = lambda a, x: F.array_append(a, F.struct(x["p"].alias("p"), x["q"].alias("q"), (best(before(a, x)) + 1).alias("n")))
    return F.aggregate(hits, F.array().cast("array<struct<p:int,q:int,n:int>>"), step, best)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest share of a template that an accepted span has in order (1 for a phrase that
    is there whole), or 0 if none is accepted. Null
    and empty texts have no words, n_base 0, null first_word and last_word, empty labels and score
    0. Rows are kept apart by a number of their own, so null and repeated doc_ids each give their
    row. An empty table gives an empty result; other columns are ignored. Votes are gathered per
    text, template and diagonal; a text's own hits are all that meet in one group.
    """
    spark = ready(docs.sparkSession)
    grams = templates(spark).withColumn("h", F.xxhash64("w1", "w2"))
    known = [r[0] for r in grams.select("h").distinct().collect()]
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", words_of(F.coalesce("text", F.lit(""))).alias("words"))
    pair = lambda w, i: F.struct(F.xxhash64(w, F.get("words", i + 1)).alias("h"), i.alias("p"), w.alias("w1"), F.get("words", i + 1).alias("w2"))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.filter(F.transform("words", pair), lambda x: x["h"].isin(known)).alias("hits"))
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "license-hits")
    hits = rows.select("rid", F.inline("hits")).join(F.broadcast(grams), ["h", "w1", "w2"])
    votes = hits.groupBy("rid", "template", "label", "base", "size", (F.col("p") - F.col("q")).alias("diagonal")).agg(F.collect_set("q").alias("found"))
    band = Window.partitionBy("rid", "template").orderBy("diagonal").rangeBetween(0, DRIFT)
    spans = votes.withColumn("near", F.collect_list(F.struct("diagonal", "found")).over(band))
    grams_of = F.col("size") - 1
    short = F.col("size") < WHOLE_WORDS
    whole = F.size("found") == grams_of
    enough = F.size(F.array_distinct(F.flatten(F.col("near.found")))) >= SHARE * grams_of
    chained = F.when(enough & ~short, _chain(F.col("near")) / grams_of)
    spans = spans.select("rid", "label", "base", "diagonal", whole.alias("whole"), F.when(short & whole, F.lit(1.0)).otherwise(chained).alias("share"))
    place, named = F.when(F.col("base") & F.col("whole"), F.col("diagonal")), F.col("share") >= SHARE
    found = spans.groupBy("rid").agg(
        F.count(place).alias("n_base"), F.min(place).cast("long").alias("first_word"), F.max(place).cast("long").alias("last_word"),
        F.sort_array(F.collect_set(F.when(place.isNotNull(), F.col("label")))).alias("base_set"), F.sort_array(F.collect_set(F.when(named, F.col("label")))).alias("label_set"),
        F.max(F.when(named, F.col("share"))).alias("score"),
    )
    out = rows.select("rid", "doc_id", "n_words").join(found, "rid", "left")
    joined = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        joined(F.col("base_set")).alias("base_labels"), joined(F.sort_array(F.array_union("base_set", "label_set"))).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
