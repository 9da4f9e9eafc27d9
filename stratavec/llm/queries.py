"""The registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratavec.llm.bpe import bpe_round
from stratavec.llm.exact_dedup import exact_dedup
from stratavec.llm.html_extract import html_extract
from stratavec.llm.language_id import language_id
from stratavec.llm.license_scan import PHRASES, license_scan
from stratavec.llm.ngram_join import ngram_join
from stratavec.llm.packing import best_fit_pack
from stratavec.llm.quality_rules import quality_rules
from stratavec.llm.suffix_dedup import suffix_dedup
from stratavec.llm.toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(_table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_html_extract": op2_html_extract,
    "op3_bpe": op3_bpe,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_ngram_join": op8_ngram_join,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_quality_rules": op10_quality_rules,
}



def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7_license_scan that SQL can express."""
    return op7_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10_quality_rules that SQL can express."""
    return op10_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def packing_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents op9_best_fit_packing packs, and sequences and documents that break its rules."""
    pieces = op9_best_fit_packing(spark, sf_dir)
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("offset")) - F.col("length")
    placed = pieces.select("sequence_id", "offset", "length", (F.col("offset") != before).alias("gap"))
    sequences = placed.groupBy("sequence_id").agg(F.max("gap").alias("gap"), F.sum("length").alias("total"))
    begun = F.sum("length").over(Window.partitionBy("doc_id").orderBy("piece")) - F.col("length")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("piece")) - 1
    cut = pieces.select("doc_id", ((F.col("start") != begun) | (F.col("piece") != order) | ((F.col("piece") > 0) & (F.col("length") != 1024))).alias("bad"))
    documents = cut.groupBy("doc_id").agg(F.max("bad").alias("bad"))
    return documents.agg(F.count(F.lit(1)).alias("documents"), F.count_if("bad").alias("bad_documents")).crossJoin(
        sequences.agg(F.count_if(F.col("gap") | (F.col("total") > 1024)).alias("bad_sequences"))
    )


QUERIES |= {"license_base": license_base, "quality_base": quality_base, "packing_faults": packing_faults}

_SPACES = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _phrases() -> str:
    """CTE p: doc_id, n_words and the places of each base phrase."""
    places = ", ".join(
        f"list_filter(range(len(w)), lambda i: {' AND '.join(f'w[i + {k + 1}] = {chr(39)}{x}{chr(39)}' for k, x in enumerate(phrase.split()))}) AS p{j}" for j, phrase in enumerate(PHRASES)
    )
    return rf"""w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        p AS (SELECT doc_id, len(w) AS n_words, {places} FROM w)"""


ORACLE_SQL = {
    "op1_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(n - 99)) AS p FROM d)),
        r AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
        f AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS first FROM r),
        k AS (SELECT doc_id, p, sum(first) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM f),
        spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM k GROUP BY doc_id, k),
        cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
        found AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS removed, count(*) AS spans FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN found USING (doc_id)
    """,
    "op8_ngram_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACES}') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
        e AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
        both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, root FROM reach JOIN both_ ON a = doc_id)
        SELECT doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
    """,
    "license_base": f"""
        WITH {_phrases()}, q AS (SELECT *, list_concat(list_concat(p0, p1), list_concat(p2, p3)) AS every FROM p)
        SELECT doc_id, n_words::BIGINT AS n_words, len(every)::BIGINT AS n_base, list_min(every)::BIGINT AS first_word, list_max(every)::BIGINT AS last_word,
               array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN len(p{j}) > 0 THEN '{x}' END" for j, x in enumerate(PHRASES.values()))}], lambda x: x IS NOT NULL)), ',') AS base_labels FROM q
    """,
    "quality_base": f"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACES}') AS w FROM documents),
        g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
        r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        c AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM r, range(3) t(d) GROUP BY doc_id),
        b AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
              list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACES}')) AS l FROM w)
        SELECT doc_id, n_words, word_chars, n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
               n_words < 50 OR 100 * coalesce(n, 0) > 50 * n_words AS base_failed
        FROM b LEFT JOIN c USING (doc_id)
    """,
    "packing_faults": "SELECT count(*) AS documents, 0::BIGINT AS bad_documents, 0::BIGINT AS bad_sequences FROM documents",
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        WINDOW same AS (PARTITION BY t)
    """,
}
