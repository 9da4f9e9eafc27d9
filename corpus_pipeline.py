"""The corpus pipeline: language ID, exact dedup, n-gram Jaccard join, suffix-array dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of docs. Rows with a null doc_id, or that share one, are documents of their own:
where there are any, a stage numbers the rows by doc_id (null first), then text, and goes by those
numbers. Null texts count as empty, and go at the first stage, as do all texts without letters. An
empty table passes through all stages. Extra columns are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.llm.exact_dedup import exact_dedup
from stratavec.llm.language_id import identified
from stratavec.llm.ngram_join import ngram_join
from stratavec.llm.packing import best_fit_pack
from stratavec.llm.suffix_dedup import shortened
from stratavec.session import discard, pick, small, stored

#: Of the one-versus-rest margin, which does not depend on the number of languages.
MIN_MARGIN = 0.1
BROADCAST_BYTES = 16 << 20


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column of unique numbers that ascend with doc_id, and its name: doc_id itself if it will do."""
    ids = pick(docs, "doc_id")
    if ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").isEmpty():
        return docs, "doc_id"
    name = next(f"row_{i}" for i in range(len(docs.columns) + 1) if f"row_{i}" not in docs.columns)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    order = [f"c{names.index(n)}" for n in ("doc_id", "text")]
    rows = plain.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", F.monotonically_increasing_id())
    return stored(rows, "numbered").toDF(*names, name), name


def _without(docs: DataFrame, dropped: DataFrame, number: str) -> DataFrame:
    """docs but for the rows whose number is in dropped."""
    gone = stored(dropped.select(F.col("doc_id").alias("gone")), "dropped")
    gone = F.broadcast(gone) if small(gone, F.lit(16), BROADCAST_BYTES) else gone
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(number)
    left = plain.join(gone, F.col(f"c{at}") == F.col("gone"), "left_anti").toDF(*names)
    return left if number == "doc_id" else _cut_last(left)


def _cut_last(docs: DataFrame) -> DataFrame:
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*plain.columns[:-1]).toDF(*names[:-1])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin of MIN_MARGIN or more; those without letters go."""
    return identified(docs, MIN_MARGIN)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    rows, number = _numbered(docs)
    return _without(rows, exact_dedup(rows, id_col=number, unique=True).filter("NOT kept"), number)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id."""
    rows, number = _numbered(docs)
    return _without(rows, ngram_join(rows, id_col=number, unique=True).filter("doc_id <> component_id"), number)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that stand earlier in the corpus; n_chars is the length that is left."""
    rows, number = _numbered(docs)
    left = shortened(rows, number, "text")
    left = left if number == "doc_id" else _cut_last(left)
    names = left.columns
    plain = left.toDF(*[f"c{i}" for i in range(len(names))])
    length = F.char_length(F.col(f"c{names.index('text')}"))
    kind = dict(zip(names, plain.schema.fields, strict=True))
    return plain.select(*[length.cast(kind[n].dataType) if n == "n_chars" else F.col(c) for c, n in zip(plain.columns, names, strict=True)]).toDF(*names)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 1024 tokens."""
    return best_fit_pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("suffix-array dedup", passages),
    ("best-fit packing", packing),
]
#: SQL can express neither the language model, nor components, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table documents; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        read, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(read)  # if it is a stage's table, all that was made of it is written
    return STAGES[-1][1](spark, docs, sf_dir)
