"""Rows of documents under unique keys, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.session import pick, stored


def keyed(docs: DataFrame, id_col: str, text_col: str, unique: bool = False) -> tuple[DataFrame, bool]:
    """key (long, unique), doc_id, text, copies, and whether keys are the doc_ids themselves. Rows in the order of doc_id have ascending keys.

    Where doc_ids are unique and not null, they are the keys and copies is 1. Otherwise rows that
    agree in doc_id and text are one row with their count in copies, and keys number the rows by
    doc_id (null first), then text; that table is stored. unique says that doc_ids are known to be
    the former.
    """
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if unique or rows.select("doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 OR doc_id IS NULL").isEmpty():
        return rows.select(F.col("doc_id").alias("key"), "doc_id", "text", F.lit(1).alias("copies")), True
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).groupBy("doc_id", "text").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    rows = rows.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
    return stored(rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text", "copies"), "keyed"), False


def repeated(rows: DataFrame) -> DataFrame:
    """Each row as often as its copies says, without that column."""
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("_copy", "copies")
