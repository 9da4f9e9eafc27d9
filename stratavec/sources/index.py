"""Compiled indexes: encoded rows as Parquet with a one-row header beside them; loading, compaction, tombstones."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratavec.functions.energy import active_tier, tier_energy
from stratavec.functions.spec import FLOAT, IndexSpec, UnsupportedLayout
from stratavec.functions.transform import encode
from stratavec.session import stored

VALID = 2
PAYLOAD_BLOCK = 8 << 20
TOMBSTONE = 1


@dataclass
class Index:
    """Rows row_idx, id, meta, is_live, the code columns, and vec_h if there is a half vector; and how to search them.

    A loaded index has its half vectors apart, as payload: row_idx, id, vec_h in the order of row_idx.
    """

    rows: DataFrame
    spec: IndexSpec
    weights: np.ndarray | None = None
    budget: float = 0.90
    payload: DataFrame | None = None

    @property
    def has_half(self) -> bool:
        return self.payload is not None or "vec_h" in self.rows.columns

    def whole(self) -> DataFrame:
        """The rows with their half vectors beside them."""
        return self.rows if self.payload is None else self.rows.join(self.payload.select("row_idx", "vec_h"), "row_idx")

    @property
    def last_tier(self) -> int:
        return active_tier(tier_energy(self.spec.tiers, self.spec.dim, self.weights), self.budget)

    def size(self) -> int:
        return self.rows.count()

    def info(self) -> dict:
        s = self.spec
        return {"dim": s.dim, "size": self.size(), "planet_id": s.planet_id, "radius": s.radius, "tiers": list(s.tiers), "q_mode": s.q_mode, "half": self.has_half}


def numbered(df: DataFrame, order_by: str) -> DataFrame:
    """df with row_idx, 0-based by order_by. Parts of the order are numbered on their own and shifted by the sizes of those before, so no task has all rows."""
    parts = stored(df.repartitionByRange(F.col(order_by)).sortWithinPartitions(order_by).withColumn("_n", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_n", 33).alias("_part")
    sizes = parts.groupBy(part).agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))  # a row per part
    return parts.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("row_idx", F.col("_before") + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))).drop("_n", "_part", "_before")


def build(records: DataFrame, spec: IndexSpec, id_col: str = "id", vector_col: str = "vector", row_idx_col: str | None = None, order_by: str | None = None) -> DataFrame:
    """Index rows of records. row_idx_col names a column of positions that is there already; otherwise rows are numbered by order_by (the id by default)."""
    if row_idx_col is None:
        records = numbered(records, order_by or id_col)
        row_idx_col = "row_idx"
    rows = records.select(F.col(row_idx_col).cast("long").alias("row_idx"), F.col(id_col).cast("long").alias("id"), F.lit(VALID).cast("long").alias("meta"), F.lit(True).alias("is_live"), F.col(vector_col).alias("vector"))
    return encode(rows, spec)


def header(spec: IndexSpec) -> str:
    return json.dumps({"magic": "PLAN", "dim": spec.dim, "tiers": list(spec.tiers), "q_mode": spec.q_mode, "half": spec.half, "planet_id": spec.planet_id, "radius": spec.radius})


def write(rows: DataFrame, path: str, spec: IndexSpec) -> None:
    """Codes in the order of the first of them, so that a vote's gate prunes; half vectors apart, in the order of positions, so that a search fetches few."""
    spark = rows.sparkSession
    codes = rows.drop("vec_h")
    first = F.col("row_idx" if spec.q_mode == FLOAT else spec.code_columns()[0])
    codes.repartitionByRange(first).sortWithinPartitions(first).write.mode("overwrite").parquet(f"{path}/rows")
    if "vec_h" in rows.columns:
        rows.select("row_idx", "id", "vec_h").repartitionByRange("row_idx").sortWithinPartitions("row_idx").write.mode("overwrite").option("parquet.block.size", PAYLOAD_BLOCK).parquet(f"{path}/payload")
    spark.createDataFrame([(header(spec),)], "header string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def compile_index(records: DataFrame, path: str, spec: IndexSpec, **columns) -> None:
    """Encodes records once and writes them; an index without records is refused."""
    if records.isEmpty():
        raise ValueError("an index needs records")
    write(stored(build(records, spec, **columns), "encoded"), path, spec)


def load_index(spark: SparkSession, path: str, weights: np.ndarray | None = None, budget: float = 0.90) -> Index:
    """An index as it was written; its header says whether it has half vectors."""
    head = json.loads(spark.read.text(f"{path}/header").first()[0])
    if head.get("magic") != "PLAN":
        raise UnsupportedLayout(f"{path} has no index header")
    spec = IndexSpec(head["dim"], tuple(head["tiers"]), head["q_mode"], head["half"], head["planet_id"], head["radius"])
    payload = spark.read.parquet(f"{path}/payload") if head["half"] else None
    return Index(spark.read.parquet(f"{path}/rows"), spec, weights, budget, payload)


def _layout(spec: IndexSpec) -> tuple:
    return spec.planet_id, spec.radius, spec.dim, spec.tiers, spec.q_mode


def concatenated(sources: list[Index]) -> Index:
    """All rows of sources in the order of the list, renumbered; duplicates and tombstones stay. Half vectors stay only if all have them."""
    if not sources or len({_layout(s.spec) for s in sources}) != 1:
        raise UnsupportedLayout("only indexes of one layout can be joined")
    half = all(s.has_half for s in sources)
    out, before = None, 0
    for i, s in enumerate(sources):
        rows = s.whole() if half else s.rows.drop("vec_h")
        rows = rows.withColumn("row_idx", F.col("row_idx") + F.lit(before))
        out = rows if out is None else out.unionByName(rows)
        if i + 1 < len(sources):
            before += s.size()
    first = sources[0]
    spec = IndexSpec(first.spec.dim, first.spec.tiers, first.spec.q_mode, half, first.spec.planet_id, first.spec.radius, first.spec.signs)
    return Index(out, spec, first.weights, first.budget)


def compact(spark: SparkSession, paths: list[str], target: str) -> None:
    whole = concatenated([load_index(spark, p) for p in paths])
    write(stored(whole.rows, "compacted"), target, whole.spec)


def tombstoned(index: Index, condition) -> Index:
    """The index with the rows that meet a condition marked as deleted."""
    meta = F.when(condition, F.col("meta").bitwiseOR(F.lit(TOMBSTONE))).otherwise(F.col("meta"))
    rows = index.rows.withColumn("meta", meta).withColumn("is_live", F.col("meta").bitwiseAND(F.lit(TOMBSTONE)) == 0)
    return Index(rows, index.spec, index.weights, index.budget, index.payload)
