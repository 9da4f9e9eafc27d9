"""Session helpers that every part of the library may use."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where that is unset, a local one will do only if all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
    return found or LOCAL_CHECKPOINTS


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it: lineage ends there, whatever executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables that stored() wrote and that nothing will read any more. What else a frame is stays."""
    for df in frames:
        path = getattr(df, "_stored_path", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, by exact name, though others may clash with them in all but case."""
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{df.columns.index(n)}").alias(n) for n in names])


def partitions(df: DataFrame) -> int:
    """A partition count that follows the input: the shuffle setting, or the scan's own split count if larger."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def small(df: DataFrame, size: Column, limit: int) -> bool:
    """True if the bytes that size gives over df's rows are at most limit; df should be stored."""
    return (df.agg(F.sum(size)).first()[0] or 0) <= limit
