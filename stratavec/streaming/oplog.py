"""Operation logs fed by Structured Streaming: appended exactly once, and folded when read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratavec.operators.delta import DELETE, INSERT, live

COLUMNS = ("seq", "op", "id", "vector")


def valid(stream: DataFrame, dim: int) -> DataFrame:
    """The operations that can be applied: known kinds, and vectors of the right length for inserts."""
    fits = F.coalesce(F.size("vector") == dim, F.lit(False))
    return stream.select(*COLUMNS).filter(F.col("seq").isNotNull() & F.col("id").isNotNull() & ((F.col("op") == DELETE) | ((F.col("op") == INSERT) & fits)))


def ingest(stream: DataFrame, path: str, checkpoint: str, dim: int, once: bool = True) -> StreamingQuery:
    """Appends a stream of operations to the log at path. The file sink and the checkpoint make each batch count once."""
    writer = valid(stream, dim).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def activity(stream: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Inserts and deletes per window of event time; what comes later than `late` is dropped by the watermark."""
    kinds = [F.count_if(F.col("op") == k).alias(n) for n, k in (("inserts", INSERT), ("deletes", DELETE))]
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(*kinds).select("window.start", "window.end", "inserts", "deletes")


def current(spark, path: str) -> DataFrame:
    """The live entries of a log; an operation that was sent twice (same seq) counts once."""
    return live(spark.read.parquet(path).dropDuplicates(["seq"]))
