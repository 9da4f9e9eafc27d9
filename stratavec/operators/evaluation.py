"""How good results are: recall, confusion matrices, distance statistics, threshold sweeps, candidate trade-offs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratavec.operators.knn import batch_search
from stratavec.sources.index import Index


def recall(truth: DataFrame, found: DataFrame, k: int, within: int | None = None) -> DataFrame:
    """truth and found: qid, rank, id. One row: k, and the mean over queries of the share of the true k best that the first `within` results have."""
    n = within or k
    best = truth.filter(F.col("rank") <= k).select("qid", "id")
    hits = best.join(found.filter(F.col("rank") <= n).select("qid", "id").withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    each = hits.groupBy("qid").agg((F.sum(F.coalesce("hit", F.lit(0))) / k).alias("share"))
    return each.agg(F.lit(k).alias("k"), F.avg("share").alias("recall"))


def confusion(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, and precision, recall_rate and f1, 0 where undefined."""
    counts = rows.agg(*[F.count_if((predicted == p) & (actual == a)).alias(n) for n, p, a in (("tp", True, True), ("fp", True, False), ("fn", False, True), ("tn", False, False))])
    share = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, F.lit(1)).otherwise(b))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return counts.select("tp", "fp", "fn", "tn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall_rate"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def distance_stats(pairs: DataFrame, label: str) -> DataFrame:
    """pairs: label, dist. Per label: n, mean, population deviation, smallest and largest distance."""
    return pairs.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg("dist").alias("mean"), F.stddev_pop("dist").alias("deviation"), F.min("dist").alias("least"), F.max("dist").alias("most"))


def threshold_sweep(profile: DataFrame) -> DataFrame:
    """profile: target (boolean), least, most and nth (null if there are fewer) distance of each row to the queries. One row: the threshold from the least target distance up to the largest other one (excluded) with the best F1 when rows with nth distances within it are predicted; the first of equals.

    A row turns positive at its nth smallest distance, so counts by that distance, and sums of them,
    give every threshold's matrix. Only these counts are shuffled.
    """
    span = profile.agg(F.min(F.when(F.col("target"), F.col("least"))).alias("low"), F.max(F.when(~F.col("target"), F.col("most"))).alias("high"))
    total = profile.agg(F.count_if("target").alias("targets"))
    turn = profile.filter("nth IS NOT NULL").select("target", F.col("nth").alias("at"))
    by = turn.groupBy("at").agg(F.count_if("target").alias("t"), F.count_if(~F.col("target")).alias("o"))
    points = span.filter("low < high").select(F.explode(F.sequence("low", F.col("high") - 1)).alias("threshold"))
    both = points.select("threshold", F.lit(0).alias("t"), F.lit(0).alias("o"), F.lit(True).alias("asked")).unionByName(by.select(F.col("at").alias("threshold"), "t", "o", F.lit(False).alias("asked")))
    upto = Window.orderBy("threshold").rangeBetween(Window.unboundedPreceding, 0)  # distances are at most 64 x words: a bounded list
    curve = both.withColumn("tp", F.sum("t").over(upto)).withColumn("fp", F.sum("o").over(upto)).filter("asked").crossJoin(total)
    f1 = F.when(F.col("tp") == 0, F.lit(0.0)).otherwise(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("targets")))
    return curve.select("threshold", "tp", "fp", f1.alias("f1")).orderBy(F.desc("f1"), "threshold").limit(1)


def tradeoff(index: Index, truth: DataFrame, queries: DataFrame, sizes: list[int], top: int = 10) -> DataFrame:
    """For each candidate size k: k, reduction (the share of rows not reranked), and how many of the true top are among the k results."""
    n, out = index.size(), None
    for k in sizes:
        found = batch_search(index, queries, k, candidates=k)
        row = recall(truth, found, top, within=k).select(F.lit(k).alias("k"), F.lit(1 - k / n).alias("reduction"), "recall")
        out = row if out is None else out.unionByName(row)
    return out


def density(stats: DataFrame, mean: str, deviation: str, points: int = 1000, high: float = 384.0) -> DataFrame:
    """The normal density of each row's mean and deviation at so many points from 0 to high: x, y beside the row."""
    at = stats.withColumn("x", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i * F.lit(high / (points - 1)))))
    z = (F.col("x") - F.col(mean)) / F.col(deviation)
    return at.withColumn("y", F.exp(-0.5 * z * z) / (F.col(deviation) * F.sqrt(F.lit(2 * 3.141592653589793))))


def throughput(rows: int, queries: int, seconds: float) -> dict:
    """Million vector comparisons a second, and microseconds a query."""
    return {"mvps": rows * queries / seconds / 1e6, "us_per_query": seconds / queries * 1e6}


def write_metrics(spark: SparkSession, metrics: dict, path: str) -> None:
    """A benchmark's figures as one line of JSON, wherever Spark can write."""
    spark.createDataFrame([(json.dumps(metrics, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
