"""The synthetic population: ordinals with geometric levels, of which the first few have the term 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def population(spark: SparkSession, seeds: int, n: int) -> DataFrame:
    """seed, id (0 to n - 1) and level for each trial."""
    digest = F.md5(F.concat_ws(":", F.concat(F.lit("S"), F.col("seed").cast("string")), F.col("id").cast("string")).cast("binary"))
    level = (F.lit(41) - F.length(F.bin(F.conv(F.substring(digest, 1, 10), 16, 10).cast("long")))).cast("int")
    rows = spark.range(seeds * n).select(F.floor(F.col("id") / n).alias("seed"), (F.col("id") % n).alias("id"))
    return rows.withColumn("level", level)


def level_heads(items: DataFrame, k: int) -> DataFrame:
    """The first k of each level and trial, with p and nonfull as the level estimator has them."""
    first = W.partitionBy("seed", "level").orderBy("id")
    u = items.withColumn("rl", F.row_number().over(first)).where(F.col("rl") <= k)
    full = F.when(F.col("rl") == k, F.pow(F.lit(2.0), -F.col("level"))).otherwise(0.0)
    walk = W.partitionBy("seed").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    u = u.withColumn("p", 1 - F.coalesce(F.sum(full).over(walk), F.lit(0.0)))
    return u.withColumn("nonfull", F.count("*").over(W.partitionBy("seed", "level")) < k)


def estimates(heads: DataFrame, n: int, thresholds: list[int]) -> DataFrame:
    """seed, threshold, estimate, rel_error of the sum of f = (id < threshold)."""
    own = W.partitionBy("seed", "nonfull").orderBy("id")
    back = F.col("nonfull") & (F.row_number().over(own) > F.floor(F.count("*").over(W.partitionBy("seed", "nonfull")) / 2))
    wide = heads.withColumn("back", back).select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    f = (F.col("id") < F.col("threshold")).cast("double")
    sums = wide.groupBy("seed", "threshold").agg(F.sum(f / F.col("p")).alias("hit"), F.sum(1 / F.col("p")).alias("w"), F.avg(F.when(F.col("back"), f)).alias("c"))
    estimate = F.col("hit") + F.col("c") * (n - F.col("w"))
    return sums.select("seed", "threshold", estimate.alias("estimate"), (F.abs(estimate - F.col("threshold")) / F.col("threshold")).alias("rel_error"))
