"""Gaussian vectors as a function of seed, row and dimension, so that any rows can be made again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(*parts: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + 0.5) / float(1 << 53)


def vectors(spark: SparkSession, n: int, dim: int, seed: int = 0, begin: int = 0) -> DataFrame:
    """asset_id and embedding of the rows begin to n - 1; Box and Muller's transform of hashed uniforms."""
    one = lambda d: F.sqrt(-2 * F.log(_uniform(F.lit(seed), F.col("id"), d, F.lit(1)))) * F.cos(2 * F.pi() * _uniform(F.lit(seed), F.col("id"), d, F.lit(2)))
    return spark.range(begin, n).select(F.concat(F.lit("synthetic-"), F.col("id").cast("string")).alias("asset_id"), F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), one).cast("array<float>").alias("embedding"))
