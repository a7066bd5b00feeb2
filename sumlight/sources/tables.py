"""Reading, writing and ordering tables of items."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the cluster names; in local mode, where it names none, one of this machine's."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir names no shared folder")
            import tempfile

            named = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def open_items(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, stream: bool = False) -> DataFrame:
    """Items of JSON lines or Parquet files, as a table or, with a schema, as a stream of files."""
    reader = spark.readStream.option("maxFilesPerTrigger", "1") if stream else spark.read
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def require(df: DataFrame, *columns: str) -> None:
    """An error that lists what there is, if a column is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")


def text_items(df: DataFrame, columns: list[str], ids: list[str], min_chars: int = 1, order: str | None = None, seen: Observation | None = None) -> DataFrame:
    """asset_id and text: truthy columns joined and stripped, short ones dropped; ids joined by |.

    A row without an id is (unknown) or, with the column that rows are ordered by, its place in that order, from 0.
    An observation gets the numbers of rows written and skipped.
    """
    require(df, *columns, *ids, *([order] if order else []))
    kinds = dict(df.dtypes)
    # Numbers are truthy unless 0, strings unless empty.
    texts = [F.col(c) if kinds[c] == "string" else F.when(F.col(c).cast("string").isin("0", "0.0", "false"), None).otherwise(F.col(c).cast("string")) for c in columns]
    own = T.stripped_id(T.joined_id(*[F.col(c) for c in ids]))
    if order:
        df, own = ordinals(df, order), F.coalesce(own, F.col("ordinal").cast("string"))
    out = df.select(F.coalesce(own, F.lit("(unknown)")).alias("asset_id"), T.joined_text(*texts).alias("text"))
    return counted(out, F.length("text") >= min_chars, seen)


def counted(rows: DataFrame, use: Column, seen: Observation | None) -> DataFrame:
    """The rows that are of use; the observation counts them as written, and the others as skipped, when rows are read."""
    if seen is not None:
        rows = rows.observe(seen, F.count(F.when(use, 1)).alias("written"), F.count(F.when(~F.coalesce(use, F.lit(False)), 1)).alias("skipped"))
    return rows.where(use)


def category_union(categories: dict[str, DataFrame], item: dict[str, str]) -> DataFrame:
    """The categories' items one after the other; ids begin with the category."""
    parts = [df.select(F.lit(name).alias("category"), F.concat_ws("|", F.lit(name), F.col(item[name]).cast("string")).alias("asset_id"), F.col("text")) for name, df in categories.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ordinals(df: DataFrame, key: str) -> DataFrame:
    """df with ordinal, the row's place in the order of a key: ranges are numbered apart, and their sizes added up."""
    shared_folder(df.sparkSession)
    parted = df.repartitionByRange(F.col(key)).withColumn("part", F.spark_partition_id()).checkpoint()
    sizes = parted.groupBy("part").count()  # a row for each partition
    before = sizes.select("part", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("part").orderBy(key)) - 1
    return parted.withColumn("place", place).join(before, "part").withColumn("ordinal", F.col("before") + F.col("place")).drop("part", "place", "before")


def write_shards(df: DataFrame, path: str, chunk_rows: int, raw: bool = True, normalised: bool = False) -> None:
    """Vectors beside their ids, in files of chunk_rows rows at most."""
    from ..functions.vectors import normalised as unit

    if not (raw or normalised):
        raise ValueError("nothing to write: choose raw, normalised or both")
    out = df.select("*", *([unit(F.col("embedding")).cast("array<float>").alias("normalised_embedding")] if normalised else []))
    out = out if raw else out.drop("embedding")
    out.write.mode("overwrite").option("maxRecordsPerFile", chunk_rows).parquet(path)


def write_single(df: DataFrame, path: str) -> None:
    """One file; a table without rows is an error."""
    if df.isEmpty():
        raise ValueError("no rows to write")
    df.coalesce(1).write.mode("overwrite").parquet(path)


def manifest(df: DataFrame, key: str, chunk_rows: int) -> DataFrame:
    """shard, n_rows, first and last ordinal and key of the shards that rows in order of a key fill."""
    rows = ordinals(df.select(key), key).withColumn("shard", F.floor(F.col("ordinal") / chunk_rows))
    return rows.groupBy("shard").agg(F.count("*").alias("n_rows"), F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))


def save_results(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("append").partitionBy(*by).parquet(path)


def combine_results(spark: SparkSession, path: str, ignore_corrupt: bool = True) -> DataFrame:
    """All result shards under a path; unreadable files are passed over."""
    return spark.read.option("mergeSchema", "true").option("ignoreCorruptFiles", str(ignore_corrupt).lower()).parquet(path)


def same_geometry(spark: SparkSession, path: str, geometry: dict) -> None:
    """Keeps a run's geometry beside its output; a run that continues with another one is refused."""
    try:
        held = json.loads(spark.read.text(f"{path}/_geometry_json").first()[0])
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        spark.createDataFrame([(json.dumps(geometry, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/_geometry_json")
        return
    if held != geometry:
        raise ValueError(f"the output was written with {held}, not {geometry}")
