"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumlight.llm import decontamination, mixing, ngram_join, pii, toxicity
from sumlight.llm.common import free, prepare, read, tidy_executors


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from `labels`, doesn't mark as toxic."""
    prepare(spark)
    into = free(docs, "toxicity_score")
    scored = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")), *docs.columns, into=into)
    return scored.where(F.col(into) < 0.5).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near copies connect (five words, similarity 0.8 or more), the one with the least doc_id."""
    return ngram_join.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of `benchmark`."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the text. The key: see pii.configured."""
    new = pii.replace(docs, pii.configured(spark)).withColumn("n_chars", F.length("text").cast("long"))
    return new.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target, copies and taken.

    Where docs has a column of such a name, the new one has an underscore after it.
    """
    size, source_size, target, copies = (F.col(f"`{c}`") for c in mixing.added(docs).values())
    mixed = mixing.apply_mix(docs).where(copies > 0)
    new = {"size": size, "source_size": source_size, "target": target, "copies": copies, "taken": copies * size}
    return mixed.select(*docs.columns, *(c.alias(free(docs, name)) for name, c in new.items()))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def fresh(stage: Stage) -> Stage:
    """The stage, begun with executors' heaps that hold no more than is in use."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tidy_executors(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", fresh(drop_toxic)),
    ("near_copies", drop_near_copies),  # it does so itself
    ("decontamination", fresh(drop_contaminated)),
    ("pii", fresh(replace_pii)),
    ("mixing", fresh(mix_sources)),
]

#: A trained classifier is no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for `documents`. Stages write to the folder for checkpoints; only the last folder stays."""
    prepare(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            _delete(spark, before)
        before = out
    return docs
