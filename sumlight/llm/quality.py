"""Quality classifier: importance resampling by hashed n-gram generative models, with Gumbel top-k.

Two bags of hashed words and word pairs are counted: of target texts (labelled as good) and of the raw corpus. A text's
importance is the sum over its n-grams of log(p_target / p_raw). With Gumbel noise, keyed by doc_id, added to it, the
k largest sums are a sample without replacement in proportion to importance.

Target model: from labelled rows, at most MOST_ROWS of them, with the least hash of doc_id; that is the documented bound
of the sample. The raw model counts all texts. k is the share of target rows among all the labelled, of all documents,
unless a share is given.

The k-th largest sum is found without sorting: sums are mapped to integers in order, counted by their leading bits, and
only the boundary bucket is divided further. Rows that tie with the k-th are all taken; only repeated ids can tie.

Nulls and odd rows: null and empty texts have importance 0; null labels and labels without a document are left out; of
several labels for an id the largest counts; a null doc_id is scored like any other. Without labels all importances are
0 and the share is 1: all rows stay. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ODD, WordHashes, mix, prepare, read

BITS = 16
MOST_ROWS = 8_000
STEP = 16

_PIECES = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x09-\x0d\x20]+")


def grams(text: bytes, known: WordHashes) -> np.ndarray:
    """Places of a text's words, runs of punctuation, and pairs of neighbours; repeats stay."""
    hashes = known.of(_PIECES.findall(text))
    shift = np.uint64(64 - BITS)
    if len(hashes) < 2:
        return (mix(hashes) >> shift).astype(np.int64)
    return (np.concatenate([mix(hashes), mix(hashes[:-1] * ODD + hashes[1:])]) >> shift).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, sums = WordHashes(), np.zeros(1 << BITS, np.int64)
    for batch in batches:
        found = [grams(t.as_py() or b"", known) for t in batch.column("text")]
        sums += np.bincount(np.concatenate(found), minlength=1 << BITS) if found else 0
    place = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(sums[place])], ["place", "n"])


def bag(texts: DataFrame) -> np.ndarray:
    """How often each place occurs in all texts: 2**BITS sums, at any size of the corpus."""
    rows = texts.mapInArrow(_count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BITS)
    out[rows["place"].to_numpy()] = rows["n"].to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log(p_target / p_raw) by place; both with one added, in proportion to the raw model."""
    prior = (raw + 1) / (raw.sum() + len(raw))
    p = (target + len(raw) * prior) / (target.sum() + len(raw))
    return np.log(p / prior)


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = 0) -> DataFrame:
    """doc_id, importance and key, the importance with Gumbel noise."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = WordHashes(), sent.value
        for batch in batches:
            sums = [float(values[grams(t.as_py() or b"", known)].sum()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sums, pa.float64())], ["doc_id", "importance"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, importance double")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11) + 0.5) / float(1 << 53)
    return scored.withColumn("key", F.col("importance") - F.log(-F.log(uniform)))


def ordered(key: F.Column) -> F.Column:
    """Keys as 48-bit integers in their order: within +-1e8, and in steps of 2**-20."""
    inside = F.least(F.greatest(key, F.lit(-1e8)), F.lit(1e8))
    return F.floor((inside + 1e8) * float(1 << 20)).cast("long")


def top(weighed: DataFrame, k: int) -> DataFrame:
    """The rows with the k largest keys, and those that tie with the last."""
    coded = weighed.withColumn("code", ordered(F.col("key"))).checkpoint()
    prefix, rest = 0, k
    if k <= 0:
        return coded.where(F.lit(False)).drop("code")
    for bits in (32, 16, 0):
        here = coded.where(F.shiftright("code", bits + STEP) == prefix) if bits < 32 else coded
        rows = sorted(here.groupBy(F.shiftright("code", bits).alias("b")).count().collect(), reverse=True)  # 2**STEP at most
        if bits == 32 and sum(n for _, n in rows) <= k:
            return coded.drop("code")
        for b, n in rows:
            if rest <= n:
                prefix = b
                break
            rest -= n
    # Within one code, a 2**-20th of a key, the keys themselves decide.
    last = coded.where(F.col("code") == prefix).groupBy("key").count().orderBy(F.col("key").desc()).limit(rest).agg(F.min("key")).first()[0]
    return coded.where((F.col("code") > prefix) | (F.col("key") >= last)).drop("code")


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 0) -> DataFrame:
    """doc_id, importance and key of the documents that the sample holds."""
    prepare(docs.sparkSession)
    narrow = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id").limit(MOST_ROWS)
    total, good = known.agg(F.count("*"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0))).first()
    raw = bag(narrow)
    target = bag(narrow.join(F.broadcast(sample.where("quality = 1").select("doc_id")), "doc_id")) if good else raw
    share = share if share is not None else good / total if total and good else 1.0
    weighed = weigh(docs, log_ratio(target, raw) if good else np.zeros(len(raw)), seed)
    return top(weighed, round(share * docs.count()))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
