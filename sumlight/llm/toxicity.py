"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of its words, pairs of neighbours and pairs with one word between, hashed into
2**BITS places. Words are taken after lower-casing A-Z and dropping ASCII punctuation. Each coordinate has its own
learning rate; the L1 term keeps most weights at zero, so the weights that remain are few and their number is
bounded by the number of places, whatever the size of the corpus: they are broadcast as two arrays.

Learning: labelled rows outside the held-out fifth, at most MOST_ROWS of them and MOST_CHARS characters, those with the
least hash of doc_id; this is the documented bound of the sample. Of several documents with a labelled id, the one whose
text has the least hash is learned from. A text that doesn't fit into the rest of the characters is passed over, and if
none fits, that is an error. One task learns from the sample, and the driver gets only the weights. Scoring covers every
whole text.

Nulls and odd rows: a null or empty text has the bias alone as its score; labels that are null or without a document
are left out; of several labels for one id the largest counts; a null doc_id is scored as any other. With no usable
labels every score is 0.5 * (1 - 1e-9), below the threshold. Repeated rows get equal scores. An empty table gives an
empty result. Clashing extra columns are ignored, or kept as they are by `flag`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ODD, WordHashes, crc, free, giving_back, mix, prepare, read

BITS = 20
MOST_ROWS = 8_000
MOST_CHARS = 32_000_000
HELD_OUT = 5

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def features(hashes: np.ndarray) -> np.ndarray:
    """Distinct places of a text's words, pairs and skip-pairs, ascending."""
    shift = np.uint64(64 - BITS)
    kinds = [mix(hashes)]
    if len(hashes) > 1:
        kinds.append(mix(hashes[:-1] * ODD + hashes[1:]))
    if len(hashes) > 2:
        kinds.append(mix((hashes[:-2] * ODD + hashes[2:]) ^ np.uint64(0x5BF03635)))
    return np.unique(np.concatenate(kinds) >> shift).astype(np.int32)


@dataclass
class Weights:
    places: np.ndarray
    values: np.ndarray
    bias: float


def learn(rows: list[tuple[np.ndarray, int]], alpha: float = 2.0, beta: float = 1.0, l1: float | None = None, l2: float = 0.0, epochs: int = 4) -> Weights:
    """FTRL-proximal over the rows in the order given; features count as 1 each. l1: by default 1 for each 1000 rows."""
    l1 = max(1.0, len(rows) / 1000) if l1 is None else l1
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    for _ in range(epochs):
        for at, label in rows:
            za, na = z[at], n[at]
            root = np.sqrt(na)
            w = np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + root) / alpha + l2))
            bias = -zb / ((beta + np.sqrt(nb)) / alpha)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - label
            sigma = (np.sqrt(na + g * g) - root) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * bias
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    places = np.flatnonzero(w)
    return Weights(places.astype(np.int32), w[places].astype(np.float32), float(-zb / ((beta + np.sqrt(nb)) / alpha)))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        found = [features(known.of(words(t.as_py() or b""))).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("label"), pa.array(found, pa.binary())], ["order", "label", "places"])


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows (order, label, places), in that order, as one row."""
    rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0])
    if rows:
        w = learn([(np.frombuffer(places, np.int32), label) for _, label, places in rows])
        yield pa.RecordBatch.from_arrays([pa.array([w.places.tobytes()], pa.binary()), pa.array([w.values.tobytes()], pa.binary()), pa.array([w.bias], pa.float64())], ["places", "weights", "bias"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = MOST_ROWS, most_chars: int = MOST_CHARS) -> Weights:
    """Weights from labelled rows outside the held-out fifth."""
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc(F.col("doc_id")) % HELD_OUT != 0))
    usable = usable.groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("label"))
    sample = usable.withColumn("order", F.xxhash64(F.col("doc_id").cast("long"))).orderBy("order", "doc_id").limit(most_rows)
    # At most most_rows narrow rows, so this side may be broadcast at any size of the corpus.
    joined = docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(sample), "doc_id").select("order", "label", "text", F.xxhash64("text").alias("hash"))
    sizes = joined.groupBy("order").agg(F.min(F.struct("hash", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))).alias("one"))
    held = sorted((r.order, r.one["hash"], r.one["size"]) for r in sizes.collect())  # one row for each row of the sample
    if not held:
        return Weights(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0)
    left, fit = most_chars, []
    for order, one, size in held:
        if size <= left:
            left -= size
            fit.append((order, one))
    if not fit:
        raise ValueError(f"none of the {len(held)} labelled texts has at most {most_chars} characters")
    # Equal rows become one before one task takes them, so it holds most_rows rows at most; only weights go to the driver.
    chosen = F.broadcast(docs.sparkSession.createDataFrame(fit, "order long, hash long"))
    rows = joined.join(chosen, ["order", "hash"]).select("order", "label", "text").mapInArrow(giving_back(_featurise), "order long, label int, places binary").groupBy("order").agg(F.min(F.struct("label", "places")).alias("one"))
    found = rows.select("order", "one.label", "one.places").repartition(1).mapInArrow(giving_back(_learned), "places binary, weights binary, bias double").first()
    return Weights(np.frombuffer(found["places"], np.int32), np.frombuffer(found["weights"], np.float32), found["bias"])


def score(docs: DataFrame, weights: Weights, *keep: str, into: str = "score") -> DataFrame:
    """The columns named, of docs with text, and the score in a column of the name given."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((weights.places, weights.values, weights.bias))
    narrow = docs.select(*keep, F.col("text").cast("binary").alias(free(docs, "text_bytes")))
    schema = docs.select(*keep).schema.add(into, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, values, bias = sent.value
        w, known = np.zeros(1 << BITS, np.float32), WordHashes()
        w[places] = values
        for batch in batches:
            sums = np.array([w[features(known.of(words(t.as_py() or b"")))].sum(dtype=np.float64) for t in batch.columns[-1]])
            out = 1.0 / (1.0 + np.exp(-np.clip(sums + bias, -500, 500)))
            if not len(places) and not bias:
                out = np.full(len(sums), 0.5 * (1 - 1e-9))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], [*batch.schema.names[:-1], into])

    return narrow.mapInArrow(giving_back(run), schema)


def flag(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    prepare(docs.sparkSession)
    scored = score(docs, train(docs, labels), "doc_id")
    return scored.select("doc_id", (crc(F.col("doc_id")) % HELD_OUT == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
