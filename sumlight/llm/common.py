"""What the Python-side operators share: words, hashes, chunks of documents, packed shuffles, components."""

from __future__ import annotations

import contextlib
import ctypes
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text, for Spark's regular expressions: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Tokens that a Python task holds at a time.
CHUNK_TOKENS = 2_000_000
CHUNK_DOCS = 50_000
LAST = np.iinfo(np.int64).max
ODD = np.uint64(0x9E3779B97F4A7C15)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free(df: DataFrame, name: str) -> str:
    """The name, with underscores after it if a column of df has it already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts and see that checkpoints have a folder.

    The folder is the one that the cluster names; only in local mode (tests), where none is named, one of this machine's is used.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir names no shared folder")
            import tempfile

            named = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(named)


def tidy(spark: SparkSession) -> None:
    """Let the driver give back what earlier plans held: heap, broadcast values, shuffle files and checkpoints.

    Its heap grows to its limit before the collector does that by itself, as single plans leave little.
    """
    spark.sparkContext._jvm.System.gc()


def tidy_executors(spark: SparkSession) -> None:
    """Let the executors' heaps shrink to what is in use, as tidy() does with the driver's, by a task for each core.

    A heap keeps the size to which an earlier step's tasks have made it grow, and Python's workers need memory beside it.
    In local mode the driver's heap is the only one.
    """
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        spark.range(0, sc.defaultParallelism, 1, sc.defaultParallelism).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def give_back() -> None:
    """Return what Arrow and malloc hold in reserve to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where malloc isn't glibc's
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, after which its Python worker keeps only what is in use.

    Spark keeps a worker for later tasks, takes up the one that has waited longest, and may have twice as many as it has
    cores, as some tasks need two. Without this each of them holds on to the most that any of its tasks needed.
    """
    def ending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return ending


def part_count(spark: SparkSession, items: int, per_part: int) -> int:
    """Partitions such that none gets many more than per_part items, and two for each core at least.

    A document gets an answer from each partition that holds some of its entries, so there are no more than that.
    """
    return max(2 * spark.sparkContext.defaultParallelism, -(-int(items) // per_part))


def part_keys(spark: SparkSession, parts: int) -> np.ndarray:
    """For each of so many partitions, a number that repartition(parts, number) deals to it alone."""
    found = spark.range(40 * parts).select(F.col("id").cast("int").alias("key"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p"))
    rows = dict(found.groupBy("p").agg(F.min("key")).collect())  # one row a partition
    return np.array([rows.get(p, p) for p in range(parts)], np.int32)


def crc(column) -> F.Column:
    """crc32 of an id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def crc_of(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text as UTF-8 bytes and rk, a key of the row: equal rows have equal keys."""
    return docs.select(F.xxhash64(F.col("doc_id"), F.col("text")).alias("rk"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)


class WordHashes(dict):
    """word -> 64-bit hash, kept for words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def grams(tokens: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n tokens; the order within a run counts."""
    size = max(0, len(tokens) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out *= ODD
        out += tokens[k : k + size]
    return mix(out)


@dataclass
class Chunk:
    """Documents whose tokens lie in one array; those of document d are tokens[starts[d]:starts[d + 1]]."""

    rk: np.ndarray
    ids: np.ndarray
    tokens: np.ndarray
    starts: np.ndarray
    extra: list

    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)

    def owner(self) -> np.ndarray:
        """The document of each token."""
        return np.repeat(np.arange(len(self.ids), dtype=np.int64), self.lengths())


def ids_of(column: pa.Array) -> np.ndarray:
    """Document ids as numbers, null as the largest."""
    return column.fill_null(int(LAST)).to_numpy(zero_copy_only=False).astype(np.int64)


def chunks(batches: Iterable[pa.RecordBatch], tokens_of: Callable[[bytes], np.ndarray], limit: int = CHUNK_TOKENS, extra: str | None = None) -> Iterator[Chunk]:
    """Documents of Arrow batches (rk, doc_id, text), in chunks of about so many tokens; null texts are empty."""
    rk, ids, parts, more, held = [], [], [], [], 0

    def chunk() -> Chunk:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return Chunk(np.array(rk, np.int64), np.array(ids, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), more)

    for batch in batches:
        extras = batch.column(extra).to_pylist() if extra else [None] * batch.num_rows
        for key, doc_id, text, other in zip(batch.column("rk").to_pylist(), ids_of(batch.column("doc_id")).tolist(), batch.column("text"), extras, strict=True):
            tokens = tokens_of(text.as_py() or b"")
            rk.append(key)
            ids.append(doc_id)
            parts.append(tokens)
            more.append(other)
            held += len(tokens)
            if held >= limit or len(ids) >= CHUNK_DOCS:
                yield chunk()
                rk, ids, parts, more, held = [], [], [], [], 0
    if ids:
        yield chunk()


def narrow(keys: np.ndarray, width: int) -> bytes:
    """The low bytes of each key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widen(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.reshape(-1).view("<u8")


def pack_gaps(index: np.ndarray) -> bytes:
    """Ascending numbers as the gaps between them: a byte each, or 255 and eight bytes."""
    gaps = np.diff(index, prepend=0).astype(np.int64)
    large = gaps >= 255
    return len(gaps).to_bytes(8, "little") + np.where(large, 255, gaps).astype(np.uint8).tobytes() + gaps[large].astype("<i8").tobytes()


def unpack_gaps(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    gaps = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    gaps[gaps == 255] = np.frombuffer(data, "<i8", -1, 8 + n)
    return np.cumsum(gaps)


def by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each part that occurs: the indices that belong to it, in ascending order."""
    order, begin = groups(part.astype(np.uint16) if parts <= 65536 else part)
    ends = np.append(begin[1:], len(order))
    for at, end in zip(begin.tolist(), ends.tolist(), strict=False):
        yield int(part[order[at]]), order[at:end]


#: Bytes of packed rows that go into one Arrow batch, or a little more.
BATCH = 2 << 20


def batched(rows: Iterable[tuple], fields: list[str], types: list[pa.DataType], limit: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Rows of numbers and bytes, in batches of about so many bytes."""
    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types, strict=True)], fields)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size >= limit:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Top bits deal keys out; the low 48 bits then tell apart the keys of a part."""
    return ((keys >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that brings equal keys together, and where each group begins in it."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(keys) else np.zeros(0, np.int64)


#: A key with more than this share of the rows, as a power of two, is heavy: there are 2**HEAVY of them at most.
HEAVY = 10
#: Narrow rows that a task may well take.
ROWS_A_PART = 100_000


def narrowed(df: DataFrame, rows: int) -> DataFrame:
    """df in no more partitions than so many narrow rows need; what precedes it up to a shuffle runs in as many tasks."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, rows // ROWS_A_PART))


def join_spread(rows: DataFrame, table: DataFrame, *keys: str, heavy: DataFrame | None = None) -> DataFrame:
    """rows joined with a table that has one row for each value of the keys, so that no key's rows come together.

    The table's rows for heavy keys, 2**HEAVY at most, are broadcast; the others are joined as Spark chooses. rows is read
    several times, so it should be cheap to read. heavy: the heavy keys, if they are known. Both sides are split by the keys'
    hashes, so a light key with a heavy one's hash is broadcast too, and nothing else is.
    """
    if heavy is None:
        total = rows.count()
        heavy = rows.groupBy(*keys).count().where(F.col("count") > (total >> HEAVY)).select(*keys)
    name = F.xxhash64(*[F.col(k).cast(rows.schema[k].dataType) for k in keys])
    found = [r[0] for r in heavy.select(name).collect()]  # 2**HEAVY at most
    if not found:
        return rows.join(table, list(keys))
    few = F.broadcast(table.where(name.isin(found)))
    return rows.where(name.isin(found)).join(few, list(keys)).unionByName(rows.where(~name.isin(found)).join(table, list(keys)))


#: Edges that a task of `_forest` holds at a time.
EDGES = 1_000_000


def star_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the given ones do: each node, but the least of its component, with that one."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    least = np.arange(len(nodes))
    while len(a):
        # Each root hooks on to the least one next to it, then all nodes get their new root.
        low, high = np.minimum(least[a], least[b]), np.maximum(least[a], least[b])
        np.minimum.at(least, high, low)
        while (least[least] != least).any():
            least = least[least]
        apart = least[a] != least[b]
        a, b = a[apart], b[apart]
    some = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[some], nodes[least[some]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges (u, v), with those left out that the others make superfluous."""
    u = v = np.zeros(0, np.int64)
    more: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        more.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        held += batch.num_rows
        if held >= EDGES:
            u, v = star_forest(*(np.concatenate(x) for x in zip((u, v), *more, strict=True)))
            more, held = [], 0
            if len(u) >= EDGES:
                yield out()
                u = v = np.zeros(0, np.int64)
    if more:
        u, v = star_forest(*(np.concatenate(x) for x in zip((u, v), *more, strict=True)))
    if len(u):
        yield out()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 200) -> DataFrame:
    """node, component (smallest node reachable) for the nodes of undirected edges, dealt by node.

    Each task first leaves a forest of its own edges. Then large-star and small-star rounds: a node's least neighbour is
    found by an aggregation with partial sums first, and meets the node's edges by join_spread, so a hub's edges are never
    gathered. What is left is done when no node has two lesser neighbours, or a lesser and a greater one. The edges are cut
    off from their lineage by checkpoint() in each round. The number of rounds grows with the logarithm of the nodes, squared
    at worst. Rounds and jobs are kept few, as each plan costs the driver memory for its code and threads.
    """
    own = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v")
    now = own.mapInArrow(giving_back(_forest), "u long, v long").distinct().checkpoint()
    n = 2 * now.count()
    now = narrowed(now, n)

    def nearest(rows: DataFrame) -> DataFrame:
        """u with m, the least of its v; degree; and whether it isn't yet an end or the middle of a star."""
        lesser, greater = F.count_if(F.col("v") < F.col("u")), F.count_if(F.col("v") > F.col("u"))
        open_ = (lesser > 1) | ((lesser > 0) & (greater > 0))
        return narrowed(rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"), open_.alias("open")), n).checkpoint()

    def meet(rows: DataFrame, best: DataFrame) -> DataFrame:
        """rows (u, v) with m of each u."""
        return join_spread(rows, best.select("u", "m"), "u", heavy=best.where(F.col("degree") > (n >> HEAVY)).select("u"))

    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = nearest(both).withColumn("m", F.least("m", "u"))
        ended = best.agg(F.sum("degree"), F.max("open")).first()
        if not ended[1]:
            return best.select(F.col("u").alias("node"), F.col("m").alias("component"))
        n = ended[0]
        large = meet(both, best).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = narrowed(large, n).checkpoint()
        small = meet(large, nearest(large)).where("u > m")
        now = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v")
        now = narrowed(now.mapInArrow(giving_back(_forest), "u long, v long").distinct(), n).checkpoint()
        tidy(now.sparkSession)
    raise RuntimeError("components didn't settle")
