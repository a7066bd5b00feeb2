"""Substring dedup: difference-cover anchors propose repeated windows, and 96-bit hashes of these settle them.

A window is SPAN = 13 words in a row, unchanged. A word goes if some window over it also starts in a document with a
smaller doc_id; windows are judged on the input.

Positions 0, 1 and 3 modulo 7 are a difference cover: for any two positions there is a shift below 7 that brings both
into it. So two equal windows, wherever they begin in their documents, hold an equal run of SPAN - 6 = 7 words that
begins at a cover position in both. Only these anchors, three in seven positions, are hashed and dealt out. An anchor
that occurs in two documents is then extended: the windows around it are hashed whole, and for each window the least
doc_id that has it decides. Words are compared by 64-bit hashes of them, windows by 96-bit hashes of those: of 2e13
windows, those of 100 TB of text, some two that differ would have one hash with a probability of 0.003.

Nulls and odd rows: a null or empty text has no words; texts under 13 words have no window and stay whole. A null
doc_id counts as the largest. Rows with one doc_id are one document's: they don't remove each other's words. Repeated
rows stay, with equal values. An empty table gives an empty result. Other columns are ignored.

Scale: what is dealt out by hash is packed, 7 or 13 bytes an entry, and a task sends each hash once for each of its
chunks of documents, from the chunk's least document: the others of the chunk are settled there. So a passage in a
third of all documents reaches a partition once a chunk, not once a document. Partitions grow in number with the
words. Flags return to documents by row key. The texts are dealt out by that key once, for both of the joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Chunk, WordHashes, batched, by_part, chunks, documents, grams, groups, mix, narrow, pack_gaps, part_count, part_keys, parts_of, prepare, read, unpack_gaps, widen

SPAN = 13
PERIOD = 7
COVER = np.array([True, True, False, True, False, False, False])
ANCHOR = SPAN - PERIOD + 1
#: Bytes of a hash that are sent: anchors only propose, windows decide. What is beyond 8 bytes is of a second hash.
ANCHOR_BYTES, WINDOW_BYTES = 6, 12
SECOND = np.uint64(0x9FB21C651E98DF25)
#: Entries that a partition holds.
PER_PART = 8_000_000

_SENT = "part int, width int, keys binary, gaps binary, starts binary, rks binary, ids binary"
_FIELDS = ["part", "width", "keys", "gaps", "starts", "rks", "ids"]
_TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 5]


def _places(chunk: Chunk, n: int) -> np.ndarray:
    """Where in the chunk runs of n words begin that lie within a document."""
    left = np.repeat(chunk.starts[1:], chunk.lengths())[: max(0, len(chunk.tokens) - n + 1)]
    return np.flatnonzero(left - np.arange(len(left)) >= n)


def _anchors(chunk: Chunk) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the anchors, and where they begin."""
    at = _places(chunk, ANCHOR)
    inside = at - np.repeat(chunk.starts[:-1], chunk.lengths())[at]
    long = np.repeat(chunk.lengths() >= SPAN, chunk.lengths())[at]
    at = at[COVER[inside % PERIOD] & long]
    return [grams(chunk.tokens, ANCHOR)[at]], at


def _within(size: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of so many places lie in one of the ranges."""
    return np.cumsum(np.bincount(begin, minlength=size + 1) - np.bincount(end, minlength=size + 1))[:size] > 0


def _windows(chunk: Chunk) -> tuple[list[np.ndarray], np.ndarray]:
    """Both hashes of the windows that hold a flagged anchor, and where they begin."""
    found = [(unpack_gaps(body) + chunk.starts[d], chunk.starts[d]) for d, bodies in enumerate(chunk.extra) for body in bodies or ()]
    at = _places(chunk, SPAN)
    if not found:
        return [np.zeros(0, np.uint64)] * 2, at[:0]
    anchors = np.concatenate([a for a, _ in found])
    first = np.repeat([b for _, b in found], [len(a) for a, _ in found])
    at = at[_within(len(chunk.tokens), np.maximum(anchors - (PERIOD - 1), first), anchors + 1)[at]]
    return [grams(chunk.tokens, SPAN)[at], grams(mix(chunk.tokens ^ SECOND), SPAN)[at]], at


def _alike(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings together entries whose hashes all agree, and where each group begins in it."""
    order, begin = groups(keys[0])
    new = np.zeros(len(order), bool)
    new[begin] = True
    for more in keys[1:]:
        if len(order) and np.any((more[order][1:] != more[order][:-1]) & ~new[1:]):
            order = np.lexsort(keys[::-1])
            new = np.ones(len(order), bool)
            new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
            break
    return order, np.flatnonzero(new)


def _settle(keys: list[np.ndarray], ids: np.ndarray, shared: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether its key is flagged among these, and whether its id is the least that has the key.

    shared: a key in two documents is flagged in both; else it is flagged in those that aren't the least.
    """
    if not len(ids):
        return np.zeros(0, bool), np.zeros(0, bool)
    order, begin = _alike(keys)
    size = np.diff(np.append(begin, len(ids)))
    least = np.repeat(np.minimum.reduceat(ids[order], begin), size)
    if shared:
        most = np.repeat(np.maximum.reduceat(ids[order], begin), size)
        flagged = most > least
    else:
        flagged = ids[order] > least
    out, first = np.empty(len(ids), bool), np.empty(len(ids), bool)
    out[order], first[order] = flagged, ids[order] == least
    return out, first


def _packed(keys: list[np.ndarray], at: np.ndarray, width: int) -> bytes:
    return b"".join(narrow(k[at], min(8, width - 8 * i)) for i, k in enumerate(keys))


def _unpacked(data: bytes, width: int) -> list[np.ndarray]:
    n = len(data) // width
    return [widen(data[8 * i * n : min(8 * i + 8, width) * n], min(8, width - 8 * i)) for i in range(-(-width // 8))]


def _rows(chunk: Chunk, at: np.ndarray, part: int, width: int, keys: bytes) -> tuple:
    """Entries of a chunk as a row: documents that have none are left out."""
    held = np.searchsorted(chunk.starts, at, side="right") - 1
    docs, count = np.unique(held, return_counts=True)
    inside = at - chunk.starts[held]
    # Positions run on over documents: each begins where the longest possible position of the one before ends.
    base = np.concatenate([[0], np.cumsum(np.maximum.reduceat(inside, np.concatenate([[0], np.cumsum(count)[:-1]])) + 1)]) if len(docs) else np.zeros(1, np.int64)
    return part, width, keys, pack_gaps(inside + np.repeat(base[:-1], count)), base.astype("<i8").tobytes(), chunk.rk[docs].astype("<i8").tobytes(), chunk.ids[docs].astype("<i8").tobytes()


def _send(entries: Callable[[Chunk], tuple[list[np.ndarray], np.ndarray]], dealt: np.ndarray, width: int, shared: bool, extra: str | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts = WordHashes(), len(dealt)

        def rows() -> Iterator[tuple]:
            for turn, chunk in enumerate(chunks(batches, lambda text: known.of(text.split()), extra=extra)):
                keys, at = entries(chunk)
                keys = [k & np.uint64((1 << 8 * min(8, width - 8 * i)) - 1) if i else k for i, k in enumerate(keys)]
                owner = np.searchsorted(chunk.starts, at, side="right") - 1
                flagged, least = _settle(keys, chunk.ids[owner], shared)
                here = np.flatnonzero(flagged)
                if len(here):  # settled in the chunk: on its way back it passes some partition
                    yield _rows(chunk, at[here], int(dealt[(int(chunk.rk[0]) + turn) % parts]), 0, b"")
                sent = np.flatnonzero(least)
                for part, some in by_part(parts_of(keys[0][sent], parts), parts):
                    yield _rows(chunk, at[sent[some]], int(dealt[part]), width, _packed(keys, sent[some], width))

        return batched(rows(), _FIELDS, _TYPES)

    return run


def _answer(shared: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]

        def flags(row: dict, use: np.ndarray | None) -> pa.RecordBatch:
            base, rks = np.frombuffer(row["starts"], "<i8"), np.frombuffer(row["rks"], "<i8")
            at = unpack_gaps(row["gaps"])
            at = at if use is None else at[use]
            doc = np.searchsorted(base, at, side="right") - 1
            docs, begin = np.unique(doc, return_index=True)
            bodies = [pack_gaps(x - base[d]) for d, x in zip(docs, np.split(at, begin[1:]), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(rks[docs], pa.int64()), pa.array(bodies, pa.binary())], ["rk", "body"])

        asked = []
        for row in rows:
            if row["width"]:
                asked.append(row)
            else:
                yield flags(row, None)
        by_width: dict[int, list[dict]] = {}
        for row in asked:
            by_width.setdefault(row["part"], []).append(row)
        for some in by_width.values():
            keys = [_unpacked(r["keys"], r["width"]) for r in some]
            ids = []
            for r in some:
                base = np.frombuffer(r["starts"], "<i8")
                ids.append(np.frombuffer(r["ids"], "<i8")[np.searchsorted(base, unpack_gaps(r["gaps"]), side="right") - 1])
            flagged, _ = _settle([np.concatenate(k) for k in zip(*keys)], np.concatenate(ids), shared)
            for r, use in zip(some, np.split(flagged, np.cumsum([len(k[0]) for k in keys])[:-1]), strict=True):
                if use.any():
                    yield flags(r, use)

    return run


def flagged(docs: DataFrame, entries: Callable, dealt: np.ndarray, width: int, shared: bool, extra: str | None = None) -> DataFrame:
    """rk and bodies: packed positions of a document's entries that other documents share."""
    sent = docs.mapInArrow(_send(entries, dealt, width, shared, extra), _SENT)
    return sent.repartition(len(dealt), "part").mapInArrow(_answer(shared), "rk long, body binary").groupBy("rk").agg(F.collect_list("body").alias("bodies"))


def removals(docs: DataFrame) -> DataFrame:
    """rk, doc_id, text (UTF-8) and bodies: where windows begin that a smaller doc_id has too."""
    spark = docs.sparkSession
    prepare(spark)
    texts = documents(docs)
    words = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = part_keys(spark, part_count(spark, words // 6, PER_PART))
    anchors = flagged(texts, _anchors, dealt, ANCHOR_BYTES, shared=True)
    # Texts without flagged anchors need no second look.
    marked = texts.join(anchors, "rk")
    windows = flagged(marked, _windows, dealt, WINDOW_BYTES, shared=False, extra="bodies")
    return texts.join(windows, "rk", "left")


def covered(n: int, bodies: list[bytes] | None) -> np.ndarray:
    """Which of n words lie in the windows."""
    at = np.concatenate([unpack_gaps(body) for body in bodies]) if bodies else np.zeros(0, np.int64)
    return _within(n, at, at + SPAN)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words that stay, joined by one space."""
    return _kept(docs, lambda kept: kept.decode(), pa.string(), "kept string")


def _kept(docs: DataFrame, last: Callable, kind: pa.DataType, column: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, out = [], [], []
            for text, bodies in zip(batch.column("text"), batch.column("bodies"), strict=True):
                words = (text.as_py() or b"").split()
                drop = covered(len(words), bodies.as_py()) if bodies.is_valid else None
                if drop is not None:
                    kept = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
                else:
                    kept = words
                total.append(len(words))
                gone.append(len(words) - len(kept))
                out.append(last(b" ".join(kept)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, kind)], ["doc_id", "n_words", "n_removed", column.split()[0]])

    return removals(docs).select("doc_id", "text", "bodies").mapInArrow(run, f"doc_id long, n_words long, n_removed long, {column}")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(read(spark, sf_dir, "documents"), lambda kept: hashlib.sha256(kept).hexdigest(), pa.string(), "kept_sha256 string")


SQL = """
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
starts as (select doc_id, i, list_slice(w, i, i + 12) as win from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from words where len(w) >= 13)),
least as (select win, min(doc_id) as first from starts group by win),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as i from starts join least using (win) where doc_id > first),
flat as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from words),
kept as (select f.doc_id, string_agg(word, ' ' order by f.i) as kept, count(*) as n from flat f anti join gone g on f.doc_id = g.doc_id and f.i = g.i group by f.doc_id)
select w.doc_id, len(w.w)::bigint as n_words, (len(w.w) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from words w left join kept k using (doc_id)"""
