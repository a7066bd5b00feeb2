"""LM scoring: deleted interpolation of n-gram maximum-likelihood estimates.

The model predicts each token (a word or a text's end) from the one before it:

    P(v | u) = a[b] * c(u, v) / c(u)  +  s[b] * c(v) / N  +  f[b] / (V + 1)

b is the bucket of the context's frequency c(u), a power of two; a[b] + s[b] + f[b] = 1. The weights are learned by
expectation-maximisation on held-out counts: of the training documents, a tenth by hash is kept out of the counts that
the weights are fitted on, and each of its tokens is a held-out count. The final estimates use all training documents.
Every word is a context of its own, as is a text's beginning. Words with at least N / 2**SHARE training tokens are
frequent: at most 2**SHARE + 1 at any size of the corpus, so their counts, as well as those of the pairs with that share
of the tokens, may be broadcast; that is a short cut only, and all other counts are joined by shuffles.

Three passes over the texts: words are counted; pairs are counted and give the statistics of EM, which are sums over
all pairs in cells of about equal probabilities (CELLS to a power of two); then tokens meet their counts, and their
logarithms are summed by document. In the second and third pass a partition holds all tokens that share a frequent pair
of words, a rare context or a rare word after a frequent one, and the counts of the rare words among these, which come
from the first pass. A pair of two rare words goes to its context's partition, and with that count on to its word's: the
only tokens that are sent twice. Tokens are packed: frequent words as their ranks, in bytes of one significance together
and compressed, rare ones as 64-bit hashes. Frequent pairs are looked up in place and never sent, so no key has more
than N / 2**SHARE training tokens in a partition.

Nulls and odd rows: a null or empty text is one token, its end. A null doc_id counts as empty text in the split.
Repeated rows are counted as often as they occur and have equal scores. Without training documents N = V = 0 and all
weight is on the last term. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Chunk, WordHashes, batched, by_part, chunks, crc_of, documents, groups, mix, narrow, pack_gaps, part_count, part_keys, parts_of, prepare, read, unpack_gaps, widen

#: Training documents have crc32(doc_id) % FOLDS != HELD.
FOLDS, HELD = 7, 2
SHARE = 20
#: A power of two of probability is cut into so many cells for EM.
CELLS = 8
#: EM ends when no weight of a bucket changes by more than that, or after so many rounds.
SETTLED, ROUNDS = 1e-9, 2_000
PER_PART = 6_000_000
#: Tokens that a task holds at a time; there are a dozen arrays of that length.
CHUNK = 1_500_000
END = np.uint64(0x2545F4914F6CDD1D)
#: Numbers of contexts: any rare or unknown word, a text's beginning, then the frequent words from 2 on.
RARE, BEGIN = 0, 1
#: What a packed row is about: pairs by which of both words are rare; sums by document; pairs that were BOTH, with the
#: context's counts; cells of EM; frequent pairs' counts; rare words' counts.
NEITHER, WORD, SUMS, CONTEXT, BOTH, MET, CELL, OFTEN, COUNT = range(9)


def training(doc_id: int | None) -> bool:
    return crc_of(doc_id) % FOLDS != HELD


def _tokens(known: WordHashes):
    def of(text: bytes) -> np.ndarray:
        return np.append(known.of(text.lower().split()), END)

    return of


def _roles(chunk: Chunk) -> np.ndarray:
    """For each document: 0 only scored, 1 counted, 2 counted and held out from the counts of EM."""
    last = np.iinfo(np.int64).max
    return np.array([0 if not training(None if i == last else i) else 2 if (crc_of(None if i == last else i) // FOLDS) % 10 == 0 else 1 for i in chunk.ids.tolist()], np.uint8)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for chunk in chunks(batches, _tokens(known), CHUNK):
        role = np.repeat(_roles(chunk), chunk.lengths())
        use = role > 0
        word, place = np.unique(chunk.tokens[use], return_inverse=True)
        n = np.bincount(place, minlength=len(word))
        kept = np.bincount(place, role[use] == 1, minlength=len(word)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(kept)], ["word", "n", "kept"])


class Known:
    """The frequent words: their numbers as contexts, the most frequent first, and counts by number."""

    def __init__(self, words: np.ndarray, n: np.ndarray, kept: np.ndarray):
        first = np.lexsort((words, -n))
        self.n, self.kept = n[first], kept[first]
        order = np.argsort(words[first])
        self.words, self.numbers = words[first][order], order + 2

    def number(self, tokens: np.ndarray) -> np.ndarray:
        """2 and up for frequent words, RARE for others."""
        if not len(self.words):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        return np.where(self.words[at] == tokens, self.numbers[at], RARE)


def _home(words: np.ndarray) -> np.ndarray:
    """The key by which a rare word's tokens are dealt out."""
    return mix(words ^ END)


def _pairs(chunk: Chunk, known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: its context's number and hash, its own number, and a key of the pair.

    With two frequent words the key is made of both numbers; else of the rare context's hash, or of the rare word's, and
    all its tokens go to one partition, where the other word tells the pairs apart.
    """
    own = known.number(chunk.tokens)
    context, before = np.empty(len(own), np.int64), np.empty(len(own), np.uint64)
    context[1:], before[1:] = own[:-1], chunk.tokens[:-1]
    context[chunk.starts[:-1]], before[chunk.starts[:-1]] = BEGIN, 0
    key = np.where(own == RARE, _home(chunk.tokens), mix((context.astype(np.uint64) << np.uint64(32)) | own.astype(np.uint64)))
    return context, before, own, np.where(context == RARE, _home(before), key)


_SENT = "part int, kind int, first binary, second binary, counts binary, kept binary, docs binary, rks binary"
_FIELDS = ["part", "kind", "first", "second", "counts", "kept", "docs", "rks"]
_TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 6]


def _row_of(part: int, kind: int, first: bytes, second: bytes | None, counts: bytes | None, kept: bytes | None, docs: bytes | None = None, rks: bytes | None = None) -> tuple:
    return part, kind, first, second, counts, kept, docs, rks


def _rows(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    return batched(rows, _FIELDS, _TYPES)


def _row(*values: object) -> pa.RecordBatch:
    return next(_rows([values]))


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers of frequent words, three bytes each; those of one significance together, as the higher ones are mostly 0."""
    return pa.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes(), "zstd", asbytes=True)


def _numbers(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    out[:, :3] = np.frombuffer(pa.decompress(data, 3 * n, "zstd", asbytes=True), np.uint8).reshape(3, n).T
    return out.reshape(-1).view("<u4").astype(np.int64)


def _split(context: np.ndarray, before: np.ndarray, own: np.ndarray, tokens: np.ndarray, key: np.ndarray, dealt: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, bytes, bytes]]:
    """part, kind, the tokens it is about, and the packed pair: numbers of frequent words, hashes of rare ones."""
    part = parts_of(key, len(dealt))
    kinds = np.where(context == RARE, CONTEXT, NEITHER) + (own == RARE)
    for kind in (NEITHER, WORD, CONTEXT, BOTH):
        some = np.flatnonzero(kinds == kind)
        for p, at in by_part(part[some], len(dealt)):
            at = some[at]
            first = _squeezed(context[at]) if kind in (NEITHER, WORD) else narrow(before[at], 8)
            second = _squeezed(own[at]) if kind in (NEITHER, CONTEXT) else narrow(tokens[at], 8)
            yield int(dealt[p]), kind, at, first, second


def _send_counts(sent, dealt: np.ndarray):
    """Counts of pairs, of the chunk's training tokens: n with all of them, kept without the held-out ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes = Known(*sent.value), WordHashes()
        for chunk in chunks(batches, _tokens(hashes), CHUNK):
            context, before, own, key = _pairs(chunk, known)
            role = np.repeat(_roles(chunk), chunk.lengths())
            use = np.flatnonzero(role > 0)
            pair = mix(key[use] + np.where(context[use] == RARE, mix(chunk.tokens[use]), context[use].astype(np.uint64)))
            order, begin = groups(pair)
            if not len(order):
                continue
            n = np.diff(np.append(begin, len(order)))
            kept = np.add.reduceat((role[use][order] == 1).astype(np.int64), begin)
            one = use[order[begin]]
            near = np.lexsort((own[one], context[one]))  # neighbours with like numbers compress well
            one, n, kept = one[near], n[near], kept[near]
            yield from _rows(_row_of(p, kind, first, second, _pack(n[at]), _pack(kept[at])) for p, kind, at, first, second in _split(context[one], before[one], own[one], chunk.tokens[one], key[one], dealt))

    return run


def _send_rare(dealt: np.ndarray):
    """Counts of rare words to where their tokens are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n, kept = (batch.column(c).to_numpy() for c in ("word", "n", "kept"))
            word = word.view(np.uint64)
            yield from _rows(_row_of(int(dealt[p]), COUNT, narrow(word[at], 8), None, _pack(n[at]), _pack(kept[at])) for p, at in by_part(parts_of(_home(word), len(dealt)), len(dealt)))

    return run


def _pack(counts: np.ndarray) -> bytes:
    """Counts in any order, a byte each if they are small."""
    return pack_gaps(np.cumsum(counts))


def _unpack(rows: list[dict], field: str) -> np.ndarray:
    return np.concatenate([np.diff(unpack_gaps(r[field]), prepend=0) for r in rows])


def _gathered(batches: Iterator[pa.RecordBatch], now: tuple[int, ...], by_kind: dict[int, list[dict]], both: tuple[int, ...] = ()) -> Iterator[pa.RecordBatch]:
    """Rows of the kinds that are for now go to by_kind, the others on; those of both kinds do both."""
    by_kind.update({kind: [] for kind in (*now, *both)})
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            if row["kind"] in by_kind:
                by_kind[row["kind"]].append(row)
        yield from _rows(tuple(row.values()) for row in rows if row["kind"] not in now)


def _keys(rows: list[dict], kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The contexts, and the words: numbers or hashes."""
    first, second = [], []
    for r in rows:
        hashes = r["first"] if kind in (CONTEXT, BOTH) else r["second"]
        n = len(hashes) // 8 if kind != NEITHER else int.from_bytes(r["counts"][:8], "little")
        first.append(_numbers(r["first"], n) if kind in (NEITHER, WORD) else widen(r["first"], 8))
        second.append(_numbers(r["second"], n) if kind in (NEITHER, CONTEXT) else widen(r["second"], 8))
    return np.concatenate(first), np.concatenate(second)


class Rare:
    """Counts of the rare words that belong to a partition."""

    def __init__(self, rows: list[dict], field: str):
        words = np.concatenate([widen(r["first"], 8) for r in rows]) if rows else np.zeros(0, np.uint64)
        order = np.argsort(words)
        self.words, self.counts = words[order], _unpack(rows, field)[order] if rows else np.zeros(0, np.int64)

    def of(self, words: np.ndarray) -> np.ndarray:
        """0 for a word that no training document has."""
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at], 0)


def _pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(second.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + first.astype(np.uint64))


def _totals(key: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """For each entry, how many counted ones have its key."""
    order, begin = groups(key)
    sums = np.empty(len(key), np.int32)
    sums[order] = np.repeat(np.add.reduceat(counted[order], begin, dtype=np.int32), np.diff(np.append(begin, len(key))))
    return sums


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for a context never counted, else 1 + log2."""
    return np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))), 0).astype(np.int64)


def _distinct(rows: list[dict], kind: int) -> tuple[np.ndarray, ...]:
    """Pairs, each once: context, word, n and kept."""
    first, second = _keys(rows, kind)
    order, begin = groups(_pair_key(first, second))
    one = order[begin]
    return first[one], second[one], *[np.add.reduceat(_unpack(rows, field)[order], begin) for field in ("counts", "kept")]


def _cell_row(part: int, total: int, held: np.ndarray, kept: np.ndarray, context_kept: np.ndarray, word_kept: np.ndarray) -> pa.RecordBatch:
    use = held > 0
    cells, *sums = _cells(held[use], bucket(context_kept[use]), kept[use] / np.maximum(context_kept[use], 1), word_kept[use] / max(total, 1))
    return _row(part, CELL, cells.astype("<i8").tobytes(), *[x.astype("<f8").tobytes() for x in sums], None, None)


def _meet_contexts(sent, totals: dict, dealt: np.ndarray):
    """For EM: held-out tokens by bucket and cell of both estimates; and the frequent pairs with their counts.

    Pairs of two rare words go on with their context's count.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, by_kind = Known(*sent.value), {}
        count = np.concatenate([[0, totals["begin_kept"]], known.kept])
        yield from _gathered(batches, (NEITHER, WORD, CONTEXT, BOTH), by_kind, (COUNT,))
        rare = Rare(by_kind.pop(COUNT), "kept")
        for kind in (NEITHER, WORD, CONTEXT):
            if not (rows := by_kind.pop(kind)):
                continue
            first, second, n, kept = _distinct(rows, kind)
            of_context = rare.of(first) if kind == CONTEXT else count[first]
            yield _cell_row(rows[0]["part"], totals["kept"], n - kept, kept, of_context, rare.of(second) if kind == WORD else count[second])
            if kind == NEITHER and (often := np.flatnonzero(n >= totals["least"])).size:
                yield _row(rows[0]["part"], OFTEN, ((first[often] << 32) | second[often]).astype("<i8").tobytes(), n[often].astype("<i8").tobytes(), *[None] * 4)
        if rows := by_kind.pop(BOTH):
            first, second, n, kept = _distinct(rows, BOTH)
            own = rare.of(first)
            yield from _rows(_row_of(int(dealt[p]), MET, _pack(own[at]), narrow(second[at], 8), _pack(n[at]), _pack(kept[at])) for p, at in by_part(parts_of(_home(second), len(dealt)), len(dealt)))

    return run


def _meet_words(sent, totals: dict):
    """The rest of the statistics, from pairs of two rare words, and all of them unpacked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_kind, names = {}, ["cell", "bucket", "weight", "p2", "p1", "count"]

        def out(row: dict) -> pa.RecordBatch:
            cell = np.frombuffer(row["first"], "<i8")
            none = np.full(len(cell), None)
            if row["kind"] == OFTEN:
                columns = [pa.array(none, pa.int64()), *[pa.array(none, pa.float64())] * 3, pa.array(np.frombuffer(row["second"], "<i8"))]
            else:
                columns = [pa.array(cell >> 40), *[pa.array(np.frombuffer(row[x], "<f8")) for x in ("second", "counts", "kept")], pa.array(none, pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(cell), *columns], names)

        for other in _gathered(batches, (MET, COUNT), by_kind):
            yield from map(out, other.to_pylist())
        if rows := by_kind[MET]:
            second, n, kept = np.concatenate([widen(r["second"], 8) for r in rows]), _unpack(rows, "counts"), _unpack(rows, "kept")
            row = _cell_row(0, totals["kept"], n - kept, kept, _unpack(rows, "first"), Rare(by_kind[COUNT], "kept").of(second))
            yield out(row.to_pylist()[0])

    return run


def _cells(weight: np.ndarray, b: np.ndarray, p2: np.ndarray, p1: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tokens by bucket and by both probabilities, each cut into CELLS to a power of two; sums of weight, p2 and p1."""
    def cut(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, 1 + np.floor(-np.log2(np.maximum(p, 1e-300)) * CELLS), 0).astype(np.int64)

    cell, place = np.unique((b << 40) | (cut(p2) << 20) | cut(p1), return_inverse=True)
    sums = [np.bincount(place, weight * x, minlength=len(cell)) for x in (np.ones(len(weight)), p2, p1)]
    return cell, *sums


def fit(b: np.ndarray, weight: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: float, rounds: int = ROUNDS) -> np.ndarray:
    """EM: for each bucket the weights of the three estimates. Arguments: for each cell its bucket, tokens, estimates.

    A bucket without held-out tokens takes the weights of all buckets together.
    """
    out = np.zeros((66, 3))

    def one(use: np.ndarray) -> np.ndarray:
        parts = np.stack([p2[use], p1[use], np.full(use.sum(), p0)])
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            mixed, before = w[:, None] * parts, w
            w = (mixed / mixed.sum(axis=0) * weight[use]).sum(axis=1)
            w = np.maximum(w / w.sum(), 1e-9)
            w /= w.sum()
            if np.abs(w - before).max() < SETTLED:
                break
        return w

    everywhere = one(weight > 0) if weight.sum() else np.array([0.0, 0.0, 1.0])
    for k in range(len(out)):
        use = (b == k) & (weight > 0)
        out[k] = one(use) if use.any() else everywhere
    # A context that was never counted has no pairs to estimate from.
    out[0] = [0.0, 1 - out[0][2], out[0][2]]
    return out


class Model:
    """What each token's probability is made of, but for the counts of pairs and of rare words."""

    def __init__(self, known: Known, totals: dict, weights: np.ndarray):
        self.n = totals["n"]
        self.p0 = 1.0 / (totals["v"] + 1)
        self.base = totals["n"] + totals["v"] + 1
        self.count = np.concatenate([[0, totals["begin"]], known.n]).astype(np.float64)
        self.weights = weights
        self.mixture = weights[bucket(self.count)]

    def numbered(self, context: np.ndarray, pair: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the model and of the base, given the context's number and the counts of the pair and of the word."""
        return self.logs(self.mixture[context], self.count[context], pair, word)

    def counted(self, context: np.ndarray, pair: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, given the context's count."""
        return self.logs(self.weights[bucket(context)], context, pair, word)

    def logs(self, w: np.ndarray, context: np.ndarray, pair: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(self.n, 1) + w[:, 2] * self.p0
        return np.log10(p), np.log10((word + 1) / self.base)


def _places(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of an ascending array, and each element's place among them."""
    new = np.concatenate([[True], ascending[1:] != ascending[:-1]])
    return ascending[new], np.cumsum(new) - 1


def _send_tokens(sent, dealt: np.ndarray):
    """Tokens to where their counts are, but for frequent pairs: of those the sums are given at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n_word, kept_word, pairs, pair_n, totals, weights = sent.value
        known, hashes = Known(words, n_word, kept_word), WordHashes()
        model = Model(known, totals, weights)
        for chunk in chunks(batches, _tokens(hashes), CHUNK):
            context, before, own, key = _pairs(chunk, known)
            owner = chunk.owner()
            code = (context.astype(np.uint64) << np.uint64(32)) | own.astype(np.uint64)
            at = np.minimum(np.searchsorted(pairs, code), max(len(pairs) - 1, 0))
            often = (pairs[at] == code) & (own != RARE) if len(pairs) else np.zeros(len(code), bool)
            some = np.flatnonzero(often)
            score, base = model.numbered(context[some], pair_n[at[some]], model.count[own[some]])
            n_docs = len(chunk.ids)
            sums = [np.bincount(owner[some], x, minlength=n_docs) for x in (score, base, np.ones(len(some)))]
            yield _sums_row(int(dealt[int(chunk.rk[0]) % len(dealt)]), chunk.rk, *sums)
            rest = np.flatnonzero(~often)
            counted = _roles(chunk) > 0

            def packed() -> Iterator[tuple]:
                for p, kind, at, first, second in _split(context[rest], before[rest], own[rest], chunk.tokens[rest], key[rest], dealt):
                    docs, place = _places(owner[rest[at]])
                    yield _row_of(p, kind, first, second, pack_gaps(place), counted[docs].tobytes(), None, chunk.rk[docs].astype("<i8").tobytes())

            yield from _rows(packed())

    return run


def _sums_row(part: int, rks: np.ndarray, score: np.ndarray, base: np.ndarray, n_known: np.ndarray) -> pa.RecordBatch:
    return _row(part, SUMS, score.astype("<f8").tobytes(), base.astype("<f8").tobytes(), _pack(n_known.astype(np.int64)), None, None, rks.astype("<i8").tobytes())


def _counted(rows: list[dict]) -> np.ndarray:
    """Of each token, whether it is a training document's."""
    return np.concatenate([np.frombuffer(r["kept"], bool)[unpack_gaps(r["counts"])] for r in rows])


def _by_document(rows: list[dict], logs: Callable[[slice], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
    """rks and sums for the rows, one after the other; logs gives both logarithms and the words' counts of some tokens."""
    at = 0
    for row in rows:
        doc, rks = unpack_gaps(row["counts"]), np.frombuffer(row["rks"], "<i8")
        score, base, seen = logs(slice(at, at + len(doc)))
        yield rks, *[np.bincount(doc, x, minlength=len(rks)) for x in (score, base, seen > 0)]
        at += len(doc)


def _score_contexts(sent, dealt: np.ndarray):
    """Scores tokens but those of two rare words; these go on with the counts that they met."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n_word, kept_word, _, _, totals, weights = sent.value
        model, by_kind, done = Model(Known(words, n_word, kept_word), totals, weights), {}, []
        yield from _gathered(batches, (NEITHER, WORD, CONTEXT, BOTH), by_kind, (COUNT,))
        rare = Rare(by_kind.pop(COUNT), "counts")

        def met(rows: list[dict], kind: int) -> None:
            first, second = _keys(rows, kind)
            pair = _totals(_pair_key(first, second), _counted(rows))

            def logs(own: slice) -> tuple[np.ndarray, ...]:
                seen = rare.of(second[own]) if kind == WORD else model.count[second[own]]
                return *(model.counted(rare.of(first[own]), pair[own], seen) if kind == CONTEXT else model.numbered(first[own], pair[own], seen)), seen

            done.extend(_by_document(rows, logs))

        for kind in (NEITHER, WORD, CONTEXT):
            if rows := by_kind.pop(kind):
                met(rows, kind)
        if rows := by_kind.pop(BOTH):
            first, second = _keys(rows, BOTH)
            context, pair = rare.of(first), _totals(_pair_key(first, second), _counted(rows))
            sizes = [len(r["rks"]) // 8 for r in rows]
            owner = np.concatenate([unpack_gaps(r["counts"]) + shift for r, shift in zip(rows, np.cumsum([0, *sizes]), strict=False)])
            rks, roles = np.concatenate([np.frombuffer(r["rks"], "<i8") for r in rows]), np.concatenate([np.frombuffer(r["kept"], bool) for r in rows])

            def packed() -> Iterator[tuple]:
                for p, at in by_part(parts_of(_home(second), len(dealt)), len(dealt)):
                    docs, place = np.unique(owner[at], return_inverse=True)
                    yield _row_of(int(dealt[p]), MET, _pack(context[at]), narrow(second[at], 8), pack_gaps(place), roles[docs].tobytes(), _pack(pair[at]), rks[docs].tobytes())

            yield from _rows(packed())
        if done:
            rks, *sums = [np.concatenate(x) for x in zip(*done)]
            order, begin = groups(rks)
            rks, sums = rks[order[begin]], [np.add.reduceat(x[order], begin) for x in sums]
            for p, at in by_part(rks % len(dealt), len(dealt)):
                yield _sums_row(int(dealt[p]), rks[at], *[x[at] for x in sums])

    return run


def _score_words(sent):
    """Scores tokens of two rare words, and unpacks all sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n_word, kept_word, _, _, totals, weights = sent.value
        model, by_kind, done = Model(Known(words, n_word, kept_word), totals, weights), {}, []
        for other in _gathered(batches, (MET, COUNT), by_kind):
            done += [(np.frombuffer(r["rks"], "<i8"), np.frombuffer(r["first"], "<f8"), np.frombuffer(r["second"], "<f8"), _unpack([r], "counts")) for r in other.to_pylist()]
        if rows := by_kind[MET]:
            word = Rare(by_kind[COUNT], "counts").of(np.concatenate([widen(r["second"], 8) for r in rows]))
            context, pair = _unpack(rows, "first"), _unpack(rows, "docs")
            done += _by_document(rows, lambda own: (*model.counted(context[own], pair[own], word[own]), word[own]))
        if done:
            rks, *sums = [np.concatenate(x) for x in zip(*done)]
            order, begin = groups(rks)
            score, base, n_known = [np.add.reduceat(x[order], begin) for x in sums]
            yield pa.RecordBatch.from_arrays([pa.array(rks[order[begin]]), pa.array(score), pa.array(base), pa.array(n_known.astype(np.int64))], ["rk", "score", "base_score", "n_known"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """op2's columns for every row of docs."""
    spark = docs.sparkSession
    prepare(spark)
    sc = spark.sparkContext
    texts = documents(docs)
    counts = texts.mapInArrow(_count_words, "word long, n long, kept long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept")).checkpoint()
    n, v, kept, ends, ends_kept = counts.agg(F.sum("n"), F.count("*"), F.sum("kept"), F.sum(F.when(F.col("word") == int(END.view(np.int64)), F.col("n"))), F.sum(F.when(F.col("word") == int(END.view(np.int64)), F.col("kept")))).first()
    n, kept = n or 0, kept or 0
    least = max(1, -(-n >> SHARE))
    # At most N / least <= 2**SHARE rows, whatever N is; the end is among them as a word that may follow. Rarer ones meet their counts in shuffles.
    often = counts.where((F.col("n") >= least) | (F.col("word") == int(END.view(np.int64)))).toArrow()
    words = often["word"].to_numpy().view(np.uint64), often["n"].to_numpy(), often["kept"].to_numpy()
    totals = {"n": n, "v": v, "kept": kept, "least": least, "begin": ends or 0, "begin_kept": ends_kept or 0}
    dealt = part_keys(spark, part_count(spark, n, PER_PART))
    parts = len(dealt)

    sent = sc.broadcast(words)
    rare = counts.where((F.col("n") < least) & (F.col("word") != int(END.view(np.int64))) & (F.col("n") > 0)).mapInArrow(_send_rare(dealt), _SENT)
    met = texts.mapInArrow(_send_counts(sent, dealt), _SENT).union(rare).repartition(parts, "part").mapInArrow(_meet_contexts(sent, totals, dealt), _SENT)
    found = met.repartition(parts, "part").mapInArrow(_meet_words(sent, totals), "cell long, bucket long, weight double, p2 double, p1 double, count long").groupBy("cell", "bucket").agg(F.sum("weight").alias("weight"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1"), F.max("count").alias("count")).toArrow()
    # Cells are at most buckets x cells**2; pairs with their share at most 2**SHARE.
    is_pair = np.array(found["bucket"].is_null())
    weight = found["weight"].to_numpy()[~is_pair]
    p2, p1 = found["p2"].to_numpy()[~is_pair] / weight, found["p1"].to_numpy()[~is_pair] / weight
    order = np.argsort(found["cell"].to_numpy()[~is_pair])
    weights = fit(found["bucket"].to_numpy()[~is_pair][order].astype(np.int64), weight[order], p2[order], p1[order], 1.0 / (v + 1))
    pairs, pair_n = found["cell"].to_numpy()[is_pair].view(np.uint64), found["count"].to_numpy()[is_pair].astype(np.float64)
    order = np.argsort(pairs)

    # The shuffles so far are of no more use; the JVM deletes their files once it has collected the frames, in two rounds.
    del met
    for _ in range(2):
        gc.collect()
        sc._jvm.System.gc()
        time.sleep(0.5)
    sent = sc.broadcast((*words, pairs[order], pair_n[order], totals, weights))
    met = texts.mapInArrow(_send_tokens(sent, dealt), _SENT).union(rare).repartition(parts, "part").mapInArrow(_score_contexts(sent, dealt), _SENT)
    scored = met.repartition(parts, "part").mapInArrow(_score_words(sent), "rk long, score double, base_score double, n_known long")
    # Equal rows have one key, so a sum is of all of them together.
    sums = scored.groupBy("rk").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base_score"), F.sum("n_known").alias("n_known"))
    own = docs.select(F.xxhash64("doc_id", "text").alias("rk"), "doc_id", (F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1).cast("long").alias("n_tokens"))
    copies = own.groupBy("rk").agg(F.count("*").alias("copies"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD
    return own.join(sums.join(copies, "rk"), "rk").select("doc_id", held.alias("held_out"), "n_tokens", (F.col("n_known") / F.col("copies")).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base_score") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
