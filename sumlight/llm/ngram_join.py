"""N-gram Jaccard join: exact self-join of shingle sets, with links, classes and no pairs of copies.

Two documents link when the Jaccard similarity of their sets of n-word shingles reaches a threshold; classes are what
links connect. A text with fewer than n words, but some, has its whole sequence as its one shingle.

Neighbourhoods. The range of shingle hashes is cut into m positions, m growing with the set's size, and a set's shingles
at a position form one key of the index. Sets that link differ in at most d = (1 - t) / (1 + t) * (|A| + |B|) shingles, so
of m = d + 1 + e positions e + 1 are equal. Frequent shingles (about 2**-SHARE of all, so their number is bounded and
they are broadcast) are left out of the keys, and positions without others have no key: as long as one of two sets has
at most e such positions, they still share a key. Sets with more of them are indexed a second time with all shingles.
Sizes are classed in steps of the threshold; a set is indexed under its class and the one above, so any two sets that
may link meet under the larger one's class. Lists of one set are skipped. In lists of up to SHORT sets each two sets'
sketches are held against each other: parities of hash buckets, of which sets that link differ in at most d. Longer
lists, near copies mostly, tie their sets to one of them without that, as all pairs of a long list are never made; it
makes neighbourhoods larger, which costs time only, as these are answered exactly. Equal sets are first made one.

Set relations. A neighbourhood is cut into blocks of up to BLOCK sets of about one size, and pairs of blocks whose sizes
allow links are answered, block by block:

- Block-skipping index lists. A block's right sets are indexed by the shingles of their prefixes, rarest first. In a
  shingle's list the entries of one size form a block, in which they are ordered by the shingle's position in the set. A
  probe with a shingle at position i skips the blocks whose size can't link or whose every entry leaves too few shingles
  behind, and of the other blocks all entries from the first position on that leaves too few.
- Answers from a similar set's. Leaders are chosen among the left sets so that each left set is either one or differs from
  one in at most (1 - t) / 2 of the leader's shingles. A leader's probe looks for all that may link with any of its
  followers, and counts its overlaps. A follower of the most similar leader takes these overlaps over: it adds those of
  the lists of the shingles that it has and the leader hasn't, and takes off those of the shingles it lacks.

A block pair returns a spanning forest of its links and the number of links of each set.

Nulls and odd rows: a null or empty text, or one without words, has an empty set and no links. Repeated rows and equal
texts link with each other; a null doc_id counts as the largest and its rows come back with null ids. An empty table
gives an empty result. Other columns are ignored.

Scale: keys are sent packed, 8 bytes and a byte each, once for a task's chunk of documents (a chunk's others that have
the key are tied to its first one there), so a frequent key reaches a partition once a chunk. What one set or one
neighbourhood has very many of, pairs or blocks, is joined without bringing them together (common.join_spread, and salts
in `blocks`). A neighbourhood of g different sets costs (g / BLOCK) ** 2 / 2 block pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST, WordHashes, by_part, chunks, components, documents, free, giving_back, grams, groups, join_spread, mix, narrow, narrowed, pack_gaps, part_count, part_keys, parts_of, prepare, read, tidy, tidy_executors, unpack_gaps, widen

#: Tokens that a task takes up at a time; each makes up to two keys, and these are sorted.
CHUNK = 1_000_000
#: Entries that a partition of the index holds.
PER_PART = 3_000_000
#: Of those, how many are unpacked at a time.
SLICE = 500_000
#: Pairs of sets that a task makes at a time, before repeated ones become one.
PAIRS = 250_000
BLOCK = 128
BLOCK_SHINGLES = 100_000
BLOCKS_A_SALT = 256
#: Sets of a list that are compared with each other; and those of one chunk, beyond which the list counts as longer.
SHORT, SHORT_IN_CHUNK = 32, 8
#: Shingles with this share of all, as a power of two, are frequent.
SHARE = 18


def shingles(tokens: np.ndarray, n: int) -> np.ndarray:
    """The distinct shingle hashes of a text's word hashes, ascending."""
    if not len(tokens):
        return tokens
    return np.unique(grams(tokens, min(n, len(tokens))))


class Scheme:
    """Classes of sizes, and in how many positions a class cuts the hashes."""

    def __init__(self, threshold: Fraction):
        self.t = threshold

    def size_class(self, n: int) -> int:
        """Sizes s and s * t or more lie in one class or in neighbouring ones."""
        return math.floor(math.log(n) / -math.log(float(self.t)) + 1e-9)

    def most(self, c: int) -> int:
        """The largest size of a class, or a little more."""
        return math.ceil(float(self.t) ** -(c + 1) * (1 + 1e-9)) + 1

    def differ(self, total: int) -> int:
        """Shingles in which two sets of so many shingles together differ at most, if they link."""
        return math.floor((1 - self.t) * total / (1 + self.t))

    def positions(self, c: int) -> tuple[int, int]:
        """m and e for sets that meet under class c."""
        d = self.differ(2 * self.most(c))
        if d == 0:
            return 1, 0
        e = 1 + 3 * d // 10
        return d + 1 + e, e

    def keys(self, hashes: np.ndarray, often: np.ndarray, cache: dict) -> np.ndarray:
        """The index keys of a set; often: the frequent shingles, ascending."""
        rare = hashes
        if len(often):
            at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
            rare = hashes[often[at] != hashes]
        own = self.size_class(len(hashes))
        out = []
        for c in (own, own + 1):
            if c not in cache:
                m, e = self.positions(c)
                cache[c] = np.array([(k << 64) // m for k in range(1, m)], np.uint64), e, mix(np.arange(m, dtype=np.uint64) + (np.uint64(c) << np.uint64(40)))
            cuts, e, salt = cache[c]
            key, empty = self._at(rare, cuts, salt)
            out.append(key[~empty])
            if empty.sum() > e:
                key, empty = self._at(hashes, cuts, salt ^ np.uint64(0x5851F42D4C957F2D))
                out.append(key if empty.sum() > e else key[~empty])
        return np.concatenate(out)

    @staticmethod
    def _at(hashes: np.ndarray, cuts: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The key of each position, and whether it has no shingle."""
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0xA0761D6478BD642F)))])
        ends = np.concatenate([[0], np.searchsorted(hashes, cuts), [len(hashes)]])
        return mix((sums[ends[1:]] - sums[ends[:-1]]) ^ salt), ends[1:] == ends[:-1]


def _digest(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _frequent(n: int):
    """Shingles that occur often in a chunk, and in how many of its documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for chunk in chunks(batches, lambda text: shingles(known.of(text.lower().split()), n), CHUNK):
            shingle, count = np.unique(chunk.tokens, return_counts=True)
            use = count >= max(2, len(chunk.tokens) >> (SHARE + 1))
            yield pa.RecordBatch.from_arrays([pa.array(shingle[use].view(np.int64)), pa.array(count[use].astype(np.int64)), pa.array(np.full(use.sum(), 0, np.int64))], ["shingle", "n", "all"])
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([len(chunk.tokens)], pa.int64())], ["shingle", "n", "all"])

    return run


_SENT = "part int, long boolean, keys binary, gaps binary, sets binary"
_FIELDS = ["part", "long", "keys", "gaps", "sets"]
_TYPES = [pa.int32(), pa.bool_(), *[pa.binary()] * 3]


def _index(sent, n: int, threshold: Fraction, dealt: np.ndarray):
    """Chunks' keys with the sets (by digest) that have them; and, as part -1, sets of the chunk tied by a key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scheme, cache, often = WordHashes(), Scheme(threshold), {}, sent.value
        for chunk in chunks(batches, lambda text: known.of(text.lower().split()), CHUNK):
            sets: dict[int, np.ndarray] = {}
            for d in range(len(chunk.ids)):
                hashes = shingles(chunk.tokens[chunk.starts[d] : chunk.starts[d + 1]], n)
                if len(hashes) and (digest := _digest(hashes)) not in sets:
                    sets[digest] = scheme.keys(hashes, often, cache)
            if not sets:
                continue
            names = np.array(list(sets), np.int64)
            key = np.concatenate(list(sets.values()))
            owner = np.repeat(np.arange(len(names)), [len(x) for x in sets.values()])
            order, begin = groups(key)
            size = np.diff(np.append(begin, len(order)))
            many = np.repeat(size > SHORT_IN_CHUNK, size)
            tied, own = np.repeat(owner[order[begin]], size)[many], owner[order[many]]
            pairs = np.unique(np.stack([own, tied], axis=1)[own != tied], axis=0)
            rows = []
            if len(pairs):  # these are tied here, and only the first goes on
                rows.append((-1, True, names[pairs[:, 0]].astype("<i8").tobytes(), names[pairs[:, 1]].astype("<i8").tobytes(), b""))
            for long, sent_on in ((True, order[begin[size > SHORT_IN_CHUNK]]), (False, order[~many])):
                sent_on = np.sort(sent_on)
                for p, some in by_part(parts_of(key[sent_on], len(dealt)), len(dealt)):
                    at = sent_on[some]
                    held, place = np.unique(owner[at], return_inverse=True)
                    rows.append((int(dealt[p]), long, narrow(key[at], 8), pack_gaps(place), names[held].astype("<i8").tobytes()))
            for row in rows:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _TYPES, strict=True)], _FIELDS)

    return run


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sets that share a key: all of a short list, to be compared; of a long one each set with the least."""
    rows: list[tuple[bool, bytes, bytes, bytes]] = []

    def out(a: np.ndarray, b: np.ndarray, sure: bool) -> pa.RecordBatch:
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.full(len(pairs), sure))], ["a", "b", "sure"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] < 0:
                yield out(np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["gaps"], "<i8"), True)
            else:
                rows.append((row["long"], row["keys"], row["gaps"], row["sets"]))
    # The rows stay packed, and are unpacked for one slice of the keys after another.
    slices = max(1, sum(len(keys) for _, keys, _, _ in rows) // (8 * SLICE))
    for k in range(slices):
        yield from _slice_ties(rows, k, slices, out)


def _slice_ties(rows: list[tuple[bool, bytes, bytes, bytes]], k: int, slices: int, out: Callable[[np.ndarray, np.ndarray, bool], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_ties of the keys whose low bits are k modulo slices."""
    keys, sets, long = [], [], []
    for is_long, packed, gaps, names in rows:
        key = widen(packed, 8)
        use = np.flatnonzero((key & np.uint64(0xFFFFFFFF)) % np.uint64(slices) == k)
        keys.append(key[use])
        sets.append(np.frombuffer(names, "<i8")[unpack_gaps(gaps)[use]])
        long.append(np.full(len(use), is_long))
    if not sum(map(len, keys)):
        return
    key, name, is_long = np.concatenate(keys), np.concatenate(sets), np.concatenate(long)
    del keys, sets, long
    order, begin = groups(key)
    del key
    # Most lists have one set, and are left out before the rest is made.
    size = np.diff(np.append(begin, len(order)))
    order, size = order[np.repeat(size > 1, size)], size[size > 1]
    begin, name = np.cumsum(size) - size, name[order]
    if not len(order):
        return
    star = np.logical_or.reduceat(is_long[order], begin) | (size > SHORT)
    del order, is_long
    least = np.repeat(np.minimum.reduceat(name, begin), size)
    own = np.repeat(star, size)
    yield out(name[own], least[own], True)
    del least, own
    found, more, held = np.zeros((0, 2), np.int64), [], 0
    for n in range(2, SHORT + 1):
        at = begin[(size == n) & ~star]
        i, j = np.triu_indices(n, 1)
        step = max(1, PAIRS // len(i))
        for k in range(0, len(at), step):
            some = at[k : k + step, None]
            a, b = name[(some + i).ravel()], name[(some + j).ravel()]
            more.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0))
            held += len(more[-1])
            if held > max(PAIRS, len(found)):  # then merging costs no more than what it merges
                found, more, held = np.unique(np.concatenate([found, *more]), axis=0), [], 0
    found = np.concatenate([found, *more])
    yield out(found[:, 0], found[:, 1], False)


def sketch(hashes: np.ndarray) -> bytes:
    """For a power of two of buckets, at least one for each shingle and at least 8: whether a bucket has an odd number."""
    buckets = 1 << max(3, (len(hashes) - 1).bit_length())
    odd = np.bincount((mix(hashes ^ np.uint64(0xD6E8FEB86659FD93)) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketches_differ(a: bytes, b: bytes) -> int:
    """Buckets in which two sketches differ, after the longer one is folded: no more than the sets' shingles do."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _compared(threshold: Fraction):
    """Pairs whose sizes and sketches allow a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(threshold)
        for batch in batches:
            keep = [min(m, n) >= threshold * max(m, n) and sketches_differ(x, y) <= scheme.differ(m + n) for m, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("size_a", "size_b", "sketch_a", "sketch_b")), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(n: int):
    """Each document's set: its size, its digest and its sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sizes, names, sketches = [], [], []
            for text in batch.column("text"):
                hashes = shingles(known.of((text.as_py() or b"").lower().split()), n)
                sizes.append(len(hashes))
                names.append(_digest(hashes) if len(hashes) else None)
                sketches.append(sketch(hashes) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([batch.column("rk"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(sketches, pa.binary())], ["rk", "doc_id", "n_shingles", "name", "sketch"])

    return run


def _shingled(n: int):
    """The packed shingles of texts, beside the other columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            packed = [shingles(known.of((t.as_py() or b"").lower().split()), n).astype("<u8").tobytes() for t in batch.column("text")]
            yield batch.drop_columns(["text"]).append_column("shingles", pa.array(packed, pa.binary()))

    return run


def overlap_needed(a: np.ndarray, b: np.ndarray, threshold: Fraction) -> np.ndarray:
    """The least overlap with which sets of so many shingles link."""
    t, u = threshold.numerator, threshold.denominator
    return -(-t * (a + b) // (t + u))


def slack(size: np.ndarray, threshold: Fraction) -> np.ndarray:
    """By how many shingles, either way, a follower may differ from a leader of that size."""
    return (threshold.denominator - threshold.numerator) * size // (2 * threshold.denominator)


class Lists:
    """Inverted lists of sets' prefixes: a shingle's entries of one size are a block, in it ordered by position.

    A prefix is long enough for probes by any leader of a set that may link.
    """

    def __init__(self, ranked: list[np.ndarray], size: np.ndarray, threshold: Fraction):
        t = float(threshold)
        reach = size - np.maximum(-(-size * threshold.numerator // threshold.denominator) - np.ceil((1 - t) * size / (t * (1 + t)) + 1e-9).astype(np.int64), 1) + 1
        reach = np.minimum(reach, size)
        token = np.concatenate([r[:n] for r, n in zip(ranked, reach.tolist(), strict=True)])
        owner = np.repeat(np.arange(len(ranked)), reach)
        place = np.arange(len(token)) - np.repeat(np.cumsum(reach) - reach, reach)
        order = np.lexsort((place, size[owner], token))
        self.owner, self.place = owner[order], place[order]
        token, sizes = token[order], size[owner][order]
        begin = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (sizes[1:] != sizes[:-1])]))
        self.begin, self.end, self.sizes = begin, np.append(begin[1:], len(token)), sizes[begin]
        self.token = token[begin]

    def probe(self, ranked: np.ndarray, need: np.ndarray) -> np.ndarray:
        """The sets that may share need[their size] shingles or more; need: too much for the sizes that can't link."""
        n, found = len(ranked), []
        least = int(need.min())
        first, last = np.searchsorted(self.token, ranked, "left"), np.searchsorted(self.token, ranked, "right")
        for i in range(min(n, n - least + 1)):
            for block in range(first[i], last[i]):
                wanted = need[self.sizes[block]]
                if n - i < wanted:  # the probing set has too few shingles left: skip the block
                    continue
                a, b = self.begin[block], self.end[block]
                # What begins after this position leaves the other sets too few: skip the rest of the block.
                found.append(self.owner[a : a + np.searchsorted(self.place[a:b], self.sizes[block] - wanted, "right")])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def answers(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, copies: np.ndarray, threshold: Fraction) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Links between sets marked left and sets marked right; a set may be both.

    Returns a spanning forest of the links and, for each set, the documents that it links with as a left set and as a
    right one, a set standing for `copies` documents.
    """
    size = np.array([len(s) for s in sets])
    lefts, rights = np.flatnonzero(left), np.flatnonzero(right)
    # Shingles by rank, the rarest first.
    _, rank, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(count), np.int64)
    place[np.argsort(count, kind="stable")] = np.arange(len(count))
    flat = place[rank]
    ranked = [np.sort(x) for x in np.split(flat, np.cumsum(size)[:-1])]
    begins = np.cumsum(size) - size
    lists = Lists([ranked[i] for i in rights], size[rights], threshold)
    # All right sets that have a shingle, for the corrections.
    token, owner = np.concatenate([ranked[i] for i in rights]), np.repeat(np.arange(len(rights)), size[rights])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]

    def holders(some: np.ndarray) -> np.ndarray:
        """For each right set, how many of some shingles it has."""
        a, b = np.searchsorted(token, some, "left"), np.searchsorted(token, some, "right")
        return np.bincount(np.concatenate([owner[x:y] for x, y in zip(a, b, strict=True)] or [owner[:0]]), minlength=len(rights))

    marked = np.zeros(len(count), bool)

    def overlaps(i: int, others: np.ndarray) -> np.ndarray:
        """Of set i with some others."""
        marked[ranked[i]] = True
        out = np.array([marked[flat[begins[j] : begins[j] + size[j]]].sum() for j in others.tolist()], np.int64)
        marked[ranked[i]] = False
        return out

    # Leaders, until all have one; then each left set follows the one that it is most like.
    nearest, least = np.full(len(sets), -1), np.full(len(sets), np.iinfo(np.int64).max)
    for i in lefts.tolist():
        if nearest[i] < 0:
            both = overlaps(i, lefts)
            more, fewer = size[lefts] - both, size[i] - both
            within = (np.maximum(more, fewer) <= slack(size[i], threshold)) & (more + fewer < least[lefts])
            within[lefts == i] = True
            nearest[lefts[within]], least[lefts[within]] = i, (more + fewer)[within]

    forest: list[tuple[int, int]] = []
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    as_left, as_right = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
    all_sizes = np.arange(int(size.max()) + 1)
    for leader in np.unique(nearest[lefts]).tolist():
        followers = lefts[nearest[lefts] == leader]
        more = [np.setdiff1d(ranked[i], ranked[leader], assume_unique=True) for i in followers]
        need = np.full(len(all_sizes), int(size[leader]) + 1)
        for i, extra in zip(followers.tolist(), more, strict=True):
            fit = (all_sizes >= threshold * size[i]) & (threshold * all_sizes <= size[i])
            need[fit] = np.minimum(need[fit], overlap_needed(size[i], all_sizes[fit], threshold) - len(extra))
        near = lists.probe(ranked[leader], need)
        if not len(near):
            continue
        others, shared = rights[near], overlaps(leader, rights[near])
        for i, extra in zip(followers.tolist(), more, strict=True):
            lacking = np.setdiff1d(ranked[leader], ranked[i], assume_unique=True)
            overlap = shared + holders(extra)[near] - holders(lacking)[near] if i != leader else shared
            found = others[(overlap >= overlap_needed(size[i], size[others], threshold)) & (others != i)]
            as_left[i] = copies[found].sum()
            as_right[found] += copies[i]
            for j in found.tolist():
                a, b = root(i), root(j)
                if a != b:
                    parent[a] = b
                    forest.append((i, j))
    return forest, as_left, as_right


def _answer(threshold: Fraction):
    """A pair of blocks, or one with itself: forest edges, and numbers of links with b null."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        first, second = key[1].as_py(), key[2].as_py()
        names, place = np.unique(table["name"].to_numpy(), return_index=True)
        packed = table["shingles"].to_pylist()
        sets = [np.frombuffer(packed[i], "<u8") for i in place.tolist()]
        block, copies = table["block"].to_numpy()[place], table["copies"].to_numpy()[place]
        forest, as_left, as_right = answers(sets, block == first, block == second, copies, threshold)
        links = as_left + (as_right if first != second else 0)
        some = np.flatnonzero(links)
        a = [*(int(names[i]) for i, _ in forest), *names[some].tolist()]
        b = [*(int(names[j]) for _, j in forest), *[None] * len(some)]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([*[0] * len(forest), *links[some].tolist()], pa.int64())], names=["a", "b", "links"])

    return run


def blocks(members: DataFrame, threshold: Fraction) -> tuple[DataFrame, DataFrame]:
    """name, cluster, size, ... -> those with their block, and the pairs of blocks whose sizes allow links.

    A block is a range of sizes and a salt; the salts are as many as the range's sets and shingles ask for.
    """
    step = -math.log(float(threshold)) / 2
    sized = members.withColumn("range", F.floor(F.log("size") / F.lit(step)).cast("long")).checkpoint()
    n = sized.count()
    sized = narrowed(sized, n)
    many = sized.groupBy("cluster", "range").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("long").alias("salts"))
    placed = join_spread(sized, many, "cluster", "range")
    placed = placed.withColumn("block", F.col("range") * (1 << 24) + F.pmod(F.xxhash64("name"), F.col("salts"))).drop("range", "salts")
    placed = narrowed(placed, n).checkpoint()
    spans = narrowed(placed.groupBy("cluster", "block").agg(F.min("size").alias("low"), F.max("size").alias("high")), n).checkpoint()
    t = float(threshold) * (1 - 1e-9)
    # A neighbourhood's second blocks are dealt out by salts, one for each BLOCKS_A_SALT of them, and its first ones go to each.
    dealt = spans.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCKS_A_SALT).cast("long").alias("salts"))
    spans = narrowed(join_spread(spans, dealt, "cluster"), n).checkpoint()
    one = spans.select("cluster", F.col("block").alias("first"), F.col("low").alias("low1"), F.col("high").alias("high1"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    two = spans.select("cluster", F.col("block").alias("second"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.pmod(F.xxhash64("block"), F.col("salts")).alias("salt"))
    pairs = one.join(two, ["cluster", "salt"]).where((F.col("first") <= F.col("second")) & (F.col("high2") >= F.col("low1") * t) & (F.col("high1") >= F.col("low2") * t))
    return placed, pairs.select("cluster", "first", "second")


def join(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links, the number of other documents that it links with, for every row.

    component_id is the least doc_id reachable by links, the document's own included.
    """
    return _classes(docs, n, threshold).select("doc_id", "n_shingles", "component_id", "n_links")


def _classes(docs: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """join's columns, and rk and component: the class, null for rows without words."""
    spark = docs.sparkSession
    prepare(spark)
    tidy_executors(spark)
    texts = documents(docs)
    heavy = texts.mapInArrow(giving_back(_frequent(n)), "shingle long, n long, all long").groupBy("shingle").agg(F.sum("n").alias("n"), F.sum("all").alias("all")).checkpoint()
    total = heavy.agg(F.sum("all")).first()[0] or 0
    # At most 2**(SHARE + 1) shingles can have so many occurrences.
    often = heavy.where(F.col("n") > max(8, total >> (SHARE + 1))).select("shingle").toArrow()["shingle"].to_numpy().astype(np.int64).view(np.uint64)
    sent = spark.sparkContext.broadcast(np.sort(often))
    dealt = part_keys(spark, part_count(spark, total // 2, PER_PART))
    ties = texts.mapInArrow(giving_back(_index(sent, n, threshold, dealt)), _SENT).repartition(len(dealt), "part").mapInArrow(giving_back(_ties), "a long, b long, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure")).checkpoint()

    rows = texts.mapInArrow(giving_back(_sets(n)), "rk long, doc_id long, n_shingles long, name long, sketch binary").checkpoint()
    by_name = rows.where("name is not null").groupBy("name").agg(F.min("rk").alias("rk"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min("n_shingles").alias("size"))
    sketches = rows.where("name is not null").groupBy("name").agg(F.min("n_shingles").alias("size"), F.min("sketch").alias("sketch"))
    n_ties = ties.count()
    pairs = narrowed(ties, n_ties).where("not sure").select("a", "b")
    for side in ("a", "b"):
        pairs = narrowed(join_spread(pairs, sketches.toDF(side, f"size_{side}", f"sketch_{side}"), side), n_ties).checkpoint()
    tidy(spark)
    tidy_executors(spark)
    near = pairs.mapInArrow(giving_back(_compared(threshold)), "a long, b long").union(ties.where("sure").select("a", "b"))
    clusters = components(near).withColumnRenamed("component", "cluster")
    members = by_name.join(clusters.withColumnRenamed("node", "name"), "name")
    placed, pairs = blocks(members, threshold)
    tidy(spark)
    tidy_executors(spark)
    sets = texts.select("rk", "text").join(placed.select("rk", "name", "cluster", "block", "copies"), "rk").select("name", "cluster", "block", "copies", "text")
    sets = sets.mapInArrow(giving_back(_shingled(n)), "name long, cluster long, block long, copies long, shingles binary")
    both = pairs.select("*", F.explode(F.array_distinct(F.array("first", "second"))).alias("block"))
    found = sets.join(both, ["cluster", "block"]).groupBy("cluster", "first", "second").applyInArrow(_answer(threshold), "a long, b long, links long").checkpoint()
    tidy(spark)
    tidy_executors(spark)
    links = found.where("b is null").groupBy(F.col("a").alias("name")).agg(F.sum("links").alias("others"))
    linked = components(found.where("b is not null")).withColumnRenamed("node", "name")
    tidy(spark)
    named = by_name.join(linked, "name", "left").withColumn("component", F.coalesce("component", "name"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").join(links, "name", "left").select("name", "component", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    # Copies are many rows of one name, and rows without words have none: neither come together.
    out = join_spread(rows.drop("sketch").where("name is not null"), named, "name")
    out = out.unionByName(rows.drop("sketch").where("name is null"), allowMissingColumns=True)
    own = F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("rk", "component", "doc_id", "n_shingles", own.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def representatives(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of docs that stay, with their columns, when one of each class does: the one with the least doc_id.

    A null doc_id counts as the largest. Of rows that agree in doc_id and text the one stays whose columns have the least hash.
    Rows without words are nobody's copies and all stay.
    """
    # A class's rows are summed up by key first, so the second aggregation gets few rows of a task.
    rows = _classes(docs, n, threshold).groupBy("component", "rk").agg(F.min(F.coalesce("doc_id", F.lit(int(LAST)))).alias("id"), F.count("*").alias("copies"))
    wordless = F.col("component").isNull()
    rows = rows.select("component", F.when(wordless, F.col("rk")).alias("alone"), "id", "rk", F.when(wordless, 1).otherwise(F.col("copies")).alias("copies"))
    stay = rows.groupBy("component", "alone").agg(F.min(F.struct("id", "rk", "copies")).alias("first")).select("first.rk", "first.copies").checkpoint()
    rk = free(docs, "ngram_join_rk")
    keyed, stay = docs.withColumn(rk, F.xxhash64("doc_id", "text")), stay.withColumnRenamed("rk", rk)
    left = keyed.join(stay.where("copies = 1").select(rk), rk, "left_semi")
    repeated = stay.where("copies > 1").select(rk)
    if not repeated.isEmpty():
        names = [c for c in left.columns if c != rk]
        plain = [f"`{f.name}`" for f in docs.schema if "map" not in f.dataType.simpleString()]  # maps have no hash
        one = keyed.join(repeated, rk, "left_semi").groupBy(rk).agg(F.min_by(F.struct(*[f"`{c}`" for c in names]), F.xxhash64(*plain)).alias("one"))
        left = left.select(rk, *[f"`{c}`" for c in names]).union(one.select(rk, *[F.col(f"one.`{c}`") for c in names]))
    return left.select(docs.columns)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"), 3, Fraction(9, 10))


SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
grams as (
  select distinct doc_id, md5(array_to_string(list_slice(w, i, i + least(len(w), 3) - 1), ' ')) as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as common
  from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select x, y from shared join sizes s on s.doc_id = x join sizes t on t.doc_id = y where 100 * common >= 90 * (s.n + t.n - common)),
degree as (select x, count(*) as n_links from links group by x),
reach(doc_id, other) as (
  select doc_id, doc_id from words
  union
  select r.doc_id, l.y from reach r join links l on l.x = r.other)
select w.doc_id, coalesce(s.n, 0)::bigint as n_shingles, r.component_id, coalesce(d.n_links, 0)::bigint as n_links
from words w left join sizes s using (doc_id) left join degree d on d.x = w.doc_id
join (select doc_id, min(other) as component_id from reach group by doc_id) r using (doc_id)"""
