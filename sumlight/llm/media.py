"""Media columns: baseline JPEG images, parsed, Huffman-decoded and reduced to DC-only luminance thumbnails in numpy.

`decode` takes any baseline (SOF0) image with 8-bit samples: it parses the markers, Huffman-decodes the interleaved
scan to quantised coefficients, and gives dimensions and coefficients. Scans with restart intervals are decoded with
all intervals side by side, one numpy step a symbol; a scan without is one interval. Corrupt images give None.

`encode` stores bytes losslessly: 64 bytes are the 64 quantised coefficients of a block in zigzag order. A byte is the
eight amplitude bits of a coefficient of size category 8, so 128..255 are themselves and 0..127 are -255..-128. With a
restart after each block the DC coefficients need no prediction, and each block can be decoded by itself.

Nulls and odd rows: a null or empty text is a payload of 576 bytes 255. Texts of any length are stored whole: the
image grows in height, then in width. Equal texts give equal values; repeated rows stay; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, read

UNIT = 576
BLOCK = 64
#: Blocks of an image side at most: a side has 16 bits for its samples.
SIDE = 8191
#: Blocks that one numpy step works on.
LANES = 16_384


@dataclass
class Component:
    """A colour component: sampling factors, quantisation and Huffman tables by number."""

    name: int
    across: int
    down: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Image:
    width: int
    height: int
    components: list
    quant: dict
    #: For each component: blocks in scan order x 64 quantised coefficients in zigzag order.
    coefficients: list
    #: MCUs in a row of the scan.
    mcus: int


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([255, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def header(blocks: int) -> tuple[bytes, int, int]:
    """What stands before the scan of a stored payload; blocks across and down."""
    across = 3 * -(-blocks // (3 * SIDE)) if blocks > 3 * SIDE else 3
    down = -(-blocks // across)
    if down > SIDE or across > SIDE:
        raise ValueError("the payload is too long for one image")
    one = bytes([1, *[0] * 15, 8])  # one code of one bit, for size category 8 after a run of 0
    return b"".join([
        b"\xff\xd8",
        _segment(0xFE, b"blocks %d" % blocks),
        _segment(0xDB, bytes([0, *[1] * 64])),
        _segment(0xC0, bytes([8]) + (8 * down).to_bytes(2, "big") + (8 * across).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])),
        _segment(0xC4, b"\x00" + one + b"\x10" + one),
        _segment(0xDD, (1).to_bytes(2, "big")),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ]), across, down


def _scan(blocks: np.ndarray) -> bytes:
    """Entropy-coded data of n x 64 payload bytes, restart markers in between, stuffed."""
    n = len(blocks)
    out = []
    for at in range(0, n, LANES):
        some = blocks[at : at + LANES]
        bits = np.zeros((len(some), BLOCK, 9), np.uint8)
        bits[:, :, 1:] = np.unpackbits(some, axis=1).reshape(-1, BLOCK, 8)
        coded = np.full((len(some), 74), 255, np.uint8)
        coded[:, :72] = np.packbits(bits.reshape(len(some), -1), axis=1)
        coded[:, 73] = 0xD0 + (np.arange(at, at + len(some)) & 7)
        stuff = coded == 255
        stuff[:, 72] = False
        stuffed = stuff.ravel()
        place = np.arange(stuffed.size) + np.cumsum(stuffed) - stuffed
        some_out = np.zeros(stuffed.size + int(stuffed.sum()), np.uint8)
        some_out[place] = coded.ravel()
        out.append(some_out.tobytes())
    return b"".join(out)[:-2]  # no marker after the last interval


def encode(payload: bytes) -> bytes:
    """A baseline JPEG image that holds a payload of a multiple of 64 bytes; blocks beyond it hold 255."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    front, across, down = header(len(blocks))
    if across * down > len(blocks):
        blocks = np.concatenate([blocks, np.full((across * down - len(blocks), BLOCK), 255, np.uint8)])
    return front + _scan(blocks) + b"\xff\xd9"


def lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits that may come next: 256 * length + symbol of the code they begin with, 0 if none."""
    table = np.zeros(65536, np.int32)
    code = at = 0
    for length, count in enumerate(counts, 1):
        for symbol in symbols[at : at + count]:
            begin = code << (16 - length)
            table[begin : begin + (1 << (16 - length))] = 256 * length + symbol
            code += 1
        at += count
        code <<= 1
    return table


def _intervals(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unstuffed bytes of a scan, and where each restart interval begins and ends in them."""
    raw = np.frombuffer(data, np.uint8)
    ff = np.flatnonzero(raw[:-1] == 255)
    after = raw[ff + 1]
    restarts = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(raw), bool)
    keep[ff[after == 0] + 1] = False
    keep[restarts] = False
    keep[restarts + 1] = False
    place = np.concatenate([[0], np.cumsum(keep)])
    cuts = place[restarts]
    return raw[keep], np.concatenate([[0], cuts]), np.concatenate([cuts, [place[-1]]])


def _decode_scans(scans: list[bytes], plan: list[tuple[int, np.ndarray, np.ndarray]], mcus: list[int], interval: int) -> list[list[np.ndarray]]:
    """For each scan: coefficients by component. plan: for each block of an MCU its component and its DC and AC tables.

    A lane is a restart interval of one of the scans; all lanes take their next symbol in one step.
    """
    raws, begin, end, first, count, base, at = [], [], [], [], [], 0, 0
    for data, n in zip(scans, mcus, strict=True):
        raw, b, e = _intervals(data)
        step = interval or n
        if len(b) != -(-n // step):
            raise ValueError("a scan has too few or too many restart intervals")
        raws.append(raw)
        begin.append(b + at)
        end.append(e + at)
        first.append(base + step * np.arange(len(b)))
        count.append(np.minimum(step, n - step * np.arange(len(b))))
        base, at = base + n, at + len(raw)
    raw = np.concatenate([*raws, np.full(8, 255, np.uint8)])
    begin, end, first, count = map(np.concatenate, (begin, end, first, count))
    kinds = sorted({c for c, _, _ in plan})
    per_mcu = {c: sum(k == c for k, _, _ in plan) for c in kinds}
    out = {c: np.zeros((base * per_mcu[c], BLOCK), np.int16) for c in kinds}
    for lane in range(0, len(begin), LANES):
        own = slice(lane, lane + LANES)
        bit, last, mcu, left = begin[own] * 8, end[own] * 8, first[own], count[own]
        before = {c: np.zeros(len(bit), np.int64) for c in kinds}
        for m in range(int(left.max())):
            alive = np.flatnonzero(left > m)
            seen = dict.fromkeys(kinds, 0)
            for c, dc, ac in plan:
                row = (mcu[alive] + m) * per_mcu[c] + seen[c]
                seen[c] += 1
                (_, value), now = _symbols(raw, bit[alive], dc)
                before[c][alive] += value
                out[c][row, 0] = before[c][alive]
                bit[alive] = _block(raw, now, ac, out[c], row)
        if (bit > last).any():
            raise ValueError("a scan ends too early")
    cuts = np.cumsum(mcus)[:-1]
    split = {c: np.split(out[c], cuts * per_mcu[c]) for c in kinds}
    return [[split[c][i] for c in kinds] for i in range(len(scans))]


def _block(raw: np.ndarray, bit: np.ndarray, table: np.ndarray, out: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Reads the AC coefficients of a block in each lane into out[row]; the bits after them."""
    k, who = np.ones(len(bit), np.int64), np.arange(len(bit))
    while len(who):
        (symbol, value), bit[who] = _symbols(raw, bit[who], table)
        size = symbol & 15
        k[who] += symbol >> 4
        put = who
        if not size.all():
            k[who[(size == 0) & (symbol != 0xF0)]] = BLOCK  # the rest of the block is 0
            put, value = who[size > 0], value[size > 0]
        if k[put].max(initial=0) >= BLOCK:
            raise ValueError("a run leaves its block")
        out[row[put], k[put]] = value
        k[who] += 1
        if k.max() >= BLOCK:
            who = who[k[who] < BLOCK]
    return bit


def _symbols(raw: np.ndarray, bit: np.ndarray, table: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """For each lane: the Huffman symbol at the bit, the value of the amplitude bits after it, and the bit after those."""
    at = np.minimum(bit >> 3, len(raw) - 6)
    word = (raw[at].astype(np.int64) << 32) | (raw[at + 1].astype(np.int64) << 24) | (raw[at + 2].astype(np.int64) << 16) | (raw[at + 3].astype(np.int64) << 8) | raw[at + 4]
    off = bit & 7
    entry = table[(word >> (24 - off)) & 0xFFFF]
    if not entry.all():
        raise ValueError("no such code")
    length, symbol = entry >> 8, entry & 255
    size = symbol & 15
    if (size.max(initial=0)) > 11:
        raise ValueError("not baseline")
    off = off + length
    if (off + size).max(initial=0) > 40:
        raise ValueError("a code is too long")
    value = (word >> (40 - off - size)) & ((1 << size) - 1)
    value = np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)
    return (symbol, value), bit + length + size


def decode(data: bytes) -> Image | None:
    """A baseline image's dimensions and quantised coefficients; None if it isn't one or is damaged."""
    return decode_many([data])[0]


def decode_many(images: list[bytes]) -> list[Image | None]:
    """Decodes images together where their scans are built alike."""
    found: list[Image | None] = [None] * len(images)
    alike: dict[tuple, list] = {}
    for i, data in enumerate(images):
        try:
            image, scan, plan, mcus, interval, sign = _parse(data)
        except (ValueError, IndexError, KeyError, StopIteration):
            continue
        alike.setdefault((sign, interval), []).append((i, image, scan, plan, mcus, interval))
    waiting = list(alike.values())
    while waiting:
        some = waiting.pop()
        try:
            plan = [(c, lookup(*dc), lookup(*ac)) for c, dc, ac in some[0][3]]
            scans = _decode_scans([x[2] for x in some], plan, [x[4] for x in some], some[0][5])
        except (ValueError, IndexError):
            if len(some) > 1:  # one is damaged: each by itself
                waiting += [[x] for x in some]
            continue
        for (i, image, *_), coefficients in zip(some, scans, strict=True):
            image.coefficients = coefficients
            found[i] = image
    return found


def _parse(data: bytes) -> tuple:
    """An image without its coefficients, its scan, and how to decode it; the sign is equal where tables and plan are."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no image begins here")
    at, quant, tables, frame, interval, sign = 2, {}, {}, None, 0, b""
    while True:
        if data[at] != 255:
            raise ValueError("no marker where one is due")
        while data[at + 1] == 255:
            at += 1
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                step = 128 if wide else 64
                quant[number] = np.frombuffer(body[1 : 1 + step], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + step :]
        elif marker == 0xC4:
            sign += body
            while body:
                count = sum(body[1:17])
                tables[body[0]] = body[1:17], body[17 : 17 + count]
                body = body[17 + count :]
        elif marker == 0xC0:
            if body[0] != 8:
                raise ValueError("not 8-bit samples")
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif marker in range(0xC1, 0xD0) and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            if frame is None or body[0] != len(frame):
                raise ValueError("the scan doesn't hold all components")
            for i in range(body[0]):
                part = next(c for c in frame if c.name == body[1 + 2 * i])
                part.dc, part.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
            break
    end = data.rfind(b"\xff\xd9")
    if end < at:
        raise ValueError("no end")
    alone = len(frame) == 1
    wide, high = max(c.across for c in frame), max(c.down for c in frame)
    across = -(-width // 8) if alone else -(-width // (8 * wide))
    down = -(-height // 8) if alone else -(-height // (8 * high))
    plan = [(i, tables[c.dc], tables[16 + c.ac]) for i, c in enumerate(frame) for _ in range(1 if alone else c.across * c.down)]
    sign += repr([(c.across, c.down, c.dc, c.ac) for c in frame]).encode()
    return Image(width, height, frame, quant, [], across), data[at:end], plan, across * down, interval, sign


def payload_of(image: Image) -> bytes:
    """The bytes that `encode` stored, padding blocks included."""
    values = image.coefficients[0]
    return np.where(values < 0, values + 255, values).astype(np.uint8).tobytes()


def thumbnail(image: Image) -> np.ndarray:
    """Luminance from the DC coefficients alone: a sample for each block of the first component."""
    first = image.components[0]
    dc = image.coefficients[0][:, 0].astype(np.int64) * int(image.quant[first.quant][0])
    if len(image.components) > 1:  # blocks of an MCU lie together
        dc = dc.reshape(-1, image.mcus, first.down, first.across).transpose(0, 2, 1, 3).reshape(-1, image.mcus * first.across)
    else:
        dc = dc.reshape(-1, image.mcus)
    return np.clip(dc // 8 + 128, 0, 255).astype(np.uint8)


def reduced(thumb: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means over a grid of cells, each of at least one sample."""
    def axis(values: np.ndarray, n: int) -> np.ndarray:
        size = len(values)
        begin = np.arange(n) * size // n
        end = np.maximum(begin + 1, (np.arange(n) + 1) * size // n)
        sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
        return (sums[end] - sums[begin]) / (end - begin).reshape(-1, *[1] * (values.ndim - 1))

    return axis(axis(thumb, rows).T, columns).T


def feature(image: Image) -> str:
    """Dimensions, then the difference hash and the average hash of the thumbnail, in hex."""
    thumb = thumbnail(image)
    grid = reduced(thumb, 8, 9)
    difference = np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes().hex()
    small = reduced(thumb, 8, 8)
    average = np.packbits(small > small.mean()).tobytes().hex()
    return f"{image.width}x{image.height}:{difference}:{average}"


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def digests_of(texts: list[bytes]) -> list[tuple]:
    """Stores texts, reads them back from the stored bytes alone, and gives op7's columns after doc_id."""
    stored = [encode(padded(t)) for t in texts]
    out = []
    for text, data, image in zip(texts, stored, decode_many(stored), strict=True):
        if image is None:
            raise ValueError("a stored image can't be read")
        payload = payload_of(image)[: len(text) + (-len(text) % UNIT if text else UNIT)]
        out.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(image)))
    return out


def spans(texts: list[bytes], limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """Runs of texts of about so many bytes."""
    some, held = [], 0
    for t in texts:
        some.append(t)
        held += len(t)
        if held >= limit:
            yield some
            some, held = [], 0
    if some:
        yield some


def media(docs: DataFrame) -> DataFrame:
    """doc_id and the stored image of each text with dimensions and thumbnail hashes; media is the image's bytes."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = [encode(padded(t.as_py() or b"")) for t in batch.column("text")]
            images = decode_many(stored)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(stored, pa.binary()), pa.array([i.width for i in images], pa.int32()), pa.array([i.height for i in images], pa.int32()), pa.array([feature(i) for i in images])], ["doc_id", "media", "width", "height", "feature"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, media binary, width int, height int, feature string")


def digests(docs: DataFrame) -> DataFrame:
    """op7's columns: what each text's image holds when it is read back."""
    prepare(docs.sparkSession)
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for some in spans([t or b"" for t in batch.column("text").to_pylist()]) for r in digests_of(some)]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
