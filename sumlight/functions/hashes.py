"""MD5 of many short texts that begin alike, in numpy: the first 32 bits only."""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np

_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MASK = 0xFFFFFFFF
#: Characters of beginning and ending together that fit one block of MD5.
MOST = 55


def _head(words: list, n: int) -> np.ndarray:
    """The digest's first word of one block. words: 16 of a number for all texts, or an array each."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _BEGIN)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the last three steps change the other words only
        turn, at = divmod(i, 16)
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            g = i
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            g = (5 * i + 1) % 16
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            g = 7 * i % 16
        f += a
        if isinstance(words[g], int):
            f += np.uint32((_SINES[i] + words[g]) & _MASK)
        else:
            f += words[g]
            f += np.uint32(_SINES[i])
        by = _TURNS[turn][at % 4]
        np.left_shift(f, np.uint32(by), out=t)
        f >>= np.uint32(32 - by)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return b + np.uint32(_BEGIN[0])


class Endings:
    """Texts of ASCII bytes, each to be hashed after a common beginning."""

    def __init__(self, texts: np.ndarray) -> None:
        self.texts = texts
        sizes = np.char.str_len(texts)
        self.groups = []  # of one length: their places, and words by the beginning's length modulo 4
        for size in np.unique(sizes).tolist():
            places = np.flatnonzero(sizes == size)
            own = np.frombuffer(texts[places].astype(f"S{size}").tobytes(), np.uint8).reshape(len(places), size)
            shifted = []
            for shift in range(4):
                wide = np.zeros((len(places), (shift + size) // 4 * 4 + 4), np.uint8)
                wide[:, shift : shift + size] = own
                wide[:, shift + size] = 0x80
                shifted.append(np.ascontiguousarray(wide.view("<u4").T))
            self.groups.append((size, places, shifted))

    def heads(self, begin: bytes) -> np.ndarray:
        """Of MD5(begin + text) the first 32 bits, as the number that the first 8 hexadecimal digits write."""
        out = np.empty(len(self.texts), np.int64)
        at, shift = divmod(len(begin), 4)
        fixed = [int.from_bytes(begin[k : k + 4], "little") for k in range(0, len(begin), 4)]
        for size, places, shifted in self.groups:
            if len(begin) + size > MOST:
                out[places] = [int.from_bytes(md5(begin + t).digest()[:4], "big") for t in self.texts[places].tolist()]
                continue
            words: list = [0] * 16
            words[: len(fixed)] = fixed
            for k, w in enumerate(shifted[shift]):
                words[at + k] = w | np.uint32(fixed[at]) if k == 0 and shift else w
            words[14] = 8 * (len(begin) + size)
            out[places] = _head(words, len(places)).byteswap()
        return out
