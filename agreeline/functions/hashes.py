"""MD5 of many short texts at once, as arrays of numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np

#: Rotations and constants of the 64 steps, and the first state (RFC 1321).
TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes of a text that one step of 64 bytes holds with its end and length.
SHORT = 55
#: Fewer hashes than these are quicker one by one.
FEW = 1024


class Tails:
    """Texts of one length, a row of bytes each, that are hashed after many prefixes."""

    def __init__(self, texts: np.ndarray):
        self.texts, self.size, self.words = texts, -1, []

    def md5(self, prefixes: list[bytes], at_once: int) -> Iterator[tuple[int, np.ndarray]]:
        """Blocks of about ``at_once`` hashes, of all texts after some of the prefixes: the first prefix's place, and an
        array by number, prefix and text of the four numbers that 8 hexadecimal digits each of an MD5 make."""
        start, most = 0, max(1, at_once // len(self.texts))
        for _, same in groupby(prefixes, len):
            same = [*same]
            for at in range(0, len(same), most):
                yield start + at, self._hashed(same[at : at + most])
            start += len(same)

    def _hashed(self, prefixes: list[bytes]) -> np.ndarray:
        """The hashes after prefixes of one length."""
        (n, length), size, m = self.texts.shape, len(prefixes[0]), len(prefixes)
        if n * m < FEW or size + length > SHORT:
            found = b"".join([hashlib.md5(p + t).digest() for p in prefixes for t in map(np.ndarray.tobytes, self.texts)])
            return np.frombuffer(found, ">u4").reshape(m, n, 4).transpose(2, 0, 1).astype(np.uint32)
        if size != self.size:
            self.size, self.words = size, self._words(size)
        width = -(-size // 4)
        heads = np.frombuffer(b"".join([p.ljust(4 * width, b"\0") for p in prefixes]), "<u4").reshape(m, width)
        heads = heads if m > 1 else heads[0]  # of one prefix, numbers
        words = [np.add(w, heads[..., i : i + 1] if m > 1 else heads[i]) if i < width else w for i, w in enumerate(self.words)]
        words = [np.broadcast_to(w, (m, n)).ravel() if np.ndim(w) else w for w in words]
        return np.stack(_rounds(words, m * n)).byteswap(inplace=True).reshape(4, m, n)

    def _words(self, start: int) -> list:
        """The 16 words of the texts' only step; those that no text reaches are one number for all."""
        n, length = self.texts.shape
        end = start + length
        step = np.zeros((n, 64), np.uint8)
        step[:, start:end] = self.texts
        step[:, end] = 0x80
        words = step.view("<u4")
        out = [words[:, i].astype(np.uint32) if start // 4 <= i <= (end - 1) // 4 else np.uint32(words[0, i]) for i in range(16)]
        out[14] = np.uint32(8 * end)
        return out


def _rounds(words: list, n: int) -> list[np.ndarray]:
    state, same = START, 0
    while same < 16 and not isinstance(words[same], np.ndarray):  # steps that are the same for all
        a, b, c, d = state
        f = (((c ^ d) & b ^ d) + a + int(words[same]) + SINES[same]) % 2**32
        state = d, (b + (f << TURNS[same] | f >> 32 - TURNS[same])) % 2**32, b, c
        same += 1
    a, b, c, d = (np.full(n, s, np.uint32) for s in state)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(same, 64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
            at = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
            at = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
            at = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
            at = 7 * i % 16
        f += a
        if isinstance(words[at], np.ndarray):
            f += words[at]
            f += np.uint32(SINES[i])
        else:
            f += np.uint32((int(words[at]) + SINES[i]) % 2**32)
        np.left_shift(f, np.uint32(TURNS[i]), out=g)
        np.right_shift(f, np.uint32(32 - TURNS[i]), out=f)
        f |= g
        f += b
        a, d, c, b, f = d, c, b, f, a
    return [x + np.uint32(s) for x, s in zip((a, b, c, d), START, strict=True)]


def by_length(texts: list[bytes]) -> list[tuple[np.ndarray, Tails]]:
    """The texts of each length, and their places."""
    where: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        where.setdefault(len(t), []).append(i)
    return [(np.array(at), Tails(np.frombuffer(b"".join([texts[i] for i in at]), np.uint8).reshape(len(at), k))) for k, at in where.items()]


def numerals(low: int, high: int) -> list[tuple[int, Tails]]:
    """The numbers from low to below high as decimal text, those of each length with the first of them."""
    out = []
    while low < high:
        digits = len(str(low))
        end = min(high, 10**digits)
        tens = 10 ** np.arange(digits - 1, -1, -1)
        out.append((low, Tails((np.arange(low, end)[:, None] // tens % 10 + ord("0")).astype(np.uint8))))
        low = end
    return out
