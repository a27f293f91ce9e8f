"""Texts as streams of words in numpy: normal form and word hashes, some PAGE bytes at a time.

Words are what stands between white space (space, \\x09-\\x0D), with A-Z lower-cased. Bytes need not be valid UTF-8, and a
text or a word may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import LOWER

#: Bytes handled at once.
PAGE = 1 << 20
END = b"\n"
#: Lower-cases A to Z and makes all white space spaces.
PLAIN = bytes(32 if b == 32 or 9 <= b <= 13 else LOWER[b] for b in range(256))
#: Words are polynomials of random numbers for bytes, modulo 2**64; the base is odd and has an inverse.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


def groups(column: pa.Array, size: int = PAGE) -> Iterator[list[bytes]]:
    """Texts of a binary column in order (null: empty), some size bytes at a time, or one longer text."""
    some: list[bytes] = []
    held = 0
    for x in column:
        text = x.as_py() or b""
        if some and held + len(text) > size:
            yield some
            some, held = [], 0
        some.append(text)
        held += len(text) + 1
    if some:
        yield some


def spans(text: bytes, size: int = PAGE) -> Iterator[bytes]:
    """The text cut at white space, some size bytes at a time; a longer word stays whole."""
    at = 0
    while len(text) - at > size:
        stop = max(text.rfind(b" ", at, at + size), text.rfind(b"\n", at, at + size))
        if stop <= at:
            found = [x for x in (text.find(b" ", at + size), text.find(b"\n", at + size)) if x >= 0]
            if not found:
                break
            stop = min(found)
        yield text[at:stop]
        at = stop
    yield text[at:]


def normal(texts: list[bytes]) -> np.ndarray:
    """Bytes of the texts' words, joined by single spaces, with END after each text."""
    if len(texts) == 1 and len(texts[0]) > PAGE:
        return _normal_long(texts[0])
    data = np.frombuffer(b"".join([x for t in texts for x in (t.translate(PLAIN), END)]), np.uint8)
    gap = (data == 32) | (data == END[0])
    data = data[(data != 32) | ~np.append(gap[1:], True)]  # of a run of spaces the last, if a word follows
    first = np.append(True, data[:-1] == END[0]) if len(data) else np.zeros(0, bool)
    return data[(data != 32) | ~first]


def _normal_long(text: bytes) -> np.ndarray:
    out: list[np.ndarray] = []
    for at in range(0, len(text), PAGE):
        data = np.frombuffer(text[at : at + PAGE].translate(PLAIN), np.uint8)
        data = data[(data != 32) | ~np.append(data[1:] == 32, False)]
        if data[0] == 32 and (not out or out[-1][-1] == 32):
            data = data[1:]
        if len(data):
            out.append(data)
    if out and out[-1][-1] == 32:
        out[-1] = out[-1][:-1]
    return np.concatenate([*out, np.frombuffer(END, np.uint8)])


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class Hashes:
    """Hashes of the words of normal texts."""

    def __init__(self):
        self.symbols = np.random.default_rng(5).integers(0, 1 << 64, 256, np.uint64)
        self.up = self.down = np.zeros(0, np.uint64)

    def of_page(self, page: np.ndarray):
        """Hash of every word, and the place where it ends, some PAGE bytes at a time."""
        if len(self.up) < min(len(page), PAGE):
            self.up, self.down = powers(BASE, PAGE), powers(UNBASE, PAGE)
        begun, size = np.zeros(1, np.uint64), 0  # the word that the bytes so far have not ended
        for at in range(0, len(page), PAGE):
            data = page[at : at + PAGE]
            gaps = np.flatnonzero((data == 32) | (data == END[0]))
            value = self.symbols[data]
            value *= self.up[: len(data)]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
            starts = np.append(0, gaps + 1)
            stops = np.append(gaps, len(data))
            value = sums[stops] - sums[starts]
            value *= self.down[np.minimum(starts, PAGE - 1)]
            sizes = stops - starts
            value[:1] *= np.uint64(pow(BASE, size, 1 << 64))
            value[:1] += begun
            sizes[0] += size
            begun, size = value[-1:], int(sizes[-1])
            value, sizes = value[:-1], sizes[:-1]
            real = sizes > 0
            value = value[real]
            value ^= value >> np.uint64(32)
            value *= np.uint64(0xD6E8FEB86659FD93)
            yield value, gaps[real] + at
