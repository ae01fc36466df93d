"""Vectorised word and n-gram hashes of many texts at once (NumPy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes of text that are hashed in one go; a longer text is cut into overlapping pieces.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in ((0, _BASE), (1, _BASE_INV)):
            p = np.full(max(n, PIECE + 1), base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``joined`` (words apart by one space, texts apart by one newline) and each word's text.

    Every text must hold a word.
    """
    a = np.frombuffer(joined, np.uint8)
    up, down = _powers(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[:-1], out=sums[1:])
    ends = np.append(np.flatnonzero((a == 32) | (a == 10)), len(a))
    starts = np.empty_like(ends)
    starts[0] = 0
    starts[1:] = ends[:-1] + 1
    words = mix((sums[ends] - sums[starts]) * down[starts])
    text = np.zeros(len(words), np.int64)
    text[1:] = np.cumsum(a[ends[:-1]] == 10)
    return words, text


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    x = np.full(m, np.uint64(n), np.uint64)
    for k in range(n):
        x += words[k : k + m] * _PLACE[k]
    return mix(x)


def pieces(texts: list[list[bytes]], overlap: int) -> Iterator[tuple[list[int], bytes]]:
    """Texts (as word lists, none empty) joined into blocks of about ``PIECE`` bytes: the texts' numbers, the block.

    A text that is longer comes in several blocks, which share ``overlap`` words.
    """
    block: list[bytes] = []
    numbers: list[int] = []
    size = 0
    for i, words in enumerate(texts):
        whole = b" ".join(words)
        if len(whole) <= PIECE:
            parts = [whole]
        else:
            parts, begin = [], 0
            while True:
                end, room = begin, PIECE
                while end < len(words) and (room > 0 or end - begin <= overlap):
                    room -= len(words[end]) + 1
                    end += 1
                parts.append(b" ".join(words[begin:end]))
                if end >= len(words):
                    break
                begin = end - overlap
        for p in parts:
            if block and size + len(p) > PIECE:
                yield numbers, b"\n".join(block)
                block, numbers, size = [], [], 0
            block.append(p)
            numbers.append(i)
            size += len(p) + 1
    if block:
        yield numbers, b"\n".join(block)
