"""Hashed character n-grams of texts as numpy arrays, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Code points that are handled at once.
PIECE = 1 << 19


def _classes() -> np.ndarray:
    """For each code point below 65,536, the code point of its lower case if it is a letter, and a blank if not."""
    table = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_TABLE: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Code points in lower case, a blank for each that is no letter."""
    if not _TABLE:
        _TABLE.append(_classes())
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _TABLE[0][np.minimum(cp, 0xFFFF)]
    high = cp > 0xFFFF
    if high.any():
        out[high] = [c if chr(c).isalpha() else 32 for c in cp[high].tolist()]
    return out


def _hash(cp: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that starts at each place."""
    h = np.full(len(cp) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for i in range(n):
        h ^= cp[i : len(cp) - n + 1 + i]
        h *= np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h


def hashed(text: str, sizes: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text that aren't blank throughout, piece by piece; pieces overlap so that each n-gram comes once."""
    for at in range(0, max(1, len(text)), PIECE):
        part = " " * (at == 0) + text[at : at + PIECE + max(sizes) - 1]
        last = at + PIECE >= len(text)
        cp = letters(part + " " * last)
        whole = len(cp) if last else PIECE + (at == 0)  # n-grams that start further on belong to the next piece
        for n in sizes:
            if len(cp) >= n:
                h = _hash(cp, n)[:whole]
                real = cp[: len(h)] != 32 if n == 1 else (cp[: len(h)] != 32) | (cp[1 : len(h) + 1] != 32)
                yield (h[real] & np.uint32((1 << bits) - 1)).astype(np.int64)


def crc_mod(doc_id, folds: int) -> "Column":  # noqa: F821
    """crc32 of doc_id as text, modulo the folds; null ids are in no fold."""
    from pyspark.sql import functions as F

    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))
