"""Hashed byte n-grams and words of texts."""

from __future__ import annotations

import re
import zlib

import numpy as np

_WORD = re.compile(r"[^\W\d_]+")


def hashed(text: str | None, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Ids below ``2**bits`` of all n-grams of the given sizes of a text's UTF-8 bytes, repeats included."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    out = []
    mark = np.zeros(len(raw), np.uint32)
    for n in range(1, max(sizes) + 1):
        if len(raw) < n:
            break
        mark = (mark[: len(raw) - n + 1] * np.uint32(0x01000193)) ^ (raw[n - 1 :] + np.uint32(n))
        if n in sizes:
            mixed = mark * np.uint32(0x9E3779B1)
            out.append((mixed ^ (mixed >> np.uint32(15))) & np.uint32((1 << bits) - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def hashed_words(text: str | None, bits: int) -> np.ndarray:
    """Distinct ids below ``2**bits`` of a text's lower-cased words, which are runs of letters."""
    mask = (1 << bits) - 1
    found = {zlib.crc32(w.encode("utf-8", "surrogatepass")) & mask for w in set(_WORD.findall((text or "").lower()))}
    return np.fromiter(found, np.int64, len(found))


def sample_mark(column, fraction: float):
    """A filter that keeps about ``fraction`` of the ids, the same ones in every run."""
    from pyspark.sql import functions as F

    return F.pmod(F.xxhash64(F.lit("sample"), column.cast("string")), F.lit(1 << 40)) < int(min(1.0, fraction) * (1 << 40))
