"""Hashed text features that the classifiers share, and a bounded, reproducible sample of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; remainder 2 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def byte_grams(text: bytes, dims: int) -> np.ndarray:
    """Counts of the byte trigrams of ``text`` in ``dims`` (a power of two) hash buckets, as float32."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 3:
        b = np.concatenate([b, np.full(3 - len(b), 32, np.uint32)])
    h = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    h *= np.uint32(2654435761)
    h >>= np.uint32(32 - (dims - 1).bit_length())
    return np.bincount(h, minlength=dims).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    """Square roots of counts, at length 1: long and short texts weigh alike."""
    x = np.sqrt(x)
    return x / max(float(np.sqrt(x @ x)), 1e-9)


def thin(df: DataFrame, key: Column, most: int, of: int) -> DataFrame:
    """About ``most`` of the ``of`` rows, chosen by a hash of ``key``: the same rows on every run."""
    if of <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * most / of))
