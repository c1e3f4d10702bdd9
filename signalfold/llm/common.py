"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalfold.operators.components import discard, new_path, shared_dir, staged  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The characters of [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: bytes.translate table that lower-cases A-Z and leaves every other byte.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII values take the faster built-in path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether df has max_rows rows at most; it reads no more than one row beyond that of each partition."""
    return df.limit(max_rows + 1).count() <= max_rows


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions inside pass batches of `rows` rows at most to Python, so that rows of whole texts take little memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def join_checked(left: DataFrame, right: DataFrame, on, how: str, max_rows: int = 200_000) -> DataFrame:
    """Broadcast right only if a count proves that it has max_rows rows at most; a shuffled join otherwise."""
    return left.join(F.broadcast(right) if small_enough(right, max_rows) else right, on, how)


def planes(x: np.ndarray) -> bytes:
    """Numbers from 0 as planes of bytes, the lowest first, without planes that are zero throughout."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return np.ascontiguousarray(np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        found = np.frombuffer(data, np.uint8).reshape(-1, n)
        out[:, : len(found)] = found.T
    return out.view("<i8").ravel()


class Kept:
    """A bounded store of computed values: entries unused for a while go first, half the store at a time."""

    def __init__(self, size: int):
        self.half, self.young, self.old = max(size // 2, 1), {}, {}

    def missing(self, keys: set) -> list:
        """Those of keys that must be computed; the others are in `young` from now on."""
        young = self.young
        lost = [k for k in keys if k not in young]
        if len(young) + len(lost) > self.half:
            self.old, self.young = young, {}
            young, lost = self.young, list(keys)
        old, new = self.old, []
        for k in lost:
            if k in old:
                young[k] = old[k]
            else:
                new.append(k)
        return new
