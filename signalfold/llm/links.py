"""Connected components of links between integer nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from signalfold.operators.components import components  # noqa: F401

#: Links of a task held at a time.
HELD = 1 << 20


def joining(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which links join what the links before them do not: fewer than there are nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    above, keep = list(range(len(nodes))), np.zeros(len(a), bool)
    for k, (i, j) in enumerate(zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True)):
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        while above[j] != j:
            above[j] = above[above[j]]
            j = above[j]
        if i != j:
            above[max(i, j)] = min(i, j)
            keep[k] = True
    return keep


def thinned(links: DataFrame) -> DataFrame:
    """links (a long, b long) without those that other links of their task make needless, for components()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += b.num_rows
            if n >= HELD:
                yield out(held)
                held, n = [], 0
        if n:
            yield out(held)

    def out(held: list[tuple]) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        keep = joining(a, b)
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").mapInArrow(run, "a long, b long")
