"""Bloom filters of a fixed size over 64-bit keys, summed over a table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Bits of a filter: a fixed 4 MB. It may pass keys that were never put in, more of them as it fills, and never holds
#: one back, so its size affects speed only.
BITS = 25


def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bit numbers per key."""
    x = keys.view(np.uint64)
    mask = np.uint64((1 << BITS) - 1)
    return (x & mask).astype(np.int64), ((x >> np.uint64(BITS)) & mask).astype(np.int64)


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may have been put in."""
    has = lambda at: (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
    one, two = places(keys)
    return (has(one) & has(two)).astype(bool)


def filter_of(df: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The filter, as bytes of eight bits, of the keys of all rows; each task sums its own before the shuffle."""
    size = 1 << BITS

    def fill(batches):  # noqa: ANN001, ANN202
        bits = np.zeros(size, bool)
        for b in batches:
            if b.num_rows:
                for at in places(keys(b)):
                    bits[at] = True
        words = np.packbits(bits).view(np.int64)
        at = np.flatnonzero(words)
        for i in range(0, len(at), 65_536):
            part = at[i : i + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(words[part])], names=["at", "w"])

    got = df.mapInArrow(fill, "at int, w long").groupBy("at").agg(F.bit_or("w").alias("w")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[got.column("at").to_numpy()] = got.column("w").to_numpy()
    return out.view(np.uint8)
