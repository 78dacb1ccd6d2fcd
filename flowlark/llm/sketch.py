"""How frequent hashed values are over a whole table, in a sketch of fixed size."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Slots of the sketch: a fixed size (4 MB of classes) for any input.
BITS = 22
_SEGMENT = 1 << 16


def _sum(parts: pa.Table) -> pa.Table:
    total = np.zeros(_SEGMENT, np.uint64)
    for x in parts["counts"]:
        total += np.frombuffer(zlib.decompress(x.as_buffer()), np.uint32)
    classes = np.minimum(np.log2(total + 1) * 4, 255).astype(np.uint8).tobytes()
    return pa.table({"segment": parts["segment"][:1], "counts": pa.array([classes], pa.binary())})


def frequency_classes(rows: DataFrame, values: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """For each slot, how often the 64-bit ``values`` of all batches fall into it (quarter powers of two).

    Used to order values, which need only be the same everywhere; so a sketch of bounded size is enough
    to put the most frequent last.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.uint32)
        for batch in batches:
            for v in values(batch):
                np.add.at(total, (v >> np.uint64(64 - BITS)).astype(np.int64), np.uint32(1))
        parts = [zlib.compress(x.tobytes(), 1) for x in total.reshape(-1, _SEGMENT)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["segment", "counts"])

    schema = "segment int, counts binary"
    out = np.zeros(1 << BITS, np.uint8)
    for r in rows.mapInArrow(part, schema).groupBy("segment").applyInArrow(_sum, schema).collect():  # 64 rows of 64 kB, whatever the input
        out[r.segment * _SEGMENT : (r.segment + 1) * _SEGMENT] = np.frombuffer(r.counts, np.uint8)
    return out


def order_keys(value: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Sort keys: the frequency class first, then the hash (of which 8 bits give way)."""
    rank = classes[(value >> np.uint64(64 - BITS)).astype(np.int64)].astype(np.uint64)
    return (rank << np.uint64(56)) | (value >> np.uint64(8))
