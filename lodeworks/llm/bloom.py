"""A Bloom filter of fixed size over long ids: lets a scan leave most rows behind before a shuffle.

It is built per task, joined bit by bit on the driver one task after another, and sent out: its size is a parameter, not a
matter of the data. A fuller filter lets more rows through; it never loses one, and joins decide in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.textkit import mix

BITS = 1 << 25
PROBES = 4


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    h = mix(ids.astype(np.int64).view(np.uint64) ^ np.uint64(0xA0761D6478BD642F))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


class Bloom:
    def __init__(self, data: np.ndarray):
        self.data = data

    def holds(self, ids: np.ndarray) -> np.ndarray:
        at = _places(ids, len(self.data) * 8)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)


def bloom_of(ids: DataFrame, bits: int = BITS, tasks: int = 16) -> Bloom:
    """Of the one long column of ids; nulls are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = _places(batch.column(0).drop_null().to_numpy(), bits).ravel()
            np.bitwise_or.at(data, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        used = np.flatnonzero(data)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array([used.astype("<u4").tobytes()]), pa.array([data[used].tobytes()])], ["at", "bits"])

    made = ids.select(F.col(ids.columns[0]).cast("long")).coalesce(tasks).mapInArrow(work, "at binary, bits binary")
    data = np.zeros(bits // 8, np.uint8)
    for at, own in made.toLocalIterator():
        data[np.frombuffer(at, "<u4")] |= np.frombuffer(own, np.uint8)
    return Bloom(data)
