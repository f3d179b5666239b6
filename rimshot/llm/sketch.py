"""Counts of hashes in a fixed number of buckets, over all rows, without a row for each hash."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_BITS = 18
SCHEMA = "block int, counts binary"


class BucketCounts:
    """Counters of the low ``bits`` of hashes, written and added up in blocks. One task counts up to 255 in a
    bucket, one byte each; sums over tasks go on."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.counts = np.zeros(1 << bits, np.uint8)
        self.block = min(1 << bits, 1 << BLOCK_BITS)

    def add(self, hashes: np.ndarray) -> None:
        at, n = np.unique(hashes & self.mask, return_counts=True)
        at = at.astype(np.int64)
        self.counts[at] = np.minimum(self.counts[at].astype(np.int64) + n, 255)

    def rows(self) -> Iterator[tuple[int, bytes]]:
        for b in range(0, len(self.counts), self.block):
            part = self.counts[b: b + self.block]
            if part.any():
                yield b // self.block, zlib.compress(part.tobytes(), 1)


def bits_for(df: DataFrame, bytes_a_bucket: int = 32, least: int = 16, most: int = 26) -> int:
    """Bits of a sketch that follows the size of the input, which the plan knows, up to 2**``most`` buckets."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(most, (size // bytes_a_bucket).bit_length()))


def summed(rows: DataFrame, bits: int, least: int) -> np.ndarray:
    """Boolean array over all buckets: whose count in ``rows`` (block, counts) is at least ``least``.

    Each block is added up in one task, which holds one array for each of its blocks; the driver gets one bit a
    bucket, so its share does not grow with the data.
    """
    size = min(1 << bits, 1 << BLOCK_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(raw), np.uint8)
                if block not in total:
                    total[block] = np.zeros(len(part), np.uint32)
                total[block] += part
        if total:
            bits_of = [np.packbits(total[b] >= least).tobytes() for b in total]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(bits_of, pa.binary())],
                                             ["block", "counts"])

    out = np.zeros(1 << bits, bool)
    n_blocks = max(1, (1 << bits) // size)
    dealt = rows.select("block", "counts").repartition(min(n_blocks, 64), "block")
    for r in dealt.mapInArrow(run, SCHEMA).collect():
        out[r["block"] * size: (r["block"] + 1) * size] = np.unpackbits(np.frombuffer(r["counts"], np.uint8))[:size].astype(bool)
    return out
