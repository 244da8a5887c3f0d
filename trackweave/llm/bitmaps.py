"""Bitmaps of fixed size over 64-bit keys: which keys a large table may hold, in a few megabytes that can be broadcast.

A key sets several bits while there is room (a Bloom filter). With one bit a key, a sixteenth to an eighth of all other keys would be let through,
so what passes would grow with the whole table, and not with the keys that the bitmap holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shingles import mix

#: Parts in which a bitmap is merged.
PARTS = 64


#: A bitmap has at least and at most this many bits, as logarithms: what is broadcast never exceeds 16 MB.
LEAST_BITS, MOST_BITS = 16, 27


#: Bits that a key sets at most.
PROBES = 4


def sized(keys: int) -> tuple[int, int]:
    """The logarithm of the bits that suit a number of keys, sixteen a key at least, and how many of them a key sets. Beyond MOST_BITS the bitmap lets more through, which costs time only."""
    log_bits = min(MOST_BITS, max(LEAST_BITS, (16 * max(keys, 1) - 1).bit_length()))
    return log_bits, min(PROBES, max(1, int(0.7 * (1 << log_bits) / max(keys, 1))))


def place(key: np.ndarray, bits: int, probe: int = 0) -> np.ndarray:
    key = key.view(np.uint64) if probe == 0 else mix(key.view(np.uint64), 40 + probe)
    return (key & np.uint64(bits - 1)).astype(np.int64)


def may_hold(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each key whether the bitmap may hold it: never false for one that it holds. The bitmap's last byte is the number of bits that a key sets."""
    size, held = (len(bits) - 1) * 8, np.ones(len(key), bool)
    for probe in range(int(bits[-1])):
        left = np.flatnonzero(held)
        at = place(key[left], size, probe)
        held[left] = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return held


def key_filter(keys: DataFrame, suited: tuple[int, int]) -> bytes:
    """The bitmap, as long as ``suited`` says, of a table with one column of well-mixed 64-bit keys. Tasks send what they hold, part by part, and the parts are merged by other tasks."""
    log_bits, probes = suited
    whole_size = (1 << log_bits) // 8
    size = whole_size // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(whole_size, np.uint8)
        for batch in batches:
            for probe in range(probes):
                at = place(batch.column(0).to_numpy(zero_copy_only=False), whole_size * 8, probe)
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for k in range(PARTS):
            part = bits[k * size : (k + 1) * size]
            if part.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "bits": [zlib.compress(part.tobytes(), 1)]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bits = np.frombuffer(zlib.decompress(packed), np.uint8)
                out[part] = out[part] | bits if part in out else bits
        for part, bits in out.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "bits": [zlib.compress(bits.tobytes(), 1)]})

    whole = bytearray(whole_size + 1)
    whole[-1] = probes
    for row in keys.mapInArrow(run, "part int, bits binary").repartition("part").mapInArrow(merge, "part int, bits binary").collect():
        whole[row.part * size : (row.part + 1) * size] = zlib.decompress(row.bits)
    return bytes(whole)
