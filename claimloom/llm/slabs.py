"""Slabs: some megabytes of consecutive documents as one row.

A slab table is written once in the shared folder, bucketed by slab, so several passes read
it without shuffling the texts again. Between passes, workers exchange packed arrays of
fingerprints: a slab sends each distinct key once, however many of its documents hold it,
so a key that a third of all documents share costs a row for each slab and no more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, buckets_for, size_of

SLAB = "slab long, doc_id array<long>, size array<int>, data binary"
#: A null doc_id counts as larger than any other.
NO_ID = (1 << 63) - 1


def spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash (Murmur3, seed 42) of longs, by which a bucketed table deals its rows."""
    u = np.uint32
    turn = lambda v, r: (v << u(r)) | (v >> u(32 - r))
    h = np.full(len(x), 42, u)
    for k in (x.astype(np.uint64) & np.uint64(0xFFFFFFFF), x.astype(np.uint64) >> np.uint64(32)):
        h = turn(h ^ (turn(k.astype(u) * u(0xCC9E2D51), 15) * u(0x1B873593)), 13) * u(5) + u(0xE6546B64)
    h ^= u(8)
    h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
    h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
    return (h ^ (h >> u(16))).view(np.int32)


def numbers_in(first: int, bucket: int, buckets: int) -> Iterator[int]:
    """Numbers from ``first`` on that Spark puts into ``bucket``."""
    while True:
        x = np.arange(first, first + 4096, dtype=np.int64)
        yield from x[np.mod(spark_hash(x).astype(np.int64), buckets) == bucket].tolist()
        first += 4096


def slab_table(docs: DataFrame, slab_bytes: int = 2 << 20, level: int = 1) -> DataFrame:
    """``docs`` (doc_id, text) as slabs; null texts are empty, repeated rows stay. Eight or more consecutive slabs
    of a task share a bucket, and so a file: a slab's number is chosen for the bucket it gives."""
    n = buckets_for(docs)
    size = size_of(docs)
    run = max(8, size // n // slab_bytes) if size < 1 << 50 else 8

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        ids: list = []
        parts: list = []
        held = 0
        numbers = iter(())

        def row() -> pa.RecordBatch:
            nonlocal numbers
            if made % run == 0:
                numbers = numbers_in((task << 40) + (made << 24), (task + made // run) % n, n)
            data = zstandard.ZstdCompressor(level=level).compress(b"".join(parts))
            return pa.RecordBatch.from_arrays(
                [pa.array([next(numbers)], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([[len(x) for x in parts]], pa.list_(pa.int32())), pa.array([data], pa.binary())],
                names=["slab", "doc_id", "size", "data"])

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for i, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                text = text.as_py() or b""
                if parts and held + len(text) > slab_bytes:
                    yield row()
                    ids, parts, held, made = [], [], 0, made + 1
                ids.append(i)
                parts.append(text)
                held += len(text)
        if parts:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bucketed(rows.mapInArrow(pack, SLAB), "slabs", "slab", n)


class Slab:
    """One row of a slab table."""

    def __init__(self, slab: int, doc_id: list, size: list, data: bytes):
        self.slab = slab
        self.ids = doc_id
        self.size = np.asarray(size, np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.data = zstandard.ZstdDecompressor().decompress(data) if self.start[-1] else b""
        self.order_id = np.array([NO_ID if i is None else i for i in doc_id], np.int64)


def each_slab(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Slab, dict]]:
    for batch in batches:
        names = batch.schema.names
        for k in range(batch.num_rows):
            row = {n: batch.column(j)[k].as_py() for j, n in enumerate(names)}
            yield Slab(row.pop("slab"), row.pop("doc_id"), row.pop("size"), row.pop("data")), row


def with_replies(slabs: DataFrame, replies: DataFrame, buckets: int) -> DataFrame:
    """Each slab with the list ``replies`` of the (kind, blob) that were sent to it. Replies are
    dealt as the slab table is bucketed, so that the slabs stay where they are."""
    packed = replies.repartition(buckets, "slab").groupBy("slab").agg(F.collect_list(F.struct("kind", "blob")).alias("replies"))
    return slabs.join(packed.hint("merge"), "slab", "left")


def by_bucket(rows: DataFrame, fn: Callable, schema: str) -> DataFrame:
    return rows.groupBy("bucket").applyInPandas(fn, schema)


def planes(x: np.ndarray, n: int) -> bytes:
    """The n low bytes of each 64-bit value, byte by byte, so that equal high bytes compress."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def unplanes(data: memoryview | bytes, n: int, count: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8, n * count).reshape(n, count).T
    return out.reshape(-1).view("<u8")


def pack(columns: list[tuple[np.ndarray, int]]) -> bytes:
    return b"".join(planes(x, n) for x, n in columns)


def unpack(data: bytes, widths: list[int]) -> list[np.ndarray]:
    count, at, out = len(data) // sum(widths), 0, []
    for n in widths:
        out.append(unplanes(data[at : at + n * count], n, count))
        at += n * count
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Hashes of any substring from prefix sums, over a random value for each byte: two polynomials modulo
    the prime 2^31 - 1 with bases of their own, 62 bits together. Strings of n bytes that differ have equal
    hashes for at most about n of the bases of either, whatever their letters."""

    P = np.uint64((1 << 31) - 1)
    BASES = (1_437_926_351, 862_091_677)

    def __init__(self, seed: int = 17):
        self.table = np.random.default_rng(seed).integers(1, int(self.P), (2, 256), np.uint64)
        self.up = self.down = np.ones((2, 1), np.uint32)

    @classmethod
    def fold(cls, x: np.ndarray) -> np.ndarray:
        """Congruent, below 2^33; below 2^32 for products."""
        return (x & cls.P) + (x >> np.uint64(31))

    @classmethod
    def reduced(cls, x: np.ndarray) -> np.ndarray:
        x = cls.fold(cls.fold(cls.fold(x)))
        return np.where(x >= cls.P, x - cls.P, x)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if self.up.shape[1] <= len(data):
            n = max(len(data) + 1, 1 << 19)
            powers = []
            for bases in (self.BASES, [pow(b, -1, int(self.P)) for b in self.BASES]):
                lanes = []
                for base in bases:
                    x, step = np.ones(1, np.uint64), base
                    while len(x) < n:
                        x, step = np.concatenate([x, self.reduced(x * np.uint64(step))]), step * step % int(self.P)
                    lanes.append(x[:n].astype(np.uint32))
                powers.append(np.stack(lanes))
            self.up, self.down = powers
        out = np.zeros((2, len(data) + 1), np.uint64)
        for k in range(2):
            np.cumsum(self.fold(self.table[k][data] * self.up[k, : len(data)]), out=out[k, 1:])
        return out

    def lane(self, k: int, sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        """One polynomial's value, below 2^31 - 1."""
        return self.reduced(self.fold(self.fold(sums[k][end] - sums[k][start])) * self.down[k][start])

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.lane(0, sums, start, end) << np.uint64(31)) | self.lane(1, sums, start, end))
