"""Batches of whole texts, and an exchange of packed keys between batches and hash buckets.

A corpus job often needs, for every key of every text, something that only the whole corpus
knows. Instead of a row per occurrence, each batch sends its distinct keys once, packed by hash
bucket; bucket tasks answer in the order of the keys; answers meet their batch again. What moves
is the batches' distinct keys, so copies and frequent keys collapse before the shuffle.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, saved_by, text_parts

#: Bytes of text in a batch, about.
BATCH_BYTES = 12 << 20
PACKED = "batch long, ids array<long>, ends array<long>, size long, blob binary"


def _pack(limit: int):
    def run(batches):
        ids, blobs, sizes, held = [], [], [], 0

        def row():
            whole = b"".join(blobs)
            number = int.from_bytes(os.urandom(8), "little") >> 1
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([np.cumsum(sizes)], pa.list_(pa.int64())), pa.array([len(whole)], pa.int64()), pa.array([pa.compress(whole, "zstd", asbytes=True)], pa.binary())],
                names=["batch", "ids", "ends", "size", "blob"],
            )

        for batch in batches:
            numbers = batch.column("doc_id").to_pylist()
            for first, data, offsets in text_parts(batch.column("text")):
                ids += numbers[first : first + len(offsets) - 1]
                sizes += np.diff(offsets).tolist()
                blobs.append(data.tobytes())
                held += len(data)
                if held >= limit:
                    yield row()
                    ids, blobs, sizes, held = [], [], [], 0
        if ids:
            yield row()

    return run


def packed(docs: DataFrame, limit: int = BATCH_BYTES) -> tuple[DataFrame, int]:
    """One row per batch of ``docs`` (doc_id, text; null texts are empty), and the bytes of all
    texts. Batches are written, bucketed by their numbers: the numbers are drawn once and then
    fixed, and answers come to a batch without moving its texts again."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return saved_by(docs.mapInArrow(_pack(limit), PACKED), "batch", size // limit + 1), size


class Batch:
    """A batch's ids and texts, read from row ``k`` of an Arrow batch."""

    def __init__(self, rows: pa.RecordBatch, k: int = 0):
        get = lambda name: rows.column(name)[k]
        self.number = get("batch").as_py()
        self.ids = get("ids").as_py()
        self.ends = np.array(get("ends").as_py(), np.int64)
        size = get("size").as_py()
        self.data = np.frombuffer(pa.decompress(get("blob").as_buffer(), size, "zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)

    def parts(self, limit: int = 1 << 20):
        """(first text, bytes, offsets) of runs of whole texts of about ``limit`` bytes."""
        starts = np.concatenate(([0], self.ends))
        row, n = 0, len(self.ends)
        while row < n:
            stop = int(np.searchsorted(starts, starts[row] + limit, side="right")) - 1
            stop = min(n, max(stop, row + 1))
            yield row, self.data[starts[row] : starts[stop]], starts[row : stop + 1] - starts[row]
            row = stop


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys) % np.uint64(buckets)).astype(np.int64)


def planes(values: np.ndarray) -> bytes:
    """Byte planes: the high bytes of sorted keys and of ids compress well."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_planes(data: bytes, n: int, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, n).T).view(kind).ravel()


def by_bucket(bucket: np.ndarray, buckets: int):
    """Places of the keys of each bucket that has any, in the keys' order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        if cuts[b] < cuts[b + 1]:
            yield b, order[cuts[b] : cuts[b + 1]]


def merged_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool))
    return k[first], np.add.reduceat(c, first) if len(first) else np.zeros(0, np.int64)
