"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and text contracts: space and the bytes 9 to 13.
WHITE = r"[\x20\x09-\x0D]"

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can reach.

    Where the setting is absent a temporary folder stands in, on a local master only: on a cluster
    every executor would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="spark-grouploom-"))
        base = _own_folder[0]
    return f"{base.rstrip('/')}/grouploom-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends here, and a
    lost executor costs only the tasks that it was running."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def saved_by(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """As ``saved``, with the rows bucketed by ``key``: joins and cogroups on it move only the
    other side. ``buckets`` is raised to the session's number of shuffle partitions."""
    spark = df.sparkSession
    buckets = min(100_000, max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    path, name = shared_folder(spark), f"grouploom_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return spark.table(name)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hot_copies(rows: DataFrame, key: str) -> DataFrame:
    """(key, copies) of the keys with over a thousandth of the rows; at most a thousand keys, and
    two thousand copies."""
    least = rows.count() // 1000 + 1
    return saved(rows.groupBy(key).count().where(F.col("count") > least).select(key, F.ceil(F.col("count") / least).cast("int").alias("copies")), "hot")


def dealt(rows: DataFrame, key: str, hot: DataFrame, salt: str) -> DataFrame:
    """``rows`` with a number ``salt`` that spreads the rows of hot keys."""
    others = [c for c in rows.columns if c != key]
    return rows.join(F.broadcast(hot), key, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*others), F.col("copies")), F.lit(0)).cast("int")).drop("copies")


def copied(unique: DataFrame, key: str, hot: DataFrame, salt: str) -> DataFrame:
    """``unique``, one row per key, with a copy for each ``salt`` of a hot key."""
    every = F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)
    return unique.join(F.broadcast(hot), key, "left").withColumn(salt, F.explode(every)).drop("copies")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def training_rows(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def text_parts(column: pa.Array, limit: int = 2 << 20):
    """Cuts a string column into runs of whole texts of about ``limit`` bytes.

    Yields (first row, UTF-8 bytes, offsets); nulls count as empty texts. A text longer than the
    limit is a run of its own.
    """
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words under which all bits of the result depend on all of the input
    (the public splitmix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[32, *range(9, 14)]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[:] = tables
    return _powers[0], _powers[1]


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return _LOWER[data]


def words_of(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = _IS_WHITE):
    """Start, end and text number of every word in a run of texts (words never cross texts);
    ``outside`` marks the bytes that aren't in words."""
    white = outside[data]
    before = np.ones(len(data) + 1, bool)
    before[1:] = white
    before[offsets] = True
    starts = np.flatnonzero(before[:-1] & ~white)
    after = np.ones(len(data), bool)
    after[:-1] = white[1:]
    inner = offsets[1:][offsets[1:] > 0]
    after[inner - 1] = True
    ends = np.flatnonzero(after & ~white) + 1
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, owner


class Rolling:
    """Hashes of substrings by prefix sums of a polynomial over random byte values. Two objects
    with different seeds are independent."""

    def __init__(self, seed: int):
        base = int(mixed(np.array([seed], np.uint64))[0]) | 5
        self.byte = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.bases, self.up, self.down = (base, pow(base, -1, 1 << 64)), *[np.ones(1, np.uint64)] * 2

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(data):
            self.up, self.down = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(max(len(data), 1 << 20), b, np.uint64)))) for b in self.bases)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.byte[data] * self.up[: len(data)], out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, start, stop) -> np.ndarray:
        return mixed((sums[stop] - sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def grams(self, sums: np.ndarray, length: int) -> np.ndarray:
        """Hashes of all substrings of ``length`` bytes."""
        m = max(0, len(sums) - length)
        return mixed((sums[length : length + m] - sums[:m]) * self.down[:m] + np.uint64(length))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word: a polynomial over random byte values, by prefix sums."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
