"""Whitening of embeddings; the covariance comes from variances alone (polarisation).

For every dimension a and every sum of two dimensions a + b, Spark adds up exact squares of centred
integers. The cross-covariances are differences of these variances,

    2 cov(a, b) = var(a + b) - var(a) - var(b),

and the assembled matrix goes to ``eigh``.

* The fit list is the distinct vectors; copies collapse before the shuffle of ``distinct``.
* Values are centred on the integer c_a next to the mean S_a / n. With y = x - c and T = sum of y,
  n^2 var(a) = n * sum(y^2) - T^2, all in whole numbers, so nothing is lost to the large offset.
* A task keeps one square sum per pair of dimensions, whatever its rows, and gives it in two halves of
  31 bits; Spark adds them up per pair. Only these sums, ``width * (width + 1) / 2`` of them, reach the
  driver; ``MOST`` bounds the width.
* Rows are then projected where they lie.

Defined results: null vectors, and vectors with null or non-finite entries or with an entry whose
``64 * c`` no long can hold, take no part and have no rows. Shorter vectors are as if padded by zeros
(an empty one is all zeros). Rows that repeat a vec_id or have none each give their own rows. Ties of
eigenvalues are numbered as ``eigh`` returns them, one way for all rows. A component whose eigenvalue
is rounding error beside the largest (constant or dependent dimensions, or a single distinct vector)
has no direction to scale: its ``whitened`` is null and it stays out of ``identity_error``, which is 0
if no component is left. ``explained`` is null where all variance is 0. A ``deviation`` beyond a long is
null. An empty table gives no rows; extra columns take no part.
"""

from __future__ import annotations

from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import saved, table

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Dimensions at most: the driver holds a matrix of this width.
MOST = 4096
ROWS = 4096
_SAFE = 1 << 31


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column as longs, padded to ``width`` with the image of zero."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
    sizes = np.diff(ends)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.full((len(sizes), width), SHIFT, np.int64)
    inside = np.arange(width) < sizes[:, None]
    out[inside] = flat
    return out


def square_sums(y: np.ndarray) -> list[int]:
    """Sums of squares of every column (first) and of every sum of two columns, exact."""
    width = y.shape[1]
    most = int(np.abs(y).max(initial=0))
    if most * 2 >= _SAFE:
        y = y.astype(object)
    total: list[int] = []
    for a in range(width):
        s = np.concatenate((y[:, a : a + 1], y[:, a : a + 1] + y[:, a + 1 :]), axis=1)
        if s.dtype == object or (2 * most) ** 2 * len(s) >= 1 << 63:
            total += [int(v) for v in (s.astype(object) ** 2).sum(axis=0)] if len(s) else [0] * s.shape[1]
        else:
            total += np.einsum("ij,ij->j", s, s).tolist()
    return total


def _sums_of(width: int, centre: list[int], pairs: bool):
    """Per task: rows (k, part, value) whose values times 2**(31 * part) add up to sum k."""

    def run(batches):
        c = np.array(centre, np.int64)
        total = [0] * ((width * (width + 1) // 2) if pairs else width)
        for batch in batches:
            y = matrix(batch.column(0), width) - c
            for a in range(0, len(y), ROWS):
                part = y[a : a + ROWS]
                if pairs:
                    new = square_sums(part)
                else:  # halves of 32 bits can't overflow over ROWS rows
                    new = [int(h) * (1 << 32) + int(v) for h, v in zip((part >> 32).sum(axis=0), (part & 0xFFFFFFFF).sum(axis=0), strict=True)]
                total = [s + t for s, t in zip(total, new, strict=True)]
        out = []
        for k, s in enumerate(total):
            part = 0
            while s:
                s, low = s >> 31 if s >= 0 else -((-s) >> 31), (abs(s) & (_SAFE - 1)) * (1 if s >= 0 else -1)
                if low:
                    out.append((k, part, low))
                part += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["k", "part", "value"])

    return run


def exact_sums(vectors: DataFrame, width: int, centre: list[int], pairs: bool) -> list[int]:
    """Sums of the centred columns, or square sums of columns and of sums of two columns."""
    parts = vectors.select("x").mapInArrow(_sums_of(width, centre, pairs), "k int, part int, value long")
    total = [0] * ((width * (width + 1) // 2) if pairs else width)
    for k, part, value in parts.groupBy("k", "part").agg(F.sum(F.col("value").cast("decimal(38,0)"))).collect():
        total[k] += int(value) << (31 * part)
    return total


class Fit(NamedTuple):
    n: int
    centre: list[int]  # integer next to the mean
    rest: list[int]  # n * (mean - centre)
    scaled: list[list[int]]  # n^2 times the covariance, exact
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column each
    trace: float

    def covariance(self) -> np.ndarray:
        return np.array([[float(Fraction(v, self.n * self.n)) for v in row] for row in self.scaled]).reshape(len(self.centre), len(self.centre))


def fit(vectors: DataFrame) -> Fit | None:
    """The fit over ``vectors`` (x, distinct); None without vectors or dimensions."""
    first = vectors.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    n, width = first["n"], first["width"] or 0
    if not n or not width:
        return None
    if width > MOST:
        raise ValueError(f"vectors of {width} dimensions; at most {MOST}")
    sums = exact_sums(vectors, width, [0] * width, False)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    squares = exact_sums(vectors, width, centre, True)
    one, scaled, k = [0] * width, [[0] * width for _ in range(width)], 0
    both = {}
    for a in range(width):
        one[a] = n * squares[k] - rest[a] ** 2
        for b in range(a + 1, width):
            both[a, b] = n * squares[k + b - a] - (rest[a] + rest[b]) ** 2
        k += width - a
    for a in range(width):
        scaled[a][a] = one[a]
        for b in range(a + 1, width):
            scaled[a][b] = scaled[b][a] = (both[a, b] - one[a] - one[b]) // 2  # always even
    out = Fit(n, centre, rest, scaled, np.zeros(0), np.zeros((0, 0)), float(Fraction(sum(one), n * n)))
    values, columns = np.linalg.eigh(out.covariance())
    return out._replace(values=values[::-1], vectors=columns[:, ::-1])


def directions(found: Fit, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns that project and scale, the offset of the mean, and which components have a scale."""
    m = min(components, len(found.centre))
    e = found.values[:m]
    sound = e > len(found.centre) * np.finfo(float).eps * max(found.values[0], 0.0)
    w = np.where(sound, found.vectors[:, :m] / np.sqrt(np.where(sound, e, 1.0)), np.nan)
    mean = np.array([float(Fraction(r, found.n)) for r in found.rest])
    return w, np.where(sound, mean @ np.where(sound, w, 0.0), np.nan), sound


def deviations(y: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """Per row the sum of (n * x - S)^2, exact."""
    limit = n * int(np.abs(y).max(initial=0)) + max(map(abs, rest), default=0)
    if limit and limit * limit * y.shape[1] < 1 << 63:
        z = y * n - np.array(rest, np.int64)
        return np.einsum("ij,ij->i", z, z).tolist()
    z = y.astype(object) * n - np.array([*rest, None], object)[:-1]
    return [v if v < 1 << 63 else None for v in ((z**2).sum(axis=1).tolist() if len(y) else [])]


def identity_error(vectors: DataFrame, found: Fit, components: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    w, offset, sound = directions(found, components)
    w, offset, width = w[:, sound], offset[sound], len(found.centre)
    m, c = w.shape[1], np.array(found.centre, np.int64)
    if not m:
        return 0.0

    def run(batches):
        first, second = np.zeros(m), np.zeros((m, m))
        for batch in batches:
            v = (matrix(batch.column(0), width) - c).astype(float) @ w - offset
            first += v.sum(axis=0)
            second += v.T @ v
        values = np.concatenate((first, second.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["k", "value"])

    total = np.zeros(m + m * m)
    for k, value in vectors.select("x").mapInArrow(run, "k int, value double").groupBy("k").agg(F.sum("value")).collect():
        total[k] = value
    mean, second = total[:m] / found.n, total[m:].reshape(m, m) / found.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(m)).max())


def images(embeddings: DataFrame) -> DataFrame:
    """vec_id and x, the whole-number images, of the vectors that take part."""
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: F.coalesce((F.abs(v.cast("double")) < 2.0**63 / SCALE - SHIFT), F.lit(False)) & ~F.isnan(v))
    x = F.transform("embedding", lambda v: (F.floor(v.cast("double") * SCALE) + SHIFT).cast("bigint"))
    return embeddings.where(sound).select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"))


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """The result of the contract for ``rows`` (vec_id, x)."""
    ship(rows.sparkSession)
    rows = saved(rows, "images")
    vectors = saved(rows.select("x").distinct(), "vectors")
    found = fit(vectors)
    if found is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    error = identity_error(vectors, found, components)
    w, offset, _ = directions(found, components)
    m, width, n, rest, c = w.shape[1], len(found.centre), found.n, found.rest, np.array(found.centre, np.int64)
    explained = [float(e / found.trace) if found.trace > 0 else None for e in found.values[:m]]

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                y = matrix(part.column(1), width) - c
                v, k = (y.astype(float) @ w - offset).ravel(), len(y)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(k), m))), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)), pa.array(np.full(k * m, n, np.int64)),
                        pa.array(deviations(y, n, rest), pa.int64()).take(pa.array(np.repeat(np.arange(k), m))), pa.array(v, mask=np.isnan(v)), pa.array(explained * k, pa.float64()), pa.array(np.full(k * m, error)),
                    ],
                    names=[x.split()[0] for x in RESULT.split(", ")],
                )

    return rows.mapInArrow(run, RESULT)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(images(table(spark, sf_dir, "embeddings")))


def covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b (dimensions from 1, a <= b), n and covariance of the fit list of op13."""
    ship(spark)
    found = fit(saved(images(table(spark, sf_dir, "embeddings")).select("x").distinct(), "vectors"))
    v = found.covariance() if found else np.zeros((0, 0))
    rows = [(a + 1, b + 1, found.n, round(float(v[a, b]), 9)) for a in range(len(v)) for b in range(a, len(v))]
    return spark.createDataFrame(rows, "a int, b int, n long, covariance double")


COVARIANCES_SQL = """
WITH x AS (SELECT DISTINCT list_transform(embedding, lambda v: CAST(floor(64 * CAST(v AS DOUBLE)) AS BIGINT) + 1000000) AS x FROM embeddings),
n AS (SELECT count(*) AS n FROM x), r AS (SELECT row_number() OVER () AS r, x FROM x),
l AS (SELECT r, unnest(range(1, len(x) + 1)) AS d, unnest(x) AS v FROM r), s AS (SELECT d, sum(v) AS s FROM l GROUP BY d),
z AS (SELECT r, d, CAST(n AS HUGEINT) * v - s AS z FROM l JOIN s USING (d), n)
SELECT CAST(p.d AS INT) AS a, CAST(q.d AS INT) AS b, CAST(n AS BIGINT) AS n, round(CAST(sum(p.z * q.z) AS DOUBLE) / (CAST(n AS DOUBLE) * n * n), 9) AS covariance FROM z p JOIN z q ON p.r = q.r AND p.d <= q.d, n GROUP BY p.d, q.d, n
"""
