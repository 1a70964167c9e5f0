"""Places and shares at which doubles and exact decimals part; digests over many ranges."""

import hashlib
import math
from decimal import ROUND_HALF_EVEN, Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from grouploom.operators import integrity as I
from grouploom.operators import raster as R
from grouploom.operators import splits as P
from grouploom.plans.evaluation import to_digits


@pytest.mark.parametrize("n", [41, 48, 64])
def test_percentile_places_are_exact(spark, n):
    values = [float(k * k) for k in range(n)]
    got = spark.createDataFrame([(values,)], "v array<double>").select(*[R._rank(F.col("v"), p).alias(str(k)) for k, p in enumerate((0.01, 0.99))]).first()
    for found, place in zip(got, ("0.01", "0.99"), strict=True):
        at = (n - 1) * Decimal(place)
        low = int(at)
        assert found == values[low] + (values[min(low + 1, n - 1)] - values[low]) * float(at - low)


@pytest.mark.parametrize("n", [45, 85, 165])
def test_shares_of_groups_round_half_to_even(spark, n):
    split = P.assign_group_splits(spark.createDataFrame([(f"g{k}", 1) for k in range(n)], "patient_id string, label int"), 42)
    train = int((n * Decimal("0.7")).quantize(Decimal(1), ROUND_HALF_EVEN))
    got = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert got == {"train": train, "val": (n - train) // 2, "test": n - train - (n - train) // 2}


@pytest.mark.parametrize("keys", [range(1, 351), range(0, 1000, 7), range(7)])
def test_digest_lists_every_range(spark, keys):
    parts = [hashlib.sha256(",".join(str(k) for k in keys if k // 5 == p).encode()).hexdigest() for p in sorted({k // 5 for k in keys})]
    r = I.listed_digest(spark.createDataFrame([(k,) for k in keys], "k long").repartition(4), "k", 5).first()
    assert (r.digest, r.parts) == (hashlib.sha256(",".join(parts).encode()).hexdigest(), len(parts))


def test_rounding_next_to_ties_is_that_of_sql(spark):
    values = [math.nextafter(0.1246875, 0), 0.1246875, -0.1246875, 0.1246874, 2.0000005, 1e12 / 7, math.inf, None]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double").select("k", to_digits("x").alias("x")).orderBy("k").collect()
    assert [r.x for r in got] == [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6)", [v]).fetchone()[0] for v in values]
