"""Places in a total order, without a task that sees all rows.

Rows are dealt over tasks by ranges of the order. A row's place is its place within its range plus
the rows of the ranges before; only one count per range reaches the driver. Running sums work in
the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch_path


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """``df`` written in the shared folder and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``__part``, a number that rises with the order; parts are written once.

    Rows that agree in ``order`` lie in one part, so a key that many rows share needs further
    columns that tell them apart."""
    return stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")


def with_earlier(parts: DataFrame, keys: list[str], earlier: dict[str, Column], last: Column | None = None) -> DataFrame:
    """``parts`` with, for each name in ``earlier``, the sum over the key's earlier parts, and the
    ``last`` aggregate of the part before. A key has at most as many parts as there are tasks, so
    windows over parts are small."""
    totals = parts.groupBy(*keys, "__part").agg(*[c.alias(n) for n, c in earlier.items()], (F.lit(None) if last is None else last).alias("__last"))
    by_part = Window.partitionBy(*keys).orderBy("__part")
    sums = [F.coalesce(F.sum(n).over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(n) for n in earlier]
    before = totals.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__p"), *sums, F.lag("__last").over(by_part).alias("__before"))
    same = F.col("__part") == F.col("__p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return parts.join(before, same).drop("__p", *[f"__{k}" for k in keys])


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with its place ``name`` (from 1) in the order."""
    parts = ranged(df, *order)
    starts, rows = [], 0
    for part, n in sorted(parts.groupBy("__part").count().collect()):
        starts.append((part, rows))
        rows += n
    table = df.sparkSession.createDataFrame(starts, "__part int, __start long")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.join(F.broadcast(table), "__part").withColumn(name, F.col("__start") + place).drop("__part", "__start")


def value_ranks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, low, high, n: the places (from 0) that a value fills among its key's n values
    in order. Equal values collapse before the shuffle; nulls are left out."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__count"))
    parts = with_earlier(ranged(counts, *keys, value), keys, {"__rows": F.sum("__count")})
    within = Window.partitionBy(*keys, "__part").orderBy(value)
    last = F.col("__rows") + F.sum("__count").over(within) - 1
    totals = parts.groupBy(*keys).agg(F.sum("__count").alias("n"))
    placed = parts.select(*keys, value, (last - F.col("__count") + 1).alias("low"), last.alias("high"))
    return placed.join(totals, keys) if keys else placed.crossJoin(F.broadcast(totals))


#: Values of a key that one buffer may hold; keys with more go through histograms.
BUFFERED = 100_000
_DIGITS = 4


def image(value: Column) -> Column:
    """A long that orders as the double does (zeros agree, NaN comes last)."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(F.bitwise_not(bits.bitwiseAND(F.lit(2**63 - 1))))


def from_image(value: Column) -> Column:
    bits = F.when(value >= 0, value).otherwise(F.bitwise_not(value).bitwiseOR(F.lit(-(2**63))))
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def selected(rows: DataFrame, keys: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """keys, rank, x: the value at each ``rank`` (from 0) that ``wanted`` (keys, rank) asks of a key.

    Radix selection: four passes count 16 bits each of the values' images. A pass counts, for every
    prefix that holds a wanted rank, the digits that follow; so a key's histogram has 65,536 rows at
    the most, only counts are shuffled, and nothing is sorted but a histogram."""
    base = rows.select(*keys, image(F.col(value)).alias("__image"))
    at = wanted.select(*keys, "rank", F.col("rank").alias("__rest"), F.lit(0).cast("bigint").alias("__prefix"))
    for k in range(_DIGITS):
        shift = 48 - 16 * k
        digit = F.shiftright("__image", shift).bitwiseAND(F.lit(0xFFFF)) if k else F.shiftright("__image", shift) + 0x8000
        prefix = F.shiftright("__image", shift + 16) if k else F.lit(0).cast("bigint")
        own = base.select(*keys, prefix.alias("__prefix"), digit.cast("bigint").alias("__digit"))
        counts = own.join(at.select(*keys, "__prefix").distinct(), [*keys, "__prefix"], "left_semi").groupBy(*keys, "__prefix", "__digit").agg(F.count("*").alias("__c"))
        up_to = F.sum("__c").over(Window.partitionBy(*keys, "__prefix").orderBy("__digit"))
        found = counts.withColumn("__to", up_to).join(at, [*keys, "__prefix"]).where((F.col("__rest") < F.col("__to")) & (F.col("__rest") >= F.col("__to") - F.col("__c")))
        longer = F.shiftleft("__prefix", 16) + F.col("__digit") if k else F.col("__digit") - 0x8000
        at = stored(found.select(*keys, "rank", (F.col("__rest") - F.col("__to") + F.col("__c")).alias("__rest"), longer.alias("__prefix")), "selected")
    return at.select(*keys, "rank", from_image(F.col("__prefix")).alias("x"))


def quantiles(rows: DataFrame, keys: list[str], value: str, places: dict[str, float]) -> DataFrame:
    """keys, n, and exact quantiles, linear between neighbours; nulls are left out. Keys with few
    values are sorted in a buffer; where any has more than ``BUFFERED``, radix selection finds the
    neighbours of all, so no task holds or sorts a key's values."""
    rows = rows.where(F.col(value).isNotNull())
    if (rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= BUFFERED:
        q = F.percentile(F.col(value).cast("double"), F.array(*[F.lit(float(p)) for p in places.values()]))
        found = rows.groupBy(*keys).agg(F.count("*").alias("n"), q.alias("__q"))
        return found.where("n > 0").select(*keys, "n", *[F.element_at("__q", k + 1).alias(c) for k, c in enumerate(places)])
    sizes = stored(rows.groupBy(*keys).agg(F.count("*").alias("n")), "sizes")
    at = {c: F.lit(float(p)) * (F.col("n") - 1) for c, p in places.items()}
    ranks = F.explode(F.array_distinct(F.flatten(F.array(*[F.array(F.floor(a), F.ceil(a)) for a in at.values()]))))
    found = sizes.select(*keys, "n", ranks.alias("rank"))
    values = selected(rows, keys, value, found.select(*keys, "rank")).join(found, [*keys, "rank"])
    columns = []
    for c, a in at.items():
        take = lambda k: F.max(F.when(F.col("rank") == k, F.col("x")))
        below, above = take(F.floor(a)), take(F.ceil(a))
        columns.append((below + (above - below) * F.max(a - F.floor(a))).alias(c))
    return values.groupBy(*keys).agg(F.max("n").alias("n"), *columns)
