"""Group-aware splits, group-level weights and per-epoch order."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered

SPLITS = ("train", "val", "test")


def seeded_order(seed: int, *columns: str) -> Column:
    """A draw that depends on seed and key only, so any partitioning gives the same order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))


def one_row_per_group(rows: DataFrame, group: str = "patient_id") -> DataFrame:
    return rows.groupBy(group).agg(F.min("label").alias("label"), F.count("*").alias("n_samples"))


def drawn_places(rows: DataFrame, by: str, draw: Column, digits: int = 3) -> DataFrame:
    """``rows`` with place (from 1) in the order of a hex ``draw`` among the rows of the same ``by``, and
    their number n. Draws are uniform, so rows are dealt by their first digits: a task ranks the rows of one
    prefix, and what lies before a prefix is a sum over at most 16 ** digits counts."""
    own = rows.withColumn("__draw", draw).withColumn("__prefix", F.substring("__draw", 1, digits))
    counts = own.groupBy(F.col(by).alias("__by"), F.col("__prefix").alias("__p")).agg(F.count("*").alias("__c"))
    of = Window.partitionBy("__by")
    before = F.coalesce(F.sum("__c").over(of.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__by", "__p", before.alias("__before"), F.sum("__c").over(of).alias("n"))
    joined = own.join(counts, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__prefix") == F.col("__p")))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__by", "__p").orderBy("__draw"))
    return joined.select(*rows.columns, place.alias("place"), "n")


def assign_group_splits(rows: DataFrame, seed: int, group: str = "patient_id", train: float = 0.7) -> DataFrame:
    """(group, label, split): per class, groups in seeded order; a share to train, half the rest,
    rounded down, to val, the others to test. Shares round half to even, as exact decimals: as a double,
    45 * 0.7 is less than 31.5."""
    groups = drawn_places(rows.select(group, "label").distinct(), "label", seeded_order(seed, group))
    n_train = F.bround(F.col("n") * F.lit(Decimal(str(train))), 0).cast("bigint")
    n_val = F.floor((F.col("n") - n_train) / 2)
    split = F.when(F.col("place") <= n_train, "train").when(F.col("place") <= n_train + n_val, "val").otherwise("test")
    return groups.select(group, "label", split.alias("split"))


def first_per_class(rows: DataFrame, k: int, order: Column | str, keep: list[str], by: str = "label") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.select(*keep, place.alias("place")).where(F.col("place") <= k)


def qa_pick(rows: DataFrame, per_class: int = 2) -> DataFrame:
    """Per class the smallest, middle and largest by size; a row keeps its first reason. Places come from
    ranges of (label, size, id), not from a window over a class."""
    placed = numbered(rows.select("sample_id", "label", "size"), "at", F.col("label"), F.col("size"), F.col("sample_id"))
    classes = placed.groupBy(F.col("label").alias("__label")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    ranked = placed.join(classes, F.col("label").eqNullSafe(F.col("__label"))).withColumn("place", F.col("at") - F.col("first") + 1)
    middle = F.floor(F.col("n") / 2) - per_class // 2
    reason = F.when(F.col("place") <= per_class, "smallest").when((F.col("place") > middle) & (F.col("place") <= middle + per_class), "middle").when(F.col("place") > F.col("n") - per_class, "largest")
    return ranked.select("sample_id", "label", "size", reason.alias("reason")).where("reason IS NOT NULL")


def epoch_order(rows: DataFrame, seed: int, epochs: int) -> DataFrame:
    """Every id once per epoch, at a place that depends on (seed, epoch, id)."""
    spread = rows.select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    draw = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("sample_id").cast("string")).cast("binary"), 256)
    return drawn_places(spread, "epoch", draw).select("epoch", "sample_id", F.col("place").cast("int").alias("place"))


def class_weights(rows: DataFrame, classes: int) -> DataFrame:
    """n / (classes * rows of the class)."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.groupBy("label").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("label", "n", (F.col("total") / (classes * F.col("n"))).alias("weight"))


def row_weights(rows: DataFrame, mode: str, classes: int, group: str = "patient_id") -> DataFrame:
    """``rows`` with a weight: none, class_balanced, patient_balanced or both; the mean is 1."""
    by_class = rows.groupBy("label").agg(F.count("*").alias("in_class"))
    by_group = rows.groupBy(group).agg(F.count("*").alias("in_group"))
    total = rows.agg(F.count("*").alias("in_all"))
    joined = rows.join(F.broadcast(by_class), "label").join(by_group, group).crossJoin(F.broadcast(total))
    balanced, single = F.col("in_all") / (classes * F.col("in_class")), F.lit(1.0) / F.col("in_group")
    raw = {"none": F.lit(1.0), "class_balanced": balanced, "patient_balanced": single, "both": balanced * single}[mode]
    joined = joined.withColumn("raw", raw)
    mean = joined.agg(F.avg("raw").alias("mean"))
    return joined.crossJoin(F.broadcast(mean)).select(*rows.columns, (F.col("raw") / F.col("mean")).alias("weight"))
