"""Violation tables, audits and profiles of sample tables.

Checks give rows (rule, key, detail) instead of failing; ``require_clean`` is the strict mode.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import quantiles


def violations(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def found(rows: DataFrame, rule: str, key: Column, detail: Column, where: Column) -> DataFrame:
    return rows.where(where).select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def require_clean(table: DataFrame) -> None:
    bad = table.limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['rule']}: {r['key']} ({r['detail']})" for r in bad))


def first_failure(checks: dict[str, Column]) -> Column:
    """Message of the first check that fails; null if all hold."""
    out = F.lit(None).cast("string")
    for message, bad in reversed(checks.items()):
        out = F.when(F.coalesce(bad, F.lit(True)), F.lit(message)).otherwise(out)
    return out


def raster_checks(image: Column, mask: Column, height: Column, width: Column) -> dict[str, Column]:
    """Of a row-major raster and its mask, in the order in which they are reported."""
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return {
        "image_size": F.size(image) != height * width, "mask_size": F.size(mask) != height * width, "not_finite": F.exists(image, odd),
        "mask_not_binary": ~F.forall(mask, lambda x: x.isin(0, 1)), "empty_mask": ~F.exists(mask, lambda x: x == 1),
    }


def quarantine(rows: DataFrame) -> DataFrame:
    """``rows`` with validation_status and validation_message; nothing is dropped."""
    message = first_failure({"blank_group": F.trim("patient_id") == "", "label_domain": ~F.col("label").isin(1, 2, 3), **raster_checks(F.col("image_raw"), F.col("tumor_mask"), F.col("height"), F.col("width"))})
    return rows.withColumn("validation_message", message).withColumn("validation_status", F.when(F.col("validation_message").isNull(), "valid").otherwise("invalid"))


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def index_violations(rows: DataFrame, labels: list[int], splits: list[str]) -> DataFrame:
    """Of a split index: ids twice, blank groups, labels and splits outside their domain, groups in
    several splits or with several labels."""
    groups = rows.groupBy("patient_id").agg(F.count_distinct("split").alias("splits"), F.count_distinct("label").alias("labels"))
    return violations(
        found(repeated(rows, ["sample_id"]), "duplicate_id", F.col("sample_id"), F.col("n"), F.lit(True)),
        found(rows, "blank_group", F.col("sample_id"), F.lit(""), F.coalesce(F.trim("patient_id") == "", F.lit(True))),
        found(rows, "label_domain", F.col("sample_id"), F.col("label"), ~F.coalesce(F.col("label").isin(labels), F.lit(False))),
        found(rows, "split_domain", F.col("sample_id"), F.col("split"), ~F.coalesce(F.col("split").isin(splits), F.lit(False))),
        found(groups, "group_in_several_splits", F.col("patient_id"), F.col("splits"), F.col("splits") > 1),
        found(groups, "group_with_several_labels", F.col("patient_id"), F.col("labels"), F.col("labels") > 1),
    )


def manifest_violations(rows: DataFrame, labels: list[int]) -> DataFrame:
    """Of a manifest with ids as text: ids that aren't positive integers or come twice, blank
    groups, labels outside the domain, groups with several labels."""
    number = F.col("sample_id").try_cast("bigint")
    groups = rows.groupBy("patient_id").agg(F.count_distinct("label").alias("labels"))
    return violations(
        found(rows, "id_not_positive_integer", F.col("sample_id"), F.lit(""), F.coalesce(number <= 0, F.lit(True))),
        found(repeated(rows, ["sample_id"]), "duplicate_id", F.col("sample_id"), F.col("n"), F.lit(True)),
        found(rows, "blank_group", F.col("sample_id"), F.lit(""), F.coalesce(F.trim("patient_id") == "", F.lit(True))),
        found(rows, "label_domain", F.col("sample_id"), F.col("label"), ~F.coalesce(F.col("label").isin(labels), F.lit(False))),
        found(groups, "group_with_several_labels", F.col("patient_id"), F.col("labels"), F.col("labels") > 1),
    )


def probability_violations(rows: DataFrame, classes: int, tolerance: float = 1e-5) -> DataFrame:
    """Rows of a prediction table that break a rule, with the first rule that they break."""
    p = F.col("p")
    odd = F.exists(p, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    rule = F.when(F.size(p) != classes, "class_count").when(odd, "not_finite").when(F.array_min(p) < 0, "negative").when(F.abs(total - 1) > tolerance, "row_sum")
    rule = rule.when(~F.coalesce(F.col("true_idx").between(0, classes - 1), F.lit(False)), "label")
    return rows.withColumn("rule", rule).where("rule IS NOT NULL")


def missing_combinations(rows: DataFrame, splits: list[str], labels: list[int]) -> DataFrame:
    """(split, label) pairs, of all expected ones, that no row has."""
    spark = rows.sparkSession
    expected = spark.createDataFrame([(s, x) for s in splits for x in labels], "split string, label int")
    return expected.join(rows.select("split", "label").distinct(), ["split", "label"], "left_anti")


def percentile_profile(rows: DataFrame, value: str, keys: list[str], places=(0.0, 0.05, 0.5, 0.95, 1.0)) -> DataFrame:
    names = ("least", "p5", "median", "p95", "most")
    return quantiles(rows, keys, value, dict(zip(names, places, strict=True)))


def pixel_moments(rows: DataFrame) -> DataFrame:
    """Global moments of all pixels from one row of partial sums per sample."""
    x = F.col("image_raw")
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    squares = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    parts = rows.select(F.array_min(x).alias("least"), F.array_max(x).alias("most"), total.alias("s"), squares.alias("q"), F.size(x).alias("n"))
    mean = F.sum("s") / F.sum("n")
    std = F.sqrt(F.greatest(F.lit(0.0), F.sum("q") / F.sum("n") - mean * mean))
    return parts.agg(F.min("least").alias("least"), F.max("most").alias("most"), mean.alias("mean"), std.alias("std"), F.sum("n").alias("n"), F.min(F.col("s") / F.col("n")).alias("least_mean"), F.max(F.col("s") / F.col("n")).alias("most_mean"))


def column_summary(rows: DataFrame, names: list[str]) -> DataFrame:
    """Per column: count, nulls, mean, sample deviation, least, quartiles, most."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in names]))
    long = rows.select(pairs.alias("f")).select("f.*")
    out = long.groupBy("feature").agg(F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("nulls"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    five = quantiles(long, ["feature"], "x", {"least": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "most": 1.0}).drop("n")
    return out.join(five, "feature", "left").select("feature", "n", "nulls", "mean", "std", "least", "q1", "median", "q3", "most")


def check_summary(checks: list[tuple[str, DataFrame, Column, str]]) -> DataFrame:
    """One row per named check: rows, failed rows, pass flag, first five offending keys."""
    parts = []
    for name, rows, bad, key in checks:
        failed = F.coalesce(bad, F.lit(True))
        offenders = F.sort_array(F.collect_list("key"))
        marked = rows.select(failed.alias("failed"), F.col(key).cast("bigint").alias("key"))
        counts = marked.agg(F.count("*").alias("n_checked"), F.count_if("failed").alias("n_failed"))
        first = marked.where("failed").select("key").orderBy("key").limit(5).agg(offenders.alias("offenders"))
        parts.append(counts.crossJoin(first).select(F.lit(name).alias("check"), (F.col("n_failed") == 0).alias("passed"), "n_checked", "n_failed", F.array_join(F.col("offenders").cast("array<string>"), ",").alias("offenders")))
    return violations(*parts)
