"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_to_index(label: Column, labels: list[int]) -> Column:
    """Place of a label in the class list; null outside the domain."""
    found = F.array_position(F.array(*[F.lit(x) for x in labels]), label)
    return F.when(found > 0, (found - 1).cast("int"))


def label_to_name(label: Column, names: dict[int, str]) -> Column:
    return F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])[label]


def normalized_id(text: Column) -> Column:
    """A positive integer from integer-like text (also '7.0'); null otherwise."""
    value = F.when(F.trim(text).rlike(r"^[0-9]+(\.0+)?$"), F.regexp_replace(F.trim(text), r"\.0+$", "").try_cast("bigint"))
    return F.when(value > 0, value)


def parsed_feature(name: Column) -> dict[str, Column]:
    """Family, property, distance, angle and a readable name of a feature column's name."""
    number = lambda pattern: F.regexp_extract(name, pattern, 1).try_cast("int")
    family = F.substring_index(name, "_", 1)
    return {
        "family": family, "property": F.nullif(F.regexp_extract(name, r"^[a-z]+_([a-z]+)_d", 1), F.lit("")), "distance": number(r"_d([0-9]+)_a"), "angle": number(r"_a([0-9]+)$"),
        "readable": F.initcap(F.replace(name, F.lit("_"), F.lit(" "))),
    }


def run_key(model: Column, lr: Column, seed: Column) -> Column:
    return F.concat(model, F.lit("_lr"), F.format_string("%.0e", lr), F.lit("_seed"), seed.cast("string"))


def text_from_codes(codes: Column) -> Column:
    """Text of character codes (Unicode; what is none becomes U+FFFD); zero codes are dropped, ends trimmed."""
    valid = lambda c: F.when(c.between(1, 0xD7FF) | c.between(0xE000, 0x10FFFF), c).otherwise(0xFFFD)
    units = F.transform(F.filter(codes, lambda c: c != 0), lambda c: F.lpad(F.hex(valid(c).cast("bigint")), 8, "0"))
    # the mark in front says the byte order, so that a mark in the text stays
    return F.trim(F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.array_join(units, ""))), "UTF-32"))


def size_bucket(size: Column, low: float, high: float) -> Column:
    return F.when(size <= low, "small").when(size <= high, "medium").otherwise("large")


def row_percent(cells: DataFrame, row: list[str]) -> DataFrame:
    """Counts as a percentage of their row; 0 where the row is empty."""
    total = F.sum("n").over(Window.partitionBy(*row))
    return cells.withColumn("percent", F.coalesce(F.try_divide(F.col("n") * 100.0, total), F.lit(0.0)))


def border_points(border: Column) -> Column:
    """Number of points of a flat coordinate list."""
    return F.floor(F.size(border) / 2).cast("int")


def border_warnings(border: Column) -> Column:
    """'; '-joined warnings: empty, non_finite, odd_count; empty text if sound."""
    odd = F.exists(border, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.concat_ws("; ", F.when(F.size(border) == 0, "empty"), F.when(odd, "non_finite"), F.when(F.size(border) % 2 == 1, "odd_count"))
