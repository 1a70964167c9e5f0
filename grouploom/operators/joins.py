"""Checked joins, set comparison and snapshot diffs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checked_left_join(left: DataFrame, right: DataFrame, on: str, value: str) -> tuple[DataFrame, DataFrame]:
    """A many-to-one left join, and the violations of it: keys that come twice on the right, keys
    that the right side lacks. With repeated keys the join takes the least value of each."""
    keys = right.groupBy(on).agg(F.min(value).alias(value), F.count("*").alias("n"))
    joined = left.join(keys.select(on, value), on, "left")
    twice = keys.where("n > 1").select(F.lit("right_key_twice").alias("rule"), F.col(on).cast("string").alias("key"))
    missing = joined.where(F.col(value).isNull()).select(F.lit("no_match").alias("rule"), F.col(on).cast("string").alias("key")).distinct()
    return joined, twice.unionByName(missing)


def merged_tables(tables: list[DataFrame], on: str, metadata: list[str]) -> tuple[DataFrame, DataFrame]:
    """A 1:1 merge of feature tables over ids common to all, and its violations: ids that some
    table lacks, metadata that disagree. A feature name in two tables is an error at once."""
    names = [c for t in tables for c in t.columns if c not in (on, *metadata)]
    if len(names) != len(set(names)):
        raise ValueError("a feature name occurs in more than one table")
    first = tables[0]
    parts = []
    merged = first
    for k, t in enumerate(tables[1:], 1):
        for a, b, side in ((first, t, k), (t, first, 0)):
            parts.append(a.join(b.select(on), on, "left_anti").select(F.lit(f"missing_in_{side}").alias("rule"), F.col(on).cast("string").alias("key")))
        renamed = t.select(on, *[F.col(c).alias(f"__{c}") for c in metadata], *[c for c in t.columns if c not in (on, *metadata)])
        merged = merged.join(renamed, on)
        differs = reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in metadata])
        parts.append(merged.where(differs).select(F.lit("metadata_differs").alias("rule"), F.col(on).cast("string").alias("key")))
        merged = merged.drop(*[f"__{c}" for c in metadata])
    return merged, reduce(DataFrame.unionByName, parts)


def conformance(rows: DataFrame, canonical: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Per canonical id that is missing or differs: which columns differ."""
    renamed = rows.select(on, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__there"))
    joined = canonical.join(renamed, on, "left")
    there = F.col("__there").isNotNull()
    differing = F.array_compact(F.array(*[F.when(there & ~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in columns]))
    return joined.select(on, (~there).alias("missing"), F.array_join(differing, ",").alias("differs")).where("missing OR differs <> ''")


def id_set_difference(left: DataFrame, right: DataFrame, on: str, examples: int = 5) -> DataFrame:
    """Number and least examples of ids that only one side has. Examples are cut before they are
    gathered."""
    parts = []
    for side, a, b in (("missing", left, right), ("extra", right, left)):
        only = a.select(on).distinct().join(b.select(on), on, "left_anti")
        few = only.orderBy(on).limit(examples).agg(F.array_join(F.sort_array(F.collect_list(on)).cast("array<string>"), ",").alias("examples"))
        parts.append(only.agg(F.count("*").alias("n")).crossJoin(few).select(F.lit(side).alias("side"), "n", "examples"))
    return parts[0].unionByName(parts[1])


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, change: added, removed or changed."""
    both = old.select(key, F.col(value).alias("a"), F.lit(True).alias("in_old")).join(new.select(key, F.col(value).alias("b"), F.lit(True).alias("in_new")), key, "full")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def verified(manifest: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """Manifest rows whose file is gone or has another hash."""
    joined = manifest.select(key, digest).join(current.select(key, F.col(digest).alias("now")), key, "left")
    problem = F.when(F.col("now").isNull(), "file_missing").when(F.col("now") != F.col(digest), "content_sha256_mismatch")
    return joined.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def conversion_status(source: DataFrame, existing: DataFrame, key: str, valid: Column, failed: Column, overwrite: bool) -> DataFrame:
    """key, status of an incremental run: what is there and valid is skipped unless overwritten."""
    joined = source.join(existing, key, "left")
    there = F.col("output").isNotNull()
    redo = F.lit(overwrite)
    status = F.when(failed, "failed").when(~there, "converted").when(redo, "overwritten").when(valid, "skipped_existing").otherwise("regenerated")
    return joined.select(key, status.alias("status"))


def config_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """name, left, right of leaves (name, value) that differ."""
    both = a.select("name", F.col("value").alias("left_value")).join(b.select("name", F.col("value").alias("right_value")), "name", "full")
    return both.where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def first_per_key(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row of each key of a log."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])
