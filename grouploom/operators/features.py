"""Feature tables: contract, profile, sink and reader, correlation and importance roll-ups."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import quantiles
from .quality import found, index_violations, require_clean, violations
from .splits import SPLITS

METADATA = ("sample_id", "patient_id", "label", "split")
NAME = r"^[a-z][a-z0-9]*(_[a-z0-9]+)*$"


def feature_names(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in METADATA]


def contract_violations(rows: DataFrame, labels: list[int]) -> DataFrame:
    """Bad names and types (from the schema), non-finite values (one pass) and the index rules."""
    spark = rows.sparkSession
    names = feature_names(rows)
    schema = [("bad_name", c, "") for c in names if not re.match(NAME, c)]
    schema += [("duplicate_name", c, "") for c in sorted({c for c in rows.columns if rows.columns.count(c) > 1})]
    schema += [("not_numeric", f.name, f.dataType.simpleString()) for f in rows.schema.fields if f.name in names and not isinstance(f.dataType, T.NumericType)]
    numeric = [f.name for f in rows.schema.fields if f.name in names and isinstance(f.dataType, T.NumericType)]
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    counts = rows.agg(*[F.count_if(bad(c)).alias(c) for c in numeric])
    pairs = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in numeric])).alias("p")).select("p.*")
    return violations(
        spark.createDataFrame(schema, "rule string, key string, detail string"), found(pairs, "not_finite", F.col("name"), F.col("n"), F.col("n") > 0),
        index_violations(rows.select(*METADATA), labels, list(SPLITS)),
    )


def write_feature_table(rows: DataFrame, path: str, labels: list[int]) -> None:
    """Checked, metadata columns first, as Parquet partitioned by split."""
    require_clean(contract_violations(rows, labels))
    rows.select(*METADATA, *feature_names(rows)).write.partitionBy("split").parquet(path)


def read_feature_table(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select(*METADATA, *feature_names(rows))


def melted(rows: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, feature, x: one row per value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in names]))
    return rows.select(*keep, pairs.alias("p")).select(*keep, "p.*")


def profile(rows: DataFrame) -> DataFrame:
    """split, rows, features, non_finite."""
    names = feature_names(rows)
    bad = sum((F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 1).otherwise(0) for c in names), F.lit(0))
    return rows.groupBy("split").agg(F.count("*").alias("rows"), F.lit(len(names)).alias("features"), F.sum(bad).alias("non_finite"))


def metadata_record(rows: DataFrame, name: str, version: str) -> DataFrame:
    names = sorted(feature_names(rows))
    count = lambda s: F.count_if(F.col("split") == s).alias(f"n_{s}")
    return rows.agg(F.count("*").alias("n_samples"), F.count_distinct("patient_id").alias("n_groups"), *[count(s) for s in SPLITS]).select(
        F.lit(name).alias("name"), F.lit(version).alias("version"), "*", F.lit(len(names)).alias("n_features"), F.lit(",".join(names)).alias("features")
    )


def class_distribution(rows: DataFrame, names: list[str]) -> DataFrame:
    """feature, label, quartiles and whisker ends (1.5 interquartile ranges, within the data)."""
    long = melted(rows, names, ("label",))
    q = quantiles(long, ["feature", "label"], "x", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = long.join(q, ["feature", "label"]).where((F.col("x") >= F.col("q1") - reach) & (F.col("x") <= F.col("q3") + reach))
    ends = inside.groupBy("feature", "label").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    return q.join(ends, ["feature", "label"])


_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def correlations(rows: DataFrame, names: list[str]) -> DataFrame:
    """a, b, r of all pairs a before b of columns, over the rows where both have values; null where one of
    them is constant. A task adds up matrix products of blocks of rows, and gives a row of sums per column."""
    width = len(names)
    rows = rows.select(F.array(*[F.col(c).cast("double") for c in names]).alias("x"))
    # any value near the data will do as a centre; sums of centred values lose nothing to an offset
    first = rows.limit(1000).select(F.posexplode("x")).where("col IS NOT NULL AND NOT isnan(col)").groupBy("pos").agg(F.avg("col").alias("c"))
    centre = np.zeros(width)
    for k, c in first.collect():
        centre[k] = c

    def sums(batches):
        total = {c: np.zeros((width, width)) for c in _SUMS}
        for batch in batches:
            if not batch.num_rows:
                continue
            z = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) - centre
            m = (~np.isnan(z)).astype(float)
            z = np.where(m > 0, z, 0.0)
            for c, (a, b) in {"n": (m, m), "sx": (z, m), "sy": (m, z), "sxx": (z * z, m), "syy": (m, z * z), "sxy": (z, z)}.items():
                total[c] += a.T @ b
        for k in range(width - 1):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *[pa.array([total[c][k, k + 1 :].tolist()]) for c in _SUMS]], names=["k", *_SUMS])

    def added(table: pa.Table) -> pa.Table:
        k = table["k"][0].as_py()
        n, sx, sy, sxx, syy, sxy = (np.sum([np.array(v) for v in table[c].to_pylist()], axis=0) for c in _SUMS)
        spread = (n * sxx - sx * sx) * (n * syy - sy * sy)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where(spread > 0, (n * sxy - sx * sy) / np.sqrt(np.maximum(spread, 0)), np.nan)
        return pa.table({"a": [names[k]] * len(r), "b": names[k + 1 :], "r": pa.array(r, pa.float64(), from_pandas=True)})

    parts = rows.mapInArrow(sums, "k int, " + ", ".join(f"{c} array<double>" for c in _SUMS))
    return parts.groupBy("k").applyInArrow(added, "a string, b string, r double")


def family_correlation(pairs: DataFrame, pattern: str) -> DataFrame:
    """Mean absolute correlation within each family that ``pattern`` extracts from both names."""
    fam = lambda c: F.regexp_extract(c, pattern, 1)
    return pairs.where(fam("a") == fam("b")).groupBy(fam("a").alias("family")).agg(F.avg(F.abs("r")).alias("mean_abs_r"), F.count("*").alias("n_pairs"))


def importance_by(rows: DataFrame, pattern: str, name: str) -> DataFrame:
    key = F.regexp_extract("feature", pattern, 1)
    return rows.select(key.alias(name), "importance").where(F.col(name) != "").groupBy(name).agg(F.sum("importance").alias("total"), F.avg("importance").alias("mean"))
