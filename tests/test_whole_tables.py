"""Queries over all their rows, columns and characters, against Python."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from grouploom.functions import scalars as S
from grouploom.plans import evaluation, registry
from grouploom.plans.fixtures import CO_NAMES, Views

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_bad_rows_of_every_run_are_found(spark):
    planted = {("x", 0, -1, "row_sum"), ("x", 0, -2, "not_finite"), ("x", 0, -3, "label"), ("x", 0, -4, "negative")}
    assert {tuple(r) for r in registry.queries()["v08_probability_rows"](spark, SF).collect()} == planted
    views = Views(spark, SF)
    bad = (F.col("model") == "b") & (F.col("seed") == 43) & (F.col("sample_id") == 7)
    views.__dict__["predictions"] = views.predictions.withColumn("p", F.when(bad, F.array(*[F.lit(0.5)] * 3)).otherwise(F.col("p")))
    assert {tuple(r) for r in evaluation.v08(views).collect()} == planted | {("b", 43, 7, "row_sum")}


def test_imputation_and_scaling_of_all_features(spark):
    rows = Views(spark, SF).features_a.toPandas()
    medians = {r.feature: r.median for r in registry.queries()["m02_imputation"](spark, SF).collect()}
    scaled = {(r.split, r.feature): (r.mean, r.std) for r in registry.queries()["m03_scaling"](spark, SF).collect()}
    train = (rows.split == "train").to_numpy()
    assert set(medians) == set(CO_NAMES) and len(scaled) == 3 * len(CO_NAMES)
    for k, name in enumerate(CO_NAMES):
        x = np.where(rows.sample_id % (7 + k) == 0, np.nan, rows[name])
        median = np.nanmedian(x[train])
        x = np.where(np.isnan(x), median, x)
        assert medians[name] == pytest.approx(median, abs=1e-6)
        for split in ("train", "val", "test"):
            z = (x[(rows.split == split).to_numpy()] - x[train].mean()) / x[train].std()
            assert scaled[split, name] == pytest.approx((z.mean(), z.std()), abs=2e-6)


def test_whole_texts_from_codes(spark):
    want = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.text for r in registry.queries()["f05_text_from_codes"](spark, SF).collect()}
    assert got == {k: None if t is None else t.replace("\0", "").strip(" ") for k, t in want.items()}
    codes = [[0, 32, 0x20AC, 0x1D11E, 0, 0xE9, 32], [0xFEFF, 65], [], [0xD83D, 66], None]
    df = spark.createDataFrame(list(enumerate(codes)), "k int, codes array<int>").select("k", S.text_from_codes(F.col("codes")).alias("t"))
    assert [r.t for r in df.orderBy("k").collect()] == ["€𝄞é", "﻿A", "", "�B", None]
