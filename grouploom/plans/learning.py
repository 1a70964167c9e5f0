"""Queries over feature tables: contract, merging, profiles and the model protocol."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as T
from ..operators import joins as J
from ..operators import learning as L
from ..operators import quality as Q
from .evaluation import rounded
from .fixtures import CO_NAMES, LBP_NAMES
from .registry import query

K = 3


@query("v05_feature_contract", """WITH x AS (SELECT sample_id, patient_id, split, label, glcm_energy_d1_a0 AS "Bad_Name", CASE WHEN sample_id % 9 = 0 THEN CAST('nan' AS DOUBLE) ELSE glcm_contrast_d1_a0 END AS good_name FROM fx_features_a UNION ALL SELECT 7, 'P1_0', 'train', 9, 0.0, 0.0)
SELECT 'bad_name' AS rule, 'Bad_Name' AS key, '' AS detail UNION ALL SELECT 'not_numeric', 'text_name', 'string'
UNION ALL SELECT 'not_finite', 'good_name', CAST(count(*) AS STRING) FROM x WHERE isnan(good_name) UNION ALL SELECT 'duplicate_id', CAST(sample_id AS STRING), CAST(count(*) AS STRING) FROM x GROUP BY sample_id HAVING count(*) > 1
UNION ALL SELECT 'label_domain', CAST(sample_id AS STRING), CAST(label AS STRING) FROM x WHERE label NOT IN (1, 2, 3)
UNION ALL SELECT 'group_in_several_splits', patient_id, CAST(count(DISTINCT split) AS STRING) FROM x GROUP BY 2 HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'group_with_several_labels', patient_id, CAST(count(DISTINCT label) AS STRING) FROM x GROUP BY 2 HAVING count(DISTINCT label) > 1""")
def v05(v):
    a = v.features_a.select("sample_id", "patient_id", "label", "split", F.col("glcm_energy_d1_a0").alias("Bad_Name"), F.when(F.col("sample_id") % 9 == 0, float("nan")).otherwise(F.col("glcm_contrast_d1_a0")).alias("good_name"), F.lit("t").alias("text_name"))
    bad = v.spark.createDataFrame([(7, "P1_0", 9, "train", 0.0, 0.0, "t")], a.schema)
    return T.contract_violations(a.unionByName(bad), [1, 2, 3])


@query("s05_feature_table", "SELECT sample_id, patient_id, label, split, round(glcm_contrast_d1_a0, 6) AS first, round(glcm_energy_d2_a135, 6) AS last FROM fx_features_a")
def s05(v):
    """Written as a checked feature table in the shared folder, and read again."""
    from ..sources.tables import scratch_path

    path = scratch_path(v.spark, "features")
    T.write_feature_table(v.features_a, path, [1, 2, 3])
    back = T.read_feature_table(v.spark, path)
    return rounded(back.select("sample_id", "patient_id", "label", F.col("split").cast("string").alias("split"), F.col("glcm_contrast_d1_a0").alias("first"), F.col("glcm_energy_d2_a135").alias("last")), "first", "last")


@query("s09_feature_metadata", f"SELECT 'glcm' AS name, 'v1' AS version, count(*) AS n_samples, count(DISTINCT patient_id) AS n_groups, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test, CAST(16 AS INT) AS n_features, '{','.join(sorted(CO_NAMES))}' AS features FROM fx_features_a")
def s09(v):
    return T.metadata_record(v.features_a, "glcm", "v1")


MERGE_BAD = "(SELECT * REPLACE (CASE WHEN sample_id % 90 = 0 THEN 'test' ELSE split END AS split) FROM fx_features_b WHERE sample_id % 100 <> 0)"


@query("j02_merge_violations", f"SELECT 'missing_in_1' AS rule, CAST(sample_id AS STRING) AS key FROM fx_features_a a ANTI JOIN {MERGE_BAD} b USING (sample_id) UNION ALL SELECT 'metadata_differs', CAST(a.sample_id AS STRING) FROM fx_features_a a JOIN {MERGE_BAD} b USING (sample_id) WHERE a.split <> b.split")
def j02(v):
    b = v.features_b.where("sample_id % 100 <> 0").withColumn("split", F.when(F.col("sample_id") % 90 == 0, "test").otherwise(F.col("split")))
    return J.merged_tables([v.features_a, b], "sample_id", ["patient_id", "label", "split"])[1]


@query("j02_merged", "SELECT a.sample_id, round(glcm_contrast_d1_a0, 6) AS a, round(lbp_15, 6) AS b FROM fx_features_a a JOIN fx_features_b b USING (sample_id)")
def j02_merged(v):
    merged, _ = J.merged_tables([v.features_a, v.features_b], "sample_id", ["patient_id", "label", "split"])
    return rounded(merged.select("sample_id", F.col("glcm_contrast_d1_a0").alias("a"), F.col("lbp_15").alias("b")), "a", "b")


@query("j03_conformance", f"SELECT c.sample_id, b.sample_id IS NULL AS missing, CASE WHEN b.split <> c.split THEN 'split' ELSE '' END AS differs FROM (SELECT sample_id, patient_id, label, split FROM fx_features_a) c LEFT JOIN {MERGE_BAD} b USING (sample_id) WHERE b.sample_id IS NULL OR b.split <> c.split")
def j03(v):
    b = v.features_b.where("sample_id % 100 <> 0").withColumn("split", F.when(F.col("sample_id") % 90 == 0, "test").otherwise(F.col("split")))
    return J.conformance(b, v.features_a.select(*T.METADATA), "sample_id", ["patient_id", "label", "split"])


@query("a12_feature_profile", "SELECT split, count(*) AS rows, CAST(16 AS INT) AS features, CAST(0 AS BIGINT) AS non_finite FROM fx_features_a GROUP BY split")
def a12(v):
    return T.profile(v.features_a)


LONG_A = f"(SELECT label, unnest([{', '.join(repr(n) for n in CO_NAMES)}]) AS feature, unnest([{', '.join(CO_NAMES)}]) AS x FROM fx_features_a)"
FIVE = ", ".join(f"round(quantile_cont(x, {q}), 6) + 0.0 AS {n}" for q, n in ((0.0, "least"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "most")))


@query("a13_column_summary", f"SELECT feature, count(x) AS n, count(*) - count(x) AS nulls, round(avg(x), 6) + 0.0 AS mean, round(stddev_samp(x), 6) AS std, {FIVE} FROM {LONG_A} GROUP BY 1")
def a13(v):
    return rounded(Q.column_summary(v.features_a, CO_NAMES), "mean", "std", "least", "q1", "median", "q3", "most")


@query("a14_class_distribution", f"WITH q AS (SELECT feature, label, count(x) AS n, quantile_cont(x, 0.25) AS q1, median(x) AS median, quantile_cont(x, 0.75) AS q3 FROM {LONG_A} GROUP BY ALL) SELECT feature, label, n, round(q1, 6) + 0.0 AS q1, round(median, 6) + 0.0 AS median, round(q3, 6) + 0.0 AS q3, round(min(x), 6) + 0.0 AS low, round(max(x), 6) + 0.0 AS high FROM q JOIN {LONG_A} USING (feature, label) WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL")
def a14(v):
    return rounded(T.class_distribution(v.features_a, CO_NAMES), "q1", "median", "q3", "low", "high")


PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM fx_features_a" for k, a in enumerate(CO_NAMES) for b in CO_NAMES[k + 1 :])


@query("a15_correlations", f"SELECT a, b, round(r, 6) + 0.0 AS r FROM ({PAIRS})")
def a15(v):
    return rounded(T.correlations(v.features_a, CO_NAMES), "r")


@query("a15_family_correlation", f"SELECT regexp_extract(a, '_d([0-9]+)_', 1) AS family, round(avg(abs(r)), 6) AS mean_abs_r, count(*) AS n_pairs FROM ({PAIRS}) WHERE regexp_extract(a, '_d([0-9]+)_', 1) = regexp_extract(b, '_d([0-9]+)_', 1) GROUP BY 1")
def a15_family(v):
    return rounded(T.family_correlation(T.correlations(v.features_a, CO_NAMES), "_d([0-9]+)_"), "mean_abs_r")


@query("a16_importance_by_distance", f"SELECT regexp_extract(feature, '_d([0-9]+)_', 1) AS distance, round(sum(i), 6) AS total, round(avg(i), 6) AS mean FROM (SELECT feature, avg(abs(x)) AS i FROM {LONG_A} GROUP BY 1) GROUP BY 1")
def a16(v):
    rows = T.melted(v.features_a, CO_NAMES).groupBy("feature").agg(F.avg(F.abs("x")).alias("importance"))
    return rounded(T.importance_by(rows, "_d([0-9]+)_", "distance"), "total", "mean")


@query("m01_matrices", f"SELECT split, count(*) AS n, round(sum({' + '.join(CO_NAMES)}), 4) AS total FROM fx_features_a GROUP BY split")
def m01(v):
    from pyspark.ml.functions import vector_to_array

    rows = L.matrices(v.features_a, CO_NAMES)
    total = F.aggregate(vector_to_array("x"), F.lit(0.0), lambda a, x: a + x)
    return rows.groupBy("split").agg(F.count("*").alias("n"), (F.round(F.sum(total), 4) + F.lit(0.0)).alias("total"))


HOLES = f"(SELECT sample_id, split, {', '.join(f'CASE WHEN sample_id % {7 + k} = 0 THEN NULL ELSE {n} END AS {n}' for k, n in enumerate(CO_NAMES))} FROM fx_features_a)"
LONG_HOLES = f"(SELECT sample_id, split, unnest([{', '.join(repr(n) for n in CO_NAMES)}]) AS feature, unnest([{', '.join(CO_NAMES)}]) AS x FROM {HOLES})"


def holes(v, names=CO_NAMES):
    return v.features_a.select(*T.METADATA, *[F.when(F.col("sample_id") % (7 + k) == 0, F.lit(None)).otherwise(F.col(n)).alias(n) for k, n in enumerate(names)])


STATS = f"(WITH m AS (SELECT feature, median(x) AS median FROM {LONG_HOLES} WHERE split = 'train' GROUP BY 1) SELECT feature, any_value(median) AS median, avg(coalesce(x, median)) AS mean, stddev_pop(coalesce(x, median)) AS std FROM {LONG_HOLES} JOIN m USING (feature) WHERE split = 'train' GROUP BY 1)"


@query("m02_imputation", f"SELECT feature, round(median, 6) + 0.0 AS median FROM {STATS}")
def m02(v, names=CO_NAMES):
    rows = holes(v, names)
    return rounded(L.preprocessing(rows.where("split = 'train'"), names).select("feature", "median"), "median")


@query("m03_scaling", f"SELECT split, feature, round(avg((coalesce(x, median) - mean) / std), 6) + 0.0 AS mean, round(stddev_pop((coalesce(x, median) - mean) / std), 6) AS std FROM {LONG_HOLES} JOIN {STATS} USING (feature) GROUP BY ALL")
def m03(v, names=CO_NAMES):
    rows = holes(v, names)
    scaled = L.transformed(rows, L.preprocessing(rows.where("split = 'train'"), names), names)
    return rounded(T.melted(scaled, names, ("split",)).groupBy("split", "feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")), "mean", "std")


def _protocol(data, grid, refit=False):
    """Val-selected candidate scored once on test: split, candidate and headline metrics."""
    best, model, _ = L.search(data, grid, K, refit)
    both = L.predictions(model, data.where("split <> 'train'"), K)
    return L.scores(both, ["split"], K).withColumn("candidate", F.lit(best))


@query("m04_logistic")
def m04(v):
    return _protocol(L.prepared(v.features_b)[0], L.logistic_grid())


@query("m05_forest")
def m05(v):
    """The best of 30 class-balanced forests on val, scored on val and test."""
    rows, names = L.plain(v.features_a)
    scored = L.forest_predictions(rows, names, K, **L.FOREST)
    best = L.simplest_best(L.candidate_scores(scored.where("split = 'val'"), K))
    return L.scores(scored.where(F.col("candidate") == best), ["split"], K).withColumn("candidate", F.lit(best))


@query("m06_kernel_svm")
def m06(v):
    """The best of 5 x 6 kernel machines on val, scored on val and test."""
    rows, names = L.standardized(v.features_a)
    best, _, chosen = L.kernel_search(rows, names, K, **L.KERNEL)
    return L.scores(chosen.where("split <> 'train'"), ["split"], K).withColumn("candidate", F.lit(best))


@query("m07_boosted")
def m07(v):
    """The best of eight on val, learnt again on train and val, scored once on test."""
    rows, names = L.plain(v.features_a)
    best = L.simplest_best(L.candidate_scores(L.boosted_search(rows, names, K, **L.BOOSTED)[0], K))
    _, rounds, depth, rate = best.split("|")
    again, _ = L.boosted_search(rows, names, K, [int(rounds)], [int(depth)], [float(rate)], trained="split <> 'test'", wanted="split = 'test'")
    return L.scores(again, ["split"], K).withColumn("candidate", F.lit(best))


@query("m08_weighted_grid")
def m08(v):
    """Val scores of every weighting mode and candidate, 108 of them."""
    rows, names = L.plain(v.features_a)
    scored, _ = L.boosted_search(rows, names, K, **L.WEIGHTED, modes=L.MODES)
    return L.candidate_scores(scored, K).withColumn("mode", F.split("candidate", "[|]")[0])


@query("m10_importance")
def m10(v):
    """Of 100 trees of depth 10."""
    rows, names = L.plain(v.features_a)
    _, forest = L.forest_search(rows, names, K, [100], [10], [L.Kind(2, 1)])
    return L.importances(forest.importances(0, 100, 10, len(names)).tolist(), names, v.spark)


def saved_pipeline(v, name: str) -> str:
    from ..sources.tables import scratch_path

    rows = v.features_a.withColumn("y", (F.col("label") - 1).cast("double"))
    path = scratch_path(v.spark, name)
    L.pipeline(CO_NAMES, L.logistic_grid()["logistic_0.1"]).fit(rows.where("split = 'train'")).save(path)
    return path


@query("m11_batch_scoring")
def m11(v):
    """A saved pipeline, read again and applied to the held-out split."""
    rows = v.features_a.withColumn("y", (F.col("label") - 1).cast("double"))
    scored = L.score_saved(saved_pipeline(v, "model"), rows.where("split = 'test'"), CO_NAMES, K)
    return scored.select("sample_id", "pred_idx", "confidence", "correct")


@query("m12_saved_model", "SELECT split, CAST(0.0 AS DOUBLE) AS max_abs_diff, count(*) AS n FROM fx_features_a GROUP BY split")
def m12_saved(v):
    """A model and its saved copy give the same probabilities."""
    from pyspark.ml import PipelineModel

    from ..operators.compare import reload_difference

    rows = v.features_a.withColumn("y", (F.col("label") - 1).cast("double"))
    model = L.pipeline(CO_NAMES, L.logistic_grid()["logistic_0.1"]).fit(rows.where("split = 'train'"))
    path = saved_pipeline(v, "first")
    model.write().overwrite().save(path)
    a, b = (L.predictions(m, rows, K) for m in (model, PipelineModel.load(path)))
    return rounded(reload_difference(a, b, ["sample_id"], ["split"]), "max_abs_diff")


# importance by what the feature's name says, and by subband and statistic for names of wavelet features
for _what, _pattern in (("property", "^glcm_([a-z]+)_"), ("angle", "_a([0-9]+)$")):

    def _by(v, what=_what, pattern=_pattern):
        rows = T.melted(v.features_a, CO_NAMES).groupBy("feature").agg(F.avg(F.abs("x")).alias("importance"))
        return rounded(T.importance_by(rows, pattern, what), "total", "mean")

    query(f"a16_importance_by_{_what}", f"SELECT regexp_extract(feature, '{_pattern}', 1) AS {_what}, round(sum(i), 6) AS total, round(avg(i), 6) AS mean FROM (SELECT feature, avg(abs(x)) AS i FROM {LONG_A} GROUP BY 1) GROUP BY 1")(_by)

LONG_B = f"(SELECT label, unnest([{', '.join(repr(n) for n in LBP_NAMES)}]) AS feature, unnest([{', '.join(LBP_NAMES)}]) AS x FROM fx_features_b)"
_NAMED = ", ".join(f"'{n}': 'wavelet_{('l1_lh', 'l1_hl', 'l1_hh', 'l2_ll')[k % 4]}_{('mean', 'std', 'energy', 'entropy')[k // 4]}'" for k, n in enumerate(LBP_NAMES))
for _what, _pattern in (("subband", "^wavelet_(l[0-9]_[a-z]+)_"), ("statistic", "_([a-z]+)$")):

    def _by_wavelet(v, what=_what, pattern=_pattern):
        names = {n: f"wavelet_{('l1_lh', 'l1_hl', 'l1_hh', 'l2_ll')[k % 4]}_{('mean', 'std', 'energy', 'entropy')[k // 4]}" for k, n in enumerate(LBP_NAMES)}
        rows = T.melted(v.features_b, LBP_NAMES).replace(names, subset="feature").groupBy("feature").agg(F.avg(F.abs("x")).alias("importance"))
        return rounded(T.importance_by(rows, pattern, what), "total", "mean")

    query(f"a16_importance_by_{_what}", f"SELECT regexp_extract(feature, '{_pattern}', 1) AS {_what}, round(sum(i), 6) AS total, round(avg(i), 6) AS mean FROM (SELECT map {{{_NAMED}}}[feature] AS feature, avg(abs(x)) AS i FROM {LONG_B} GROUP BY 1) GROUP BY 1")(_by_wavelet)
