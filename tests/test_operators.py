"""Hand values and properties of the operators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from grouploom.functions import scalars as S
from grouploom.operators import compare as C
from grouploom.operators import features as T
from grouploom.operators import integrity as I
from grouploom.operators import kernels as N
from grouploom.operators import metrics as M
from grouploom.operators import quality as Q
from grouploom.operators import raster as R
from grouploom.operators import resample as B
from grouploom.operators import splits as P
from grouploom.sources import tables as IO


def cells(spark, matrix, key="m"):
    rows = [(key, i, j, n) for i, row in enumerate(matrix) for j, n in enumerate(row)]
    return spark.createDataFrame(rows, "model string, true_idx int, pred_idx int, n long")


# published confusion matrices and the metrics published with them
GOLDEN = [
    ([[110, 6, 1], [6, 215, 1], [1, 5, 153]], 0.9598, 0.9582),
    ([[103, 10, 4], [2, 219, 1], [4, 13, 142]], 0.9317, 0.9279),
    ([[101, 9, 7], [2, 220, 0], [5, 11, 143]], 0.9317, 0.9252),
    ([[69, 26, 22], [10, 205, 7], [15, 30, 114]], 0.7791, 0.7526),
]


@pytest.mark.parametrize("matrix,accuracy,f1", GOLDEN)
def test_headline_of_published_matrices(spark, matrix, accuracy, f1):
    row = M.headline(M.per_class(cells(spark, matrix), ["model"]), ["model"], 3).first()
    assert round(row.accuracy, 4) == accuracy and round(row.macro_f1, 4) == f1


def test_hand_values_and_absent_class(spark):
    onehot = lambda k: [1.0 if j == k else 0.0 for j in range(3)]
    truth, pred = [0, 0, 1, 1, 2, 2], [0, 1, 1, 1, 2, 0]
    rows = spark.createDataFrame([("a", t, onehot(p)) for t, p in zip(truth, pred)] + [("b", 0, onehot(0)), ("b", 1, onehot(0)), ("b", 1, onehot(0))], "model string, true_idx int, p array<double>")
    h = {r.model: r for r in M.headline(M.per_class(M.confusion(rows, ["model"], 3), ["model"]), ["model"], 3).collect()}
    assert h["a"].accuracy == pytest.approx(4 / 6) and h["a"].macro_f1 == pytest.approx((0.5 + 0.8 + 2 / 3) / 3)
    assert h["b"].balanced_accuracy == pytest.approx(0.5) and h["b"].macro_recall == pytest.approx(1 / 3)
    area = {(r.model, r["class"]): r.auc for r in M.auc(M.one_vs_rest(rows, ["model"]), ["model"]).collect()}
    assert area["b", 2] is None and area["b", 0] == 0.5
    ece = {r.model: r.ece for r in M.calibration_error(M.calibration_bins(rows, ["model"]), ["model"]).collect()}
    assert ece["b"] == pytest.approx(2 / 3) and M.calibration_bins(rows, ["model"]).count() == 30


def test_bootstrap_moves_groups_as_blocks(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([("a", g, int(t), [float(x) for x in rng.dirichlet([1, 1, 1])]) for g in "ABCDE" for t in rng.integers(0, 3, 4)], "model string, g string, true_idx int, p array<double>")
    draws = B.multiplicities(rows, "g", 7, 3)
    assert {r.t for r in draws.groupBy("b").agg(F.sum("times").alias("t")).collect()} == {5}
    once = B.resampled(rows, draws, ["model"], "g", 3)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, B.resampled(rows, draws, ["model"], "g", 3).collect()))
    same = B.paired(once, once, ["model"]).agg(F.max(F.abs("value"))).first()[0]
    assert same == 0


def test_split_has_exact_counts_and_no_overlap(spark):
    rows = spark.createDataFrame([(f"g{k}", k % 3) for k in range(90) for _ in range(3)], "patient_id string, label int")
    split = P.assign_group_splits(rows, 1)
    got = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert all(got[x, "train"] == 21 and got[x, "val"] == 4 and got[x, "test"] == 5 for x in range(3))
    assert split.select("patient_id").distinct().count() == 90


def test_early_stopping(spark):
    scores = [0.1, 0.3, 0.3, 0.2, 0.2, 0.9]
    rows = spark.createDataFrame([("r", k, s, 1.0 - 0.1 * k) for k, s in enumerate(scores)], "run_id string, epoch long, val_macro_f1 double, val_loss double")
    got = C.best_so_far(rows, patience=2).orderBy("epoch").collect()
    assert [r.improved for r in got] == [True, True, True, False, False] and got[-1].stopped


def sample(spark, images, masks, side):
    rows = [(k, side, side, [int(x) for x in np.ravel(i)], [int(x) for x in np.ravel(m)]) for k, (i, m) in enumerate(zip(images, masks))]
    return spark.createDataFrame(rows, "sample_id long, height int, width int, image_raw array<int>, tumor_mask array<int>")


def test_normalization_edge_cases(spark):
    images = [np.zeros(9), np.full(9, 7), np.arange(9)]
    rows = {r.sample_id: r.image_normalized for r in R.with_normalized(sample(spark, images, [np.ones(9)] * 3, 3)).collect()}
    assert rows[0] == [0.0] * 9 and rows[1] == [0.0] * 9
    low, high = np.percentile(np.arange(1, 9), [1, 99])
    want = (np.clip(np.arange(9), low, high) - low) / (high - low)
    want[0] = 0
    assert np.allclose(rows[2], want)


def test_boxes_and_crop(spark):
    mask = np.zeros((5, 5), int)
    mask[0, 3:5] = 1
    image = np.arange(25)
    s = sample(spark, [image, image], [mask, np.zeros(25)], 5)
    box = {r.sample_id: r for r in R.roi_geometry(s).collect()}
    assert (box[0].r0, box[0].r1, box[0].c0, box[0].c1, box[0].longest, box[0].pad, box[0].side) == (0, 1, 3, 5, 2, 1, 4)
    assert box[1].area == 0 and (box[0].over_top, box[0].over_right) == (2, 1)
    crop = np.array(R.cropped(s).where("sample_id = 0").first().crop).reshape(4, 4)
    assert crop[:2].sum() == 0 and crop[2].tolist() == [2, 3, 4, 0]


def test_cooccurrence_ignores_background(spark):
    rng = np.random.default_rng(1)
    mask = np.zeros((6, 6), int)
    mask[1:4, 2:5] = 1
    image = rng.integers(1, 100, (6, 6))
    counts = R.cooccurrence(sample(spark, [image], [mask], 6))
    totals = {(r.d, r.a): r.n for r in counts.groupBy("d", "a").agg(F.sum("n").alias("n")).collect()}
    assert totals[1, 0] == 12 and totals[1, 45] == 8 and totals[2, 90] == 6
    both = R.texture_directional(R.cooccurrence_properties(counts)).first()
    alone = R.texture_summary(R.cooccurrence_properties(counts)).first()
    assert both.contrast_mean == alone.contrast_mean and both["contrast_d4_a0"] == 0.0


def test_kernels():
    x = np.random.default_rng(0).random((8, 8))
    assert np.allclose(N.resize(x, 8), x) and np.allclose(N.resize(np.full((5, 5), 0.3), 11), 0.3)
    assert np.allclose(N.resize(np.arange(4.0)[None, :] / 4 + np.zeros((4, 1)), 2, antialias=True)[0].mean(), 1.5 / 4)
    assert N.lbp_histogram(x, np.ones((8, 8))).sum() == pytest.approx(1)
    flat = N.wavelet_features(np.full((16, 16), 0.5))
    assert flat["wavelet_l1_hh_energy"] == pytest.approx(0) and flat["wavelet_l2_ll_mean"] == pytest.approx(2.0) and len(flat) == 28
    bands = N.wavelet_bands(np.tile([0.0, 1.0], (16, 8)))
    assert (bands["l1_hl"] ** 2).mean() > 0.1 > (bands["l1_lh"] ** 2).mean()
    assert len(N.gabor_features(x)) == 60 and np.allclose(N.augmented(x, False, 0, 0, 0, 1, 1, 1), x)


def test_feature_contract(spark):
    rows = spark.createDataFrame([(1, "a", 1, "train", 1.0), (2, "b", 2, "val", float("nan"))], "sample_id long, patient_id string, label int, split string, bad__name double")
    rules = {r.rule for r in T.contract_violations(rows, [1, 2, 3]).collect()}
    assert rules == {"bad_name", "not_finite"}
    with pytest.raises(ValueError):
        Q.require_clean(T.contract_violations(rows, [1, 2, 3]))


def test_scalar_functions(spark):
    row = spark.range(1).select(
        S.run_key(F.lit("net"), F.lit(0.001), F.lit(42)).alias("key"), S.normalized_id(F.lit("7.0")).alias("id"), S.normalized_id(F.lit("0")).alias("zero"), S.text_from_codes(F.array(*[F.lit(x) for x in (65, 0, 66, 32)])).alias("text"),
        S.border_warnings(F.array(F.lit(1.0), F.lit(float("nan")), F.lit(2.0))).alias("border"), M.argmax(F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2))).alias("first"),
    ).first()
    assert tuple(row) == ("net_lr1e-03_seed42", 7, None, "AB", "non_finite; odd_count", 0)


def test_sources(spark, tmp_path):
    for name in ("10.mat", "2.mat", "index.mat", "3.txt"):
        (tmp_path / "raw").mkdir(exist_ok=True)
        (tmp_path / "raw" / name).write_bytes(name.encode())
    found = IO.sample_files(spark, str(tmp_path / "raw"), ".mat", "index.mat").collect()
    assert [r.number for r in found] == [2, 10]
    digests = I.file_digests(spark.read.format("binaryFile").load(str(tmp_path / "raw")))
    assert I.directory_digest(digests).first().n_files == 4
    (tmp_path / "split.csv").write_text("sample_id,patient_id,label,split\n1,0012,2,train\n")
    row = IO.typed_csv(spark, str(tmp_path / "split.csv"), IO.SPLIT_SCHEMA, ["sample_id", "patient_id"]).first()
    assert row.patient_id == "0012" and row.sample_id == 1
    with pytest.raises(ValueError):
        IO.typed_csv(spark, str(tmp_path / "split.csv"), IO.SPLIT_SCHEMA, ["size"])
    good = {"n": 2000, "seed": 42, "alpha": 0.05}
    new = {"experiment": "x", "metrics": {"accuracy": 0.5, "macro_f1": 0.4}, "confusion": [[1, 0], [0, 1]], "bootstrap": good}
    old = {"name": "y", "test_metrics": {"accuracy": 0.6, "macro_f1": 0.7}, "test_confusion_matrix": [[1, 0]]}
    for k, record in enumerate((new, old)):
        (tmp_path / "runs" / str(k)).mkdir(parents=True)
        (tmp_path / "runs" / str(k) / "metrics.json").write_text(json.dumps(record, indent=1))
    records = IO.experiment_records(spark, str(tmp_path / "runs"))
    assert {r.experiment: r.accuracy for r in records.collect()} == {"x": 0.5, "y": 0.6}
    assert {tuple(r) for r in IO.record_violations(records, 2, good).collect()} == {("matrix_shape", "y"), ("bootstrap_settings", "y")}
    IO.write_results({"metrics": spark.createDataFrame([(float("nan"),), (1.0,)], "x double")}, str(tmp_path / "out"), "r1")
    assert {r.x for r in spark.read.parquet(str(tmp_path / "out" / "metrics")).collect()} == {None, 1.0}
