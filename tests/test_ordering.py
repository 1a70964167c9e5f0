"""Places, running sums and quantiles against Python, and plans without a task that sees all rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grouploom.operators import compare as C
from grouploom.operators import metrics as M
from grouploom.operators import ordering as O
from grouploom.operators import resample as B
from grouploom.operators import splits as P
from grouploom.plans import registry
from grouploom.plans.fixtures import Views

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([None, *range(30)]), k) for k in range(900)] + [("one", 5, 1000), ("none", None, 1001)]
    return rows, spark.createDataFrame(rows, "key string, x int, id long").repartition(7)


def test_places(spark, values):
    rows, df = values
    got = [r.id for r in O.numbered(df, "n", F.desc("x"), F.col("id")).orderBy("n").collect()]
    assert got == [r[2] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))]
    assert O.numbered(df.where("false"), "n", F.col("id")).count() == 0


def test_exact_quantiles(values):
    rows, df = values
    got = {r.key: r for r in O.quantiles(df, ["key"], "x", {"low": 0.0, "third": 1 / 3, "median": 0.5, "high": 1.0}).collect()}
    assert set(got) == {"a", "b", "one"}
    for key, r in got.items():
        x = [v for k, v, _ in rows if k == key and v is not None]
        assert r.n == len(x) and (r.low, r.third, r.median, r.high) == pytest.approx(tuple(np.quantile(x, (0, 1 / 3, 0.5, 1))))


def test_radix_selection_equals_sorting(spark, monkeypatch):
    monkeypatch.setattr(O, "BUFFERED", 3)
    rng = random.Random(8)
    pool = [0.0, -0.0, -1.5, 1e-300, -1e300, float("inf"), float("-inf"), 5e-324, 0.1, 0.1 + 1e-17, 2.0**52]
    rows = [(rng.choice("ab"), rng.choice([None, rng.choice(pool), rng.gauss(0, 1), round(rng.gauss(0, 9), 1)])) for _ in range(700)] + [("one", 0.25), ("none", None)]
    df = spark.createDataFrame(rows, "key string, x double").repartition(5)
    wanted = df.where("x IS NOT NULL").groupBy("key").agg(F.count("*").alias("n")).select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("rank"))
    got = {(r.key, r["rank"]): r.x for r in O.selected(df.where("x IS NOT NULL"), ["key"], "x", wanted).collect()}
    for key in ("a", "b", "one"):
        assert [got[key, k] for k in range(sum(k == key for k, _ in got))] == sorted(v for k, v in rows if k == key and v is not None)
    finite = df.where("abs(x) < 1e10")
    found = {r.key: r for r in O.quantiles(finite, ["key"], "x", {"low": 0.0, "third": 1 / 3, "median": 0.5, "high": 1.0}).collect()}
    for key, r in found.items():
        x = [v for k, v in rows if k == key and v is not None and abs(v) < 1e10]
        assert r.n == len(x) and (r.low, r.third, r.median, r.high) == pytest.approx(tuple(np.quantile(x, (0, 1 / 3, 0.5, 1))))


@pytest.mark.parametrize("delta", [0.0, 0.05])
def test_best_so_far_equals_the_steps(spark, delta):
    rng = random.Random(4)
    rows = [(r, e, round(rng.random(), 1), round(rng.random(), 2)) for r in range(6) for e in range((3, 40, 1, 200, 60, 17)[r])]
    rows += [(9, e, 0.5 + e / 1000, 1.0) for e in range(300)]
    df = spark.createDataFrame(rows, "run_id long, epoch long, val_macro_f1 double, val_loss double").repartition(6)
    want = set()
    for run in {r for r, *_ in rows}:
        best, loss, stale = None, None, 0
        for _, e, f1, lo in sorted(x for x in rows if x[0] == run):
            improved = best is None or f1 > best + delta or (f1 == best and lo < loss)
            best, loss, stale = (f1, lo, 0) if improved else (best, loss, stale + 1)
            want.add((run, e, improved, stale, stale >= 25))
            if stale >= 25:
                break
    assert {tuple(r) for r in C.best_so_far(df, 25, delta).collect()} == want


def test_places_of_draws(spark):
    df = spark.createDataFrame([(k % 3 if k % 7 else None, k) for k in range(500)], "label int, patient_id int").repartition(4)
    got = P.drawn_places(df, "label", P.seeded_order(3, "patient_id")).orderBy("place").collect()
    for label in (0, 1, 2, None):
        own = [r for r in got if r.label == label]
        order = sorted((hashlib.md5(f"3:{k}".encode()).hexdigest(), k) for k in range(500) if (k % 3 if k % 7 else None) == label)
        assert [(r.place, r.patient_id) for r in own] == [(n + 1, k) for n, (_, k) in enumerate(order)] and {r.n for r in own} == {len(order)}


def test_areas_and_curves_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.dirichlet([1, 1, 1], 400), 2)
    true = rng.integers(0, 3, 400)
    df = spark.createDataFrame([(1, int(t), [float(x) for x in v]) for t, v in zip(true, p)], "one int, true_idx int, p array<double>")
    scores = M.one_vs_rest(df, ["one"])
    areas = {r["class"]: r.auc for r in M.auc(scores, ["one"]).collect()}
    points = M.roc_points(scores, ["one"])
    for c in range(3):
        own, rest = p[true == c, c][:, None], p[true != c, c][None, :]
        assert areas[c] == pytest.approx(((own > rest) + (own == rest) / 2).mean())
        curve = points.where(F.col("class") == c).orderBy("k").collect()
        assert [r.k for r in curve] == list(range(len(curve))) and curve[0].threshold == float("inf") and (curve[-1].fpr, curve[-1].tpr) == (1, 1)
        for r in curve[1:]:
            assert r.fpr == pytest.approx((rest >= r.threshold - 1e-12).mean()) and r.tpr == pytest.approx((own >= r.threshold - 1e-12).mean())
        assert sum((b.fpr - a.fpr) * (a.tpr + b.tpr) / 2 for a, b in zip(curve, curve[1:])) == pytest.approx(areas[c])


@pytest.mark.parametrize("name", ["t01_numeric_order", "w06_importance_rank", "w08_candidate_ranking", "v13_check_summary", "a19_gaps", "e04_auc_large", "e06_roc_points", "e11_size_edges", "a07_percentile_profile", "c08_latency", "j12_registered_hash"])
def test_no_window_over_all_rows(spark, name):
    """Every window of these plans sits on rows dealt by a key, never on a single partition."""
    lines = plan(registry.queries()[name](spark, SF)).split("== Physical Plan ==")[1].splitlines()
    for k, line in enumerate(lines):
        if "Window [" in line:
            below = next((x for x in lines[k + 1 :] if "Exchange" in x or "Scan" in x), "")
            assert "SinglePartition" not in below, name


def test_draws_are_rows_of_a_range(spark):
    draws = B.multiplicities(Views(spark, SF).predictions, "patient_id", 50, 7)
    physical = plan(draws)
    assert "Range (" in physical and "Generate" not in physical[physical.index("== Physical Plan ==") :]
    assert draws.groupBy("b").agg(F.sum("times").alias("t")).select("t").distinct().count() == 1
