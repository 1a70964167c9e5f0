"""The bootstraps with the 2000 resamples of the survey, against NumPy over the same draws."""

import hashlib
import os

import numpy as np
import pytest

from grouploom.operators import resample as B
from grouploom.plans import registry
from grouploom.plans.evaluation import RUN
from grouploom.plans.fixtures import Views

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
N = 2000


@pytest.fixture(scope="module")
def runs(spark):
    """Per (model, seed): classes, probabilities and the weight of every row in every resample."""
    rows = Views(spark, SF).predictions.toPandas()
    groups = sorted(rows.patient_id.unique())
    draws = np.zeros((N, len(groups)))
    for b in range(N):
        for k in range(len(groups)):
            draws[b, int(hashlib.md5(f"7:{b}:{k}".encode()).hexdigest()[:8], 16) % len(groups)] += 1
    number = {g: k for k, g in enumerate(groups)}
    return {key: (r.true_idx.to_numpy(), np.array(r.p.tolist()), draws[:, r.patient_id.map(number).to_numpy()]) for key, r in rows.groupby(RUN)}


def accuracy(true, p, times):
    return (times * (p.argmax(axis=1) == true)).sum(axis=1) / times.sum(axis=1)


def macro_auc(true, p, times):
    areas = []
    for c in range(3):
        own = true == c
        beats = (p[own, c][:, None] > p[~own, c][None, :]) + (p[own, c][:, None] == p[~own, c][None, :]) / 2
        areas.append(((times[:, own] @ beats) * times[:, ~own]).sum(axis=1) / (times[:, own].sum(axis=1) * times[:, ~own].sum(axis=1)))
    return np.mean(areas, axis=0)


def bounds(values):
    return pytest.approx(tuple(np.percentile(values, (2.5, 97.5))), abs=2e-6)


def test_intervals_of_2000_resamples(spark, runs):
    find = lambda name, *keys: {tuple(r[k] for k in keys): r for r in registry.queries()[name](spark, SF).where("metric = 'accuracy'").collect()}
    values = {key: accuracy(*x) for key, x in runs.items()}
    got = find("b01_group_bootstrap", *RUN)
    assert set(got) == set(values) and all(r.n_valid == N and (r.low, r.high) == bounds(values[k]) for k, r in got.items())
    got = find("b02_paired_bootstrap", "seed")
    for (seed,), r in got.items():
        gap = values["a", seed] - values["b", seed]
        assert (r.low, r.high) == bounds(gap) and r.frac_a_greater == pytest.approx((gap > 1e-12).mean(), abs=2e-3)
    means = {m: np.mean([values[m, s] for s in (42, 43, 44)], axis=0) for m in "ab"}
    assert all((r.low, r.high) == bounds(means[m]) and r.n_valid == N for (m,), r in find("b03_multi_seed_bootstrap", "model").items())
    pairs = find("b04_paired_multi_seed", "pair")
    assert (pairs["a-b",].low, pairs["a-b",].high) == bounds(means["a"] - means["b"])
    for (m,), r in find("c10_headline_bars", "model").items():
        point = np.mean([(runs[m, s][1].argmax(axis=1) == runs[m, s][0]).mean() for s in (42, 43, 44)])
        low, high = np.percentile(means[m], (2.5, 97.5))
        assert (r.below, r.above) == pytest.approx((point - low, high - point), abs=3e-6)


def test_auc_intervals_of_all_runs(spark, runs):
    got = {(r.model, r.seed): r for r in registry.queries()["b05_auc_bootstrap"](spark, SF).collect()}
    assert set(got) == set(runs)
    assert all(r.n_valid == N and (r.low, r.high) == bounds(macro_auc(*runs[k])) for k, r in got.items())


def test_auc_by_pairs_of_groups_with_ties(spark):
    rows = spark.createDataFrame([("a", 1, g, y, [p, 1 - p]) for g, y, p in [("x", 0, 0.5), ("x", 1, 0.5), ("y", 0, 0.9), ("y", 0, 0.2), ("z", 1, 0.2), ("z", 1, 0.7)]], "model string, seed int, patient_id string, true_idx int, p array<double>")
    draws = B.multiplicities(rows, "patient_id", 25, 3)
    want = {r.b: r.value for r in B.resampled(rows, draws, RUN, "patient_id", 2, True).where("metric = 'macro_auc'").collect()}
    got = {r.b: r.value for r in B.resampled_auc(rows, draws, RUN, "patient_id").collect()}
    assert set(got) == set(want) == set(range(25))
    assert all(got[b] is None if want[b] is None else got[b] == pytest.approx(want[b], abs=1e-12) for b in want)


def test_wins_of_groups_equal_all_pairs():
    rng = np.random.default_rng(6)
    for rows, groups, step in ((1, 1, 4), (300, 7, 16), (200, 40, 500)):
        score, group = rng.integers(0, 12, rows) / 4, rng.integers(0, groups, rows)
        pos, neg = rng.integers(0, 3, rows).astype(float), rng.integers(0, 3, rows).astype(float)
        want = np.zeros((groups, groups))
        beats = ((score[:, None] > score) + (score[:, None] == score) / 2) * pos[:, None] * neg
        np.add.at(want, (group[:, None] + np.zeros(rows, int), group + np.zeros((rows, 1), int)), beats)
        assert np.allclose(B._wins(pos, neg, score, group, groups, step), want)


@pytest.mark.parametrize("slab", [512, 2])
def test_ordered_pairs_across_ranges(spark, monkeypatch, slab):
    monkeypatch.setattr(B, "SLAB", slab)
    rng = np.random.default_rng(3)
    rows = [("m", f"g{int(g)}", int(t), [float(v) for v in p]) for g, t, p in zip(rng.integers(0, 6, 400), rng.integers(0, 3, 400), np.round(rng.dirichlet([1, 1, 1], 400), 2), strict=True)]
    got = {(r["class"], r.g, r.h): r.pairs for r in B.ordered_pairs(spark.createDataFrame(rows, "model string, p_id string, true_idx int, p array<double>").repartition(5), ["model"], "p_id").collect()}
    want = {}
    for c in range(3):
        for _, g, t, p in rows:
            for _, h, u, q in rows:
                if t == c and u != c and p[c] >= q[c]:
                    want[c, g, h] = want.get((c, g, h), 0) + (1 if p[c] > q[c] else 0.5)
    assert got == want
