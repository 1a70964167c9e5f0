"""Boosted trees and forests against plain recursion over the same draws."""

import numpy as np
import pytest

from grouploom.operators import trees as T

NAMES = ["f0", "f1", "f2", "f3", "f4"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(90):
        x = [float(v) for v in rng.integers(0, 9, 5)]
        y = int(x[0] + x[1] > 8) + int(x[2] > 5 and x[3] < 4)
        rows.append((k, f"g{k % 11}", y + 1, ("train", "train", "val")[k % 3], y, *x, 0.5 + (k % 4) / 2, 1.0))
    return spark.createDataFrame(rows, f"sample_id long, patient_id string, label int, split string, y int, {', '.join(f'{n} double' for n in NAMES)}, w double, one double").cache()


def arrays(table, edges):
    rows = sorted(table.collect(), key=lambda r: r.sample_id)
    x = np.array([[np.searchsorted(e, r[n], side="left") for r in rows] for n, e in zip(NAMES, edges, strict=True)])
    return np.array([r.sample_id for r in rows]), np.array([r.y for r in rows]), x, np.array([r.split == "train" for r in rows]), np.array([[r.w, r.one] for r in rows]).T


def boosted_by_hand(ids, y, x, train, weights, run, settings, rounds, number):
    margin = np.zeros((settings.classes, len(y)))
    for t in range(rounds):
        weight = weights[run.weight] * train * T.drawn_rows(settings.seed, t, ids, settings.rows)
        grad, hess = T.softmax_steps(margin, y, weight)
        new = margin.copy()
        for c in range(settings.classes):
            allowed = T.tree_features(settings.seed, t, np.array([number * settings.classes + c]), len(x), settings.features)[0]

            def build(rows, depth, c=c, allowed=allowed):
                g, h = sum(int(grad[c, r]) for r in rows if weight[r] > 0) / T.UNIT, sum(int(hess[c, r]) for r in rows if weight[r] > 0) / T.UNIT
                best = (1e-6, None)
                for f in allowed if depth else []:
                    for b in sorted({x[f, r] for r in rows if weight[r] > 0}):
                        left = [r for r in rows if x[f, r] <= b and weight[r] > 0]
                        gl, hl = sum(int(grad[c, r]) for r in left) / T.UNIT, sum(int(hess[c, r]) for r in left) / T.UNIT
                        if hl < settings.least_child or h - hl < settings.least_child:
                            continue
                        gain = (gl**2 / (hl + settings.penalty) + (g - gl) ** 2 / (h - hl + settings.penalty) - g**2 / (h + settings.penalty)) / 2
                        if gain > best[0] + 1e-13:
                            best = (gain, (f, b))
                if best[1] is None:
                    new[c, rows] += -run.rate * g / (h + settings.penalty)
                    return
                f, b = best[1]
                build([r for r in rows if x[f, r] <= b], depth - 1)
                build([r for r in rows if x[f, r] > b], depth - 1)

            build(list(range(len(y))), run.depth)
        margin = new
    e = np.exp(margin - margin.max(axis=0))
    return e / e.sum(axis=0)


@pytest.mark.parametrize("rows_of_block, keep", [(1 << 16, 50), (20, 2)])
def test_boosting_equals_recursion(table, monkeypatch, rows_of_block, keep):
    monkeypatch.setattr(T, "ROWS", rows_of_block)
    monkeypatch.setattr(T, "KEEP", keep)
    runs, settings = [T.Run(0, 2, 0.3), T.Run(1, 3, 0.5), T.Run(1, 1, 0.1)], T.Settings(3, seed=5)
    scored, model = T.boosted_scores(table, NAMES, ["w", "one"], "split = 'train'", "true", [2, 5], runs, settings)
    got = {(r.candidate, r.sample_id): r.p for r in scored.collect()}
    ids, y, x, train, weights = arrays(table, T.binned(table, NAMES))
    assert len(got) == 2 * 3 * 90
    for number, run in enumerate(runs):
        for n in (2, 5):
            p = boosted_by_hand(ids, y, x, train, weights, run, settings, n, number)
            name = f"{('w', 'one')[run.weight]}|{n}|{run.depth}|{run.rate:g}"
            for k, i in enumerate(ids):
                assert got[name, i] == pytest.approx(p[:, k].tolist(), abs=1e-9)
    assert (model.gains.sum(axis=1) > 0).all()


def forest_tree_by_hand(ids, y, x, train, tree, kind, weight, depth, width, seed, number):
    """Class shares of every row by one tree."""
    times = T.poisson_times(seed, np.full(len(ids), tree), ids) * train
    out = np.zeros((len(y), len(weight)))

    def build(rows, left_depth, path):
        counts = np.array([sum(times[r] for r in rows if y[r] == c) for c in range(len(weight))])
        score = lambda s: ((s * weight) ** 2).sum() / max((s * weight).sum(), 1e-300)
        best = (1e-9, None)
        if left_depth and counts.sum() >= kind.least_split and (counts > 0).sum() > 1:
            for f in T.node_features(seed, np.array([tree]), np.array([path]), len(x), width)[0]:
                for b in sorted({x[f, r] for r in rows if times[r]}):
                    left = np.array([sum(times[r] for r in rows if y[r] == c and x[f, r] <= b) for c in range(len(weight))])
                    if min(left.sum(), counts.sum() - left.sum()) < max(kind.least_leaf, 1):
                        continue
                    gain = score(left) + score(counts - left) - score(counts)
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, b))
        if best[1] is None:
            out[rows] = counts * weight / max((counts * weight).sum(), 1e-300)
            return
        f, b = best[1]
        build([r for r in rows if x[f, r] <= b], left_depth - 1, 2 * path)
        build([r for r in rows if x[f, r] > b], left_depth - 1, 2 * path + 1)

    build(list(range(len(y))), depth, 1)
    return out


@pytest.mark.parametrize("rows_of_block", [1 << 16, 25])
def test_prefixes_and_cuts_of_a_forest_equal_forests_of_their_own(table, monkeypatch, rows_of_block):
    monkeypatch.setattr(T, "ROWS", rows_of_block)
    weight, kinds = [0.7, 1.0, 1.6], [T.Kind(2, 1), T.Kind(6, 3)]
    scored, forest = T.forest_scores(table, NAMES, weight, "split = 'train'", "true", [2, 5], [2, 6], kinds, seed=9)
    got = {(r.candidate, r.sample_id): r.p for r in scored.collect()}
    ids, y, x, train, _ = arrays(table, T.binned(table, NAMES))
    for k, kind in enumerate(kinds):
        for depth in (2, 6):
            each = [forest_tree_by_hand(ids, y, x, train, k * 5 + t, kind, np.array(weight), depth, 2, 9, k) for t in range(5)]
            for n in (2, 5):
                p = sum(each[:n]) / n
                for r, i in enumerate(ids):
                    assert got[f"{n}|{depth}|{kind.least_split}|{kind.least_leaf}", i] == pytest.approx(p[r].tolist(), abs=1e-9)
    assert forest.importances(0, 5, 6, 5).sum() == pytest.approx(1)


def test_a_table_of_one_class_gives_roots_only(spark):
    rows = spark.createDataFrame([(k, "g", 1, "train", 0, 1.0, 1.0) for k in range(5)], "sample_id long, patient_id string, label int, split string, y int, f0 double, one double")
    scored, forest = T.forest_scores(rows, ["f0"], [1.0, 0.0], "split = 'train'", "true", [3], [4], [T.Kind()])
    assert {tuple(r.p) for r in scored.collect()} == {(1.0, 0.0)} and forest.trees.depth == 0
    scored, _ = T.boosted_scores(rows, ["f0"], ["one"], "split = 'train'", "true", [2], [T.Run(0, 3, 0.3)], T.Settings(2))
    assert all(r.p[0] > 0.6 for r in scored.collect())


def test_rounds_over_one_block_share_a_job(spark, table):
    context = spark.sparkContext
    context.setJobGroup("rounds", "rounds")
    edges = T.binned(table, NAMES)
    blocks, count = T.blocks(table, NAMES, edges, "split = 'train'", ["w"])
    model = T.Boosted(T.Dealt(blocks, count, 2), [T.Run(0, 2, 0.3), T.Run(0, 3, 0.3)], T.Settings(3), len(NAMES), max(map(len, edges)) + 1)
    before = len(context.statusTracker().getJobIdsForGroup("rounds"))
    model.grow_to(40)
    assert model.rounds == 40 and len(context.statusTracker().getJobIdsForGroup("rounds")) - before < 10
    context.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("size", [40, 1 << 40])
def test_sums_by_key_are_exact_by_either_way(size):
    rng = np.random.default_rng(5)
    key, stats = rng.integers(0, 40, 300), rng.integers(-(1 << 45), 1 << 45, (100, 2))
    found, sums = T._added(key, stats, 3, size)
    assert found.tolist() == sorted(set(key.tolist()))
    assert sums.tolist() == [[sum(int(v) for v in stats[np.flatnonzero(key == k) // 3, c]) for c in (0, 1)] for k in found]


@pytest.mark.parametrize("depths", [[2, 6], [1, 30], [0, 3]])
def test_votes_equal_the_scores_of_whole_forests(table, depths):
    kinds = [T.Kind(2, 1), T.Kind(6, 3)]
    args = (table, NAMES, [0.7, 1.0, 1.6], "split = 'train'", "split = 'val'", [2, 5], depths, kinds)
    want, got = ({(r.candidate, r.sample_id): r.p for r in df.collect()} for df in (T.forest_scores(*args, seed=9)[0], T.forest_votes(*args, seed=9)))
    assert got.keys() == want.keys() and len(got) == 2 * 2 * 2 * 30
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


@pytest.mark.parametrize("rows_of_block", [90, 4])
def test_votes_over_blocks_hold_a_batch_of_trees(spark, table, monkeypatch, rows_of_block):
    """Over several blocks whole forests reached the driver, and histograms of all their trees one task."""
    kinds, held, grow = [T.Kind(2, 1), T.Kind(6, 3)], [], T.grow_forest
    args = (table, NAMES, [0.7, 1.0, 1.6], "split = 'train'", "split = 'val'", [2, 5], [2, 6], kinds)
    want = {(r.candidate, r.sample_id): r.p for r in T.forest_votes(*args, seed=9).collect()}

    def spied(dealt, *rest):
        forest = grow(dealt, *rest)
        held.append((dealt.groups, forest.trees.count))
        return forest

    monkeypatch.setattr(T, "ROWS", rows_of_block)
    monkeypatch.setattr(T, "ENTRIES", 1)
    monkeypatch.setattr(T, "grow_forest", spied)
    got = {(r.candidate, r.sample_id): r.p for r in T.forest_votes(*args, seed=9).collect()}
    assert got == want
    # a table of up to eight times ROWS is one block
    assert bool(held) == (rows_of_block == 4) and all(trees <= groups for groups, trees in held)


def test_rounds_take_the_sums_of_the_smaller_children_only(monkeypatch):
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 40, (5, 900)).astype(np.uint8), rng.integers(0, 3, 900)
    block = T.Block(0, np.arange(900), y, (rng.random((1, 900)) < 0.7) * 1.0, x)
    added, plain = [], T._sums
    monkeypatch.setattr(T, "_sums", lambda x, features, rows, *more: added.append(len(rows)) or plain(x, features, rows, *more))
    T._round(block, np.zeros((1, 3, 900)), [0], [T.Run(0, 5, 0.1)], T.Settings(3), 0, 5, 41, np.zeros((1, 5)))
    learnt = int(((block.weights[0] > 0) & T.drawn_rows(42, 0, block.ids, 0.8)).sum())
    # of five levels the first counts whole and the others half
    assert 3 * learnt < sum(added) <= 3 * learnt * 3


@pytest.mark.parametrize("few, heavy", [(0, 1.0), (1 << 14, 1.0), (1 << 14, 2.0**25)])
def test_rounds_within_a_block_equal_rounds_by_levels(spark, table, monkeypatch, few, heavy):
    """Probabilities bit by bit; sums of heavy weights don't fit a double."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(T, "FEW", few)
    edges, rows = T.binned(table, NAMES), table.withColumn("w", F.col("w") * heavy)
    found = []
    for within in (True, False):
        blocks, _ = T.blocks(rows, NAMES, edges, "split = 'train'", ["w", "one"])
        dealt = T.Dealt(blocks, 1, 2)
        model = T.Boosted(dealt, [T.Run(0, 4, 0.3), T.Run(1, 2, 0.5), T.Run(1, 1, 0.1)], T.Settings(3), len(NAMES), max(map(len, edges)) + 1)
        if within:
            model.grow_to(3)
        else:
            for _ in range(3):
                model.grow()
        found.append(({(r.candidate, r.sample_id): r.p for r in model.probabilities(str).collect()}, model.gains.tolist()))
    assert found[0][0] == found[1][0] and len(found[0][0]) == 3 * 90
    np.testing.assert_allclose(found[0][1], found[1][1], rtol=1e-12)


def test_a_boosted_block_holds_four_times_the_rows_of_a_forests(table, monkeypatch):
    monkeypatch.setattr(T, "ROWS", 30)
    _, model = T.boosted_scores(table, NAMES, ["one"], "split = 'train'", "true", [2], [T.Run(0, 2, 0.3)], T.Settings(3))
    assert model.dealt.count == 1
