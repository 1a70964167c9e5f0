"""Tree ensembles by shared histograms: boosted softmax trees and random forests.

Rows lie in blocks of binned features. All trees that grow at the same time, of all classes and of all
candidates of a search, take part in one job per level: blocks add up statistics by (node, feature, bin),
what several blocks hold of a tree is merged by a shuffle, and only the best split of every node reaches
the driver, which grows the trees and broadcasts them. Statistics are whole numbers (counts, or gradients
in units of 2**-30), so that no order of addition shows in a model.

A search shares work where candidates nest. Boosted candidates that differ in rounds only are one run,
scored as it passes each number of rounds. Forests that differ in trees or depth only are one forest,
scored by sums over its first trees and by cutting its paths.

A level is imperative work on a block, and levels follow one another by the thousand; so these jobs are
RDD jobs, which take a fraction of the time that planning a DataFrame job takes. With fewer blocks than
tasks every block is dealt with once per group of trees. Where all rows fit one block (``ROWS`` of them, or
``BOOSTED`` or ``FORESTS`` times as many), a group's trees need nothing from other tasks: the rounds of its runs follow one another in its task, up
to ``KEEP`` of them in a job, and give the same trees.

Random draws (rows and features of a boosted tree, rows of a forest's tree, features of its nodes) are
hashes of (seed, tree or node, row), whatever the partitioning.
"""

from __future__ import annotations

import io
import pickle
import uuid
from functools import partial
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .features import METADATA
from .ordering import stored

ROWS, BINS = 1 << 18, 128
UNIT = 1 << 30
#: A whole share of a class in the sums over a forest's trees.
SHARE = 1 << 40
#: A block of a boosted run is so many times as large: what its rounds hold grows with its rows alone.
BOOSTED = 4
#: And one of a forest's votes, which hold a few trees at a time.
FORESTS = 8
#: Entries of a histogram that are sorted at once.
ENTRIES = 1 << 22
#: Entries of a node that are added up in one call, not by feature.
FEW = 1 << 14
#: Rounds after which margins are written, so that a lost task repeats few rounds.
KEEP = 50
#: Margins that a worker keeps at most.
MARGIN_BYTES = 128 << 20
_margins: dict = {}


def mixed(*parts) -> np.ndarray:
    """64 hash bits of whole numbers, elementwise (the public splitmix64 finalizer)."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = h + np.asarray(p, np.int64).view(np.uint64) if np.ndim(p) else h + np.uint64(int(p) & (2**64 - 1))
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return h


def fraction(*parts) -> np.ndarray:
    return (mixed(*parts) >> np.uint64(11)) * 2.0**-53


class Trees(NamedTuple):
    """Nodes of trees that grow together; the root of tree t is node t. A node without a feature is a
    leaf; rows with a bin above ``bin`` go to the node after ``left``."""

    count: int
    tree: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    path: np.ndarray
    depth: int
    value: np.ndarray | None = None

    @staticmethod
    def roots(count: int) -> Trees:
        n = np.arange(count)
        return Trees(count, n, np.full(count, -1, np.int32), np.zeros(count, np.int32), np.zeros(count, np.int64), np.ones(count, np.int64), 0)

    def walk(self, x: np.ndarray, trees: np.ndarray, depth: int | None = None) -> np.ndarray:
        """Node of every (tree, row)."""
        row = np.arange(x.shape[1])[None, :]
        node = np.repeat(np.asarray(trees, np.int64)[:, None], x.shape[1], axis=1)
        for _ in range(self.depth if depth is None else min(depth, self.depth)):
            f = self.feature[node]
            inner = f >= 0
            node = np.where(inner, self.left[node] + (x[np.maximum(f, 0), row] > self.bin[node]), node)
        return node

    def split(self, node: np.ndarray, feature: np.ndarray, bin_: np.ndarray) -> tuple[Trees, np.ndarray]:
        """With the nodes split; the new nodes, in pairs."""
        n, k = len(self.tree), len(node)
        feature_, bins, left = self.feature.copy(), self.bin.copy(), self.left.copy()
        feature_[node], bins[node], left[node] = feature, bin_, n + 2 * np.arange(k)
        new = np.arange(n, n + 2 * k)
        with np.errstate(over="ignore"):
            path = np.repeat(self.path[node], 2) * 2 + np.tile([0, 1], k)
        fill = lambda a, v: np.concatenate((a, np.full(2 * k, v, a.dtype)))
        return Trees(self.count, np.concatenate((self.tree, np.repeat(self.tree[node], 2))), fill(feature_, -1), fill(bins, 0), fill(left, 0), np.concatenate((self.path, path)), self.depth + 1), new


class Block(NamedTuple):
    number: int
    ids: np.ndarray
    y: np.ndarray
    weights: np.ndarray  # modes x rows; 0 for rows that aren't trained on
    x: np.ndarray  # features x rows, bins


def binned(rows: DataFrame, names: list[str], bins: int = BINS) -> list[list[float]]:
    """Upper edges of each feature's bins: at most ``bins`` quantiles of the training rows, from a
    sketch of bounded size."""
    places = F.array(*[F.lit((k + 1) / bins) for k in range(bins - 1)])
    wide = rows.where("split = 'train'").agg(*[F.percentile_approx(c, places, 10 * bins).alias(c) for c in names]).first()
    return [sorted(set(wide[c] or [])) for c in names]


def blocks(rows: DataFrame, names: list[str], edges: list[list[float]], trained: str, weights: list[str], times: int = 1) -> tuple[DataFrame, int]:
    """A stored table of pickled blocks of ``rows`` (metadata, y, features, weight columns), of ``times`` times
    ``ROWS`` at most, about, and their number. Rows where ``trained`` (SQL) doesn't hold have weight 0."""
    ship(rows.sparkSession)
    n = rows.count()
    count = n // (times * ROWS) + 1
    w = [F.when(F.expr(trained), F.col(c).cast("double")).otherwise(0.0).alias(f"w{k}") for k, c in enumerate(weights)]
    flat = rows.select(F.col("sample_id").cast("bigint").alias("id"), F.col("y").cast("int").alias("y"), *w, *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(names)])
    # equal sizes whatever the ids: a hash deals the rows, ids order those of a block
    dealt = flat.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")).repartition(count, "block").sortWithinPartitions("block", "id")
    kind = np.uint8 if max(map(len, edges), default=0) < 256 else np.uint16

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            number = batch.column("block").to_numpy()
            for b in np.unique(number):
                held.setdefault(int(b), []).append(batch.filter(pa.array(number == b)))
        for b, parts in held.items():
            t = pa.Table.from_batches(parts)
            get = lambda name, t=t: t.column(name).to_numpy()
            x = np.empty((len(edges), len(t)), kind)
            for k, e in enumerate(edges):
                x[k] = np.searchsorted(np.array(e, float), get(f"x{k}"), side="left")
            out = io.BytesIO()
            np.savez(out, ids=get("id").astype(np.int64), y=get("y").astype(np.int64), weights=np.array([get(f"w{k}") for k in range(len(weights))]), x=x)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([out.getvalue()], pa.binary())], names=["block", "data"])

    return stored(dealt.mapInArrow(run, "block int, data binary"), "blocks"), count


def _opened(number: int, data: bytes) -> Block:
    with np.load(io.BytesIO(bytes(data))) as z:
        return Block(number, z["ids"], z["y"], z["weights"], z["x"])


class Dealt:
    """Blocks as a kept RDD of (block, group of trees, state): state is (rounds, margins)."""

    def __init__(self, table: DataFrame, count: int, most: int):
        """``most`` groups at most: the number of models that grow apart from one another."""
        spark = table.sparkSession
        self.spark, self.count = spark, count
        self.groups = min(most, max(1, spark.sparkContext.defaultParallelism // count))
        copies = table.select("block", "data", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))).alias("g"))
        groups = self.groups
        self.rdd = self._placed(copies.rdd.map(lambda r: (r.block * groups + r.g, (r.block, r.g, bytes(r.data))))).map(lambda v: (_opened(v[0], v[2]), v[1], (0, None))).persist()

    def _placed(self, numbered):
        """One element a task: hashes would give some tasks several."""
        return numbered.partitionBy(self.count * self.groups, int).values()

    def settle(self, state) -> None:
        """Writes the ``state`` of every element, so that later tasks go on from there."""
        groups = self.groups
        rows = self.rdd.map(lambda e: (e[0].number * groups + e[1], bytearray(pickle.dumps((e[0], e[1], state(e))))))
        table = stored(self.spark.createDataFrame(rows, "place long, data binary"), "state")
        old, self.rdd = self.rdd, self._placed(table.rdd.map(lambda r: (r.place, bytes(r.data)))).map(pickle.loads).persist()
        old.unpersist()

    def best(self, partials, choose) -> list:
        """``choose`` of the sums over blocks of each group's partial histograms."""
        parts = self.rdd.map(partials)
        if self.count > 1:
            parts = parts.reduceByKey(_merged, self.groups)
        return [x for x in parts.map(lambda kv: choose(*kv[1])).collect() if len(x[0])]


def _collapsed(key: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return key, sums
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(sums, first, axis=0)


def _merged(a, b):
    key = np.concatenate((a[0], b[0]))
    order = np.argsort(key, kind="stable")
    return _collapsed(key[order], np.concatenate((a[1], b[1]))[order])


def histogram(x: np.ndarray, node: np.ndarray, tree: np.ndarray, row: np.ndarray, chosen: np.ndarray, stats, bins: int):
    """(key, sums) over entries (tree, row) at ``node`` (numbers of open nodes): key is
    (node * features + feature) * bins + bin for the features ``chosen`` of the node, and sums adds up
    ``stats(tree, row)``, a column per statistic."""
    features, rows = x.shape
    flat, width, parts = np.ascontiguousarray(x).ravel(), chosen.shape[1], None
    start = chosen * rows
    step = max(1, ENTRIES // width)
    for a in range(0, len(node), step):
        n, r = node[a : a + step], row[a : a + step]
        # places of chosen features, not features, in a key: the order is the same
        key = ((n * width)[:, None] + np.arange(width)) * bins
        key += flat[start[n] + r[:, None]]
        found = _added(key.ravel(), stats(tree[a : a + step], r), width, len(chosen) * width * bins)
        parts = found if parts is None else _merged(parts, found)
    at, place = parts[0] // bins, parts[0] % bins
    return (at // width * features + chosen[at // width, at % width]) * bins + place, parts[1]


def _added(key: np.ndarray, stats: np.ndarray, width: int, size: int):
    """Distinct keys (below ``size``) in order, with the sums of ``stats``, a row for ``width`` keys."""
    if size <= 8 * len(key) and np.abs(stats).sum(axis=0).max(initial=0) < 2**53:
        # doubles add whole numbers of this size exactly
        there = np.flatnonzero(np.bincount(key, minlength=size))
        return there, np.stack([np.bincount(key, np.repeat(c.astype(float), width), size)[there] for c in stats.T], axis=1).astype(np.int64)
    bits = len(key).bit_length()
    if size.bit_length() + bits < 64:
        packed = (key << bits) | np.arange(len(key))
        packed.sort()
        key, order = packed >> bits, packed & ((1 << bits) - 1)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    return _collapsed(key, stats[order // width])


def best_splits(key: np.ndarray, sums: np.ndarray, features: int, bins: int, gain):
    """Per open node with entries: node, feature (-1 without a split of positive gain), bin, gain, sums
    left of the split and of the whole node. Of equal gains the first feature, then the first bin."""
    if not len(key):
        return [np.zeros(0, np.int64)] * 6
    own = key // bins
    first = np.concatenate(([True], own[1:] != own[:-1]))
    start = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    to = np.cumsum(sums, axis=0)
    left = to - (to[start] - sums[start])[group]
    total = np.add.reduceat(sums, start, axis=0)[group]
    node = own // features
    g = gain(left, total - left, total, node)
    head = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    top = np.maximum.reduceat(g, head)
    at = np.flatnonzero(g == np.repeat(top, np.diff(np.append(head, len(node)))))
    at = at[np.unique(node[at], return_index=True)[1]]
    return node[at], np.where(g[at] > 0, own[at] % features, -1), key[at] % bins, g[at], left[at], total[at]


# --- boosted softmax trees


class Run(NamedTuple):
    """A boosted model: the weight column it learns with, its depth and its learning rate."""

    weight: int
    depth: int
    rate: float


class Settings(NamedTuple):
    """What the runs of a search share."""

    classes: int
    seed: int = 42
    rows: float = 0.8
    features: float = 0.8
    least_child: float = 1.0
    penalty: float = 1.0


def softmax_steps(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the weighted log loss per class, in units; margin is classes x rows."""
    p = np.exp(margin - margin.max(axis=0))
    p /= p.sum(axis=0)
    hot = np.arange(len(margin))[:, None] == y
    return np.rint(weight * (p - hot) * UNIT).astype(np.int64), np.rint(weight * 2 * p * (1 - p) * UNIT).astype(np.int64)


def boosted_gain(penalty: float, least: float):
    def gain(left, right, total, node):
        score = lambda s: (s[:, 0] / UNIT) ** 2 / (s[:, 1] / UNIT + penalty)
        # the root of rounding leaves no splits of less than 1e-6
        g = (score(left) + score(right) - score(total)) / 2
        return np.where((left[:, 1] >= least * UNIT) & (right[:, 1] >= least * UNIT) & (g > 1e-6), g, -np.inf)

    return gain


def tree_features(seed: int, round_: int, trees: np.ndarray, features: int, share: float) -> np.ndarray:
    """The features that each tree of a round may split on, in order."""
    width = max(1, int(share * features))
    draw = mixed(seed, round_, trees[:, None] * np.ones(features, np.int64), np.arange(features)[None, :] * np.ones((len(trees), 1), np.int64))
    return np.sort(np.argsort(draw, axis=1, kind="stable")[:, :width], axis=1)


def drawn_rows(seed: int, round_: int, ids: np.ndarray, share: float) -> np.ndarray:
    return fraction(seed, -1 - round_, ids) < share


def _advanced(element, runs: list[int], history: list, classes: int, to: int, token: str) -> np.ndarray:
    """Margins (runs x classes x rows) after ``to`` rounds: those that this worker has, or the element's
    own state, and the trees since."""
    block, g, state = element
    key = (token, block.number, g)
    done, margin = max(_margins.get(key, (-1, None)), state[:2], key=lambda v: v[0] if v[0] <= to else -1)
    margin = np.zeros((len(runs), classes, len(block.y))) if margin is None else margin
    if done < to:
        margin = margin.copy()
        number = np.array([r * classes + c for r in runs for c in range(classes)], np.int64)
        for sent in history:
            if sent.last > done:
                first, rounds = sent.trees.value
                for k, trees in enumerate(rounds):
                    if first + k == done < to:
                        margin += trees.value[trees.walk(block.x, number)].reshape(margin.shape)
                        done += 1
        _margins.pop(key, None)
        _margins[key] = (done, margin)
        while sum(m.nbytes for _, m in _margins.values()) > MARGIN_BYTES and len(_margins) > 1:
            _margins.pop(next(iter(_margins)))
    return margin


def _steps(block: Block, margin: np.ndarray, mine: list[int], runs: list[Run], s: Settings, round_: int):
    """Weights of the runs ``mine`` in a round (runs x rows), and gradients and Hessians of their trees."""
    weight = block.weights[[runs[r].weight for r in mine]] * drawn_rows(s.seed, round_, block.ids, s.rows) if mine else np.zeros((0, len(block.y)))
    steps = [softmax_steps(margin[j], block.y, weight[j]) for j in range(len(mine))]
    return weight, *(np.array([x[k] for x in steps]).reshape(-1, len(block.y)) for k in (0, 1))


class Level(NamedTuple):
    """Trees of a round as they grow: open nodes, sums by node, and the depth that each tree may have."""

    trees: Trees
    open: np.ndarray
    stats: np.ndarray
    depth: np.ndarray

    @staticmethod
    def first(depth: np.ndarray) -> Level:
        n = len(depth)
        return Level(Trees.roots(n), np.arange(n), np.zeros((n, 2), np.int64), depth)

    def grown(self, splits, gains: np.ndarray, classes: int) -> Level:
        """A level deeper; adds to ``gains`` by run and feature."""
        trees, stats, depth = self.trees, self.stats, self.depth
        node, feature, bin_, gain, left, total = splits
        node = self.open[node]
        stats[node] = total
        good = (feature >= 0) & (depth[trees.tree[node]] > trees.depth)
        np.add.at(gains, (trees.tree[node][good] // classes, feature[good]), gain[good])
        order = np.flatnonzero(good)[np.argsort(node[good])]
        if not len(order):
            return self._replace(open=np.zeros(0, np.int64))
        trees, new = trees.split(node[order], feature[order], bin_[order])
        stats = np.concatenate((stats, np.stack((left[order], total[order] - left[order]), axis=1).reshape(-1, 2)))
        # children at their depth don't split further
        return Level(trees, new[depth[trees.tree[new]] > trees.depth], stats, depth)

    def values(self, rate: np.ndarray, penalty: float) -> np.ndarray:
        return -rate[self.trees.tree] * (self.stats[:, 0] / UNIT) / (self.stats[:, 1] / UNIT + penalty)


def _sums(x: np.ndarray, features: np.ndarray, rows: np.ndarray, stats: list[list[np.ndarray]], bins: int) -> np.ndarray:
    """features x bins x statistics: sums over ``rows`` of a node. A statistic is given as doubles, or as two
    for its high and low bits, that add up exactly."""
    width, out = len(features), np.empty((len(features), bins, len(stats)), np.int64)
    if len(rows) * width <= FEW:
        key = (x.ravel().take(rows + features[:, None] * x.shape[1]) + (np.arange(width) * bins)[:, None]).ravel()
        for c, parts in enumerate(stats):
            out[:, :, c] = _joined([np.bincount(key, np.tile(p[rows], width), width * bins) for p in parts]).reshape(width, bins)
        return out
    own = [[p[rows] for p in parts] for parts in stats]
    for k, f in enumerate(features):
        key = x[f].take(rows).astype(np.intp)
        for c, parts in enumerate(own):
            out[k, :, c] = _joined([np.bincount(key, p, bins) for p in parts])
    return out


def _halves(stats: np.ndarray) -> list[np.ndarray]:
    """Doubles for ``_sums``: one where all sums are below 2**53, else two."""
    if np.abs(stats).sum() < 2**53:
        return [stats.astype(float)]
    return [(stats >> 32).astype(float), (stats & (2**32 - 1)).astype(float)]


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0].astype(np.int64) if len(parts) == 1 else (parts[0].astype(np.int64) << 32) + parts[1].astype(np.int64)


def _best_of(sums: np.ndarray, chosen: np.ndarray, gain):
    """``best_splits`` of nodes whose sums over all bins (nodes x features x bins x statistics) are at hand."""
    nodes, width, bins, _ = sums.shape
    to = np.cumsum(sums, axis=2)
    total = np.broadcast_to(to[:, :, -1:], to.shape).reshape(-1, 2)
    left = to.reshape(-1, 2)
    g = gain(left, total - left, total, None).reshape(nodes, -1)
    node, at = np.arange(nodes), g.argmax(axis=1)
    top = g[node, at]
    return node, np.where(top > 0, chosen[node, at // bins], -1), at % bins, top, to.reshape(nodes, -1, 2)[node, at], to[:, 0, -1]


def _round(block: Block, margin: np.ndarray, mine: list[int], runs: list[Run], s: Settings, round_: int, features: int, bins: int, gains: np.ndarray) -> np.ndarray:
    """The margins after one more round of the runs ``mine`` over the only block. Rows go along with their
    nodes, and of two children only the smaller one's sums are taken: the other's are what is left."""
    k, margin, dealt = s.classes, margin.copy(), {}
    gain, drawn = boosted_gain(s.penalty, s.least_child), drawn_rows(s.seed, round_, block.ids, s.rows)
    for j, r in enumerate(mine):
        run = runs[r]
        if run.weight not in dealt:
            weight = block.weights[run.weight] * drawn
            order = np.concatenate((np.flatnonzero(weight > 0), np.flatnonzero(~(weight > 0))))
            dealt[run.weight] = order, weight[order[: np.count_nonzero(weight > 0)]], block.x.take(order, axis=1)
        # rows that are learnt from come first
        order, weight, x = dealt[run.weight]
        n = len(weight)
        steps = softmax_steps(margin[j].take(order[:n], axis=1), block.y[order[:n]], weight)
        stats = [[_halves(v[c]) for v in steps] for c in range(k)]
        chosen = tree_features(s.seed, round_, r * k + np.arange(k), features, s.features)
        level = Level.first(np.full(k, run.depth))
        rows = {c: np.arange(len(order)) for c in range(k)}
        learnt = lambda node, rows=rows, n=n: rows[node][: np.searchsorted(rows[node], n)]
        sums = np.stack([_sums(x, chosen[c], learnt(c), stats[c], bins) for c in range(k)])
        while len(level.open):
            was = level.open
            level = level.grown(_best_of(sums, chosen[level.trees.tree[was]], gain), gains[j : j + 1], k)
            trees, place = level.trees, np.full(len(level.trees.tree), -1)
            place[level.open] = np.arange(len(level.open))
            found = np.empty((len(level.open), *sums.shape[1:]), np.int64)
            for p in np.flatnonzero(trees.feature[was] >= 0):
                own, left, c = rows.pop(was[p]), trees.left[was[p]], trees.tree[was[p]]
                right = x[trees.feature[was[p]]].take(own) > trees.bin[was[p]]
                rows[left], rows[left + 1] = own[~right], own[right]
                if place[left] >= 0:
                    few, many = sorted((left, left + 1), key=lambda v: len(learnt(v)))
                    found[place[few]] = _sums(x, chosen[c], learnt(few), stats[c], bins)
                    found[place[many]] = sums[p] - found[place[few]]
            sums = found
        value, step = level.values(np.full(k, run.rate), s.penalty), np.empty((k, len(order)))
        for node, own in rows.items():
            step[level.trees.tree[node], own] = value[node]
        margin[j][:, order] += step
    return margin


class Sent(NamedTuple):
    """A broadcast of the trees of some rounds, up to before round ``last``."""

    last: int
    trees: object


class Boosted:
    """Runs that grow together over dealt blocks."""

    def __init__(self, dealt: Dealt, runs: list[Run], settings: Settings, features: int, bins: int):
        self.dealt, self.runs, self.settings, self.features, self.bins = dealt, runs, settings, features, bins
        self.token, self.rounds, self.history = uuid.uuid4().hex, 0, []
        self.gains = np.zeros((len(runs), features))

    def _own(self):
        groups, runs = self.dealt.groups, len(self.runs)
        return lambda g: list(range(g, runs, groups))

    def grow_to(self, rounds: int) -> None:
        while self.rounds < rounds:
            if self.dealt.count == 1:
                self._grow_within(min(rounds, self.rounds + KEEP))
            else:
                self.grow()

    def _grow_within(self, to: int) -> None:
        """Rounds up to ``to`` in one job: each element is the only block, and has its own runs."""
        own, runs, s, features, bins = self._own(), self.runs, self.settings, self.features, self.bins

        def state(element):
            block, g, (done, margin, *_) = element
            mine = own(g)
            gains = np.zeros((len(mine), features))
            margin = np.zeros((len(mine), s.classes, len(block.y))) if margin is None else margin
            for t in range(done, to if mine else done):
                margin = _round(block, margin, mine, runs, s, t, features, bins, gains)
            return to, margin, gains

        self.dealt.settle(state)
        for g, gains in self.dealt.rdd.map(lambda e: (e[1], e[2][2])).collect():
            self.gains[own(g)] += gains
        self.rounds = to

    def grow(self) -> None:
        """One more round of every run."""
        s, sc, k = self.settings, self.dealt.spark.sparkContext, self.settings.classes
        level = Level.first(np.repeat([r.depth for r in self.runs], k))
        chosen_of = tree_features(s.seed, self.rounds, level.open, self.features, s.features)
        own, history, token, rounds, bins, features = self._own(), list(self.history), self.token, self.rounds, self.bins, self.features
        runs = self.runs
        while len(level.open):
            sent = sc.broadcast((level.trees, level.open))

            def partials(element, sent=sent):
                block, g, _ = element
                trees, open_ = sent.value
                mine = own(g)
                margin = _advanced(element, mine, history, k, rounds, token)
                number = np.array([r * k + c for r in mine for c in range(k)], np.int64)
                place = np.full(len(trees.tree), -1)
                place[open_] = np.arange(len(open_))
                at = place[trees.walk(block.x, number)] if len(number) else np.zeros((0, len(block.y)), np.int64)
                weight, grad, hess = _steps(block, margin, mine, runs, s, rounds)
                tree, row = np.nonzero((at >= 0) & np.repeat(weight > 0, k, axis=0))
                found = histogram(block.x, at[tree, row], tree, row, chosen_of[trees.tree[open_]], lambda t, r: np.stack((grad[t, r], hess[t, r]), axis=1), bins) if len(tree) else None
                return g, found or (np.zeros(0, np.int64), np.zeros((0, 2), np.int64))

            splits = self.dealt.best(partials, partial(_choose_boosted, features, bins, s))
            sent.unpersist()
            if not splits:
                break
            level = level.grown([np.concatenate(c) for c in zip(*splits, strict=True)], self.gains, k)
        value = level.values(np.repeat([r.rate for r in self.runs], k), s.penalty)
        self.rounds += 1
        self.history.append(Sent(self.rounds, sc.broadcast((self.rounds - 1, [level.trees._replace(value=value)]))))
        if self.rounds % KEEP == 0:
            own, history, token, rounds = self._own(), list(self.history), self.token, self.rounds
            self.dealt.settle(lambda e: (rounds, _advanced(e, own(e[1]), history, k, rounds, token)))
            for sent in history:
                sent.trees.unpersist()
            self.history = []

    def probabilities(self, name) -> DataFrame:
        """candidate (``name`` of a run's number), sample_id, p of every row, as of now; stored."""
        own, history, token, rounds, k = self._own(), list(self.history), self.token, self.rounds, self.settings.classes
        names = [name(r) for r in range(len(self.runs))]

        def rows(element):
            block, g, _ = element
            mine = own(g)
            margin = _advanced(element, mine, history, k, rounds, token)
            e = np.exp(margin - margin.max(axis=1, keepdims=True)) if mine else margin
            p = e / e.sum(axis=1, keepdims=True) if mine else e
            return [(names[r], int(i), v) for j, r in enumerate(mine) for i, v in zip(block.ids, p[j].T.tolist(), strict=True)]

        spark = self.dealt.spark
        return stored(spark.createDataFrame(self.dealt.rdd.flatMap(rows), "candidate string, sample_id long, p array<double>"), "scored")


def _choose_boosted(features: int, bins: int, s: Settings, key, sums):
    return best_splits(key, sums, features, bins, boosted_gain(s.penalty, s.least_child))


# --- random forests


class Kind(NamedTuple):
    """A forest's limits: rows of a node that is split, and of a child."""

    least_split: int = 2
    least_leaf: int = 1


def poisson_times(seed: int, tree: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """How often a tree's bootstrap draws each row: Poisson with mean 1."""
    steps = np.cumsum(np.exp(-1) / np.cumprod(np.concatenate(([1.0], np.arange(1.0, 16.0)))))
    return np.searchsorted(steps, fraction(seed, tree, ids), side="right")


def node_features(seed: int, tree: np.ndarray, path: np.ndarray, features: int, width: int) -> np.ndarray:
    draw = np.stack([mixed(seed, tree, path, np.full(len(tree), f)) for f in range(features)], axis=1)
    return np.sort(np.argsort(draw, axis=1, kind="stable")[:, :width], axis=1)


def gini_gain(weight: np.ndarray, kinds: list[Kind], kind_of: np.ndarray):
    """Decrease of the weighted Gini impurity, times weights; ``kind_of`` is by open node."""
    least_split, least_leaf = (np.array([k[i] for k in kinds]) for i in (0, 1))

    def gain(left, right, total, node):
        score = lambda s: ((s * weight) ** 2).sum(axis=1) / np.maximum((s * weight).sum(axis=1), 1e-300)
        n, a, b = total.sum(axis=1), left.sum(axis=1), right.sum(axis=1)
        k = kind_of[node]
        g = score(left) + score(right) - score(total)
        return np.where((n >= least_split[k]) & (np.minimum(a, b) >= np.maximum(least_leaf[k], 1)) & (g > 1e-9), g, -np.inf)

    return gain


class Forest(NamedTuple):
    trees: Trees  # tree t is tree t % size of kind t // size
    size: int
    level: np.ndarray
    counts: np.ndarray  # by node and class
    gain: np.ndarray
    class_weight: np.ndarray

    def shares(self) -> np.ndarray:
        w = self.counts * self.class_weight
        return w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300)

    def importances(self, kind: int, first: int, depth: int, features: int) -> np.ndarray:
        """Mean over the first trees of each feature's share of the decrease of impurity."""
        t = self.trees
        own = (t.feature >= 0) & (t.tree // self.size == kind) & (t.tree % self.size < first) & (self.level < depth)
        per_tree = np.zeros((first, features))
        np.add.at(per_tree, (t.tree[own] % self.size, t.feature[own]), self.gain[own])
        sums = per_tree.sum(axis=1, keepdims=True)
        return np.divide(per_tree, sums, out=np.zeros_like(per_tree), where=sums > 0).mean(axis=0)


def grow_forest(dealt: Dealt, kinds: list[Kind], size: int, depth: int, class_weight: list[float], features: int, bins: int, width: int | None = None, seed: int = 42, number: np.ndarray | None = None) -> Forest:
    """``size`` trees of every kind, to ``depth``; with ``number``, only those of them. Nodes choose among
    ``width`` features (the root of their number by default)."""
    k, weight = len(class_weight), np.array(class_weight)
    width = width or max(1, int(np.sqrt(features)))
    number = np.arange(len(kinds) * size) if number is None else number
    trees, open_ = Trees.roots(len(number)), np.arange(len(number))
    counts, gains, level = np.zeros((len(open_), k), np.int64), np.zeros(len(open_)), np.zeros(len(open_), np.int32)
    groups, sc = dealt.groups, dealt.spark.sparkContext
    while len(open_):
        sent = sc.broadcast((trees, open_))

        def partials(element, sent=sent):
            block, g, _ = element
            trees, open_ = sent.value
            place = np.full(len(trees.tree), -1)
            place[open_] = np.arange(len(open_))
            mine = np.flatnonzero(trees.tree[open_] % groups == g)
            chosen = np.zeros((len(open_), width), np.int64)
            chosen[mine] = node_features(seed, number[trees.tree[open_[mine]]], trees.path[open_[mine]], features, width)
            own, parts = np.unique(trees.tree[open_[mine]]), None
            trained = np.flatnonzero(block.weights[0] > 0)
            x, y, ids = block.x[:, trained], block.y[trained], block.ids[trained]
            step = max(1, ENTRIES // max(1, len(y) * width))
            for a in range(0, len(own), step):
                some = own[a : a + step]
                at = place[trees.walk(x, some)]
                times = poisson_times(seed, number[some][:, None] + np.zeros(len(y), np.int64), ids + np.zeros((len(some), 1), np.int64))
                tree, row = np.nonzero((at >= 0) & (times > 0))
                if len(tree):
                    hot = lambda t, r, times=times: (np.arange(k) == y[r, None]) * times[t, r, None]
                    found = histogram(x, at[tree, row], tree, row, chosen, hot, bins)
                    parts = found if parts is None else _merged(parts, found)
            return g, parts or (np.zeros(0, np.int64), np.zeros((0, k), np.int64))

        gain = gini_gain(weight, kinds, number[trees.tree[open_]] // size)
        splits = dealt.best(partials, lambda key, sums, gain=gain: best_splits(key, sums, features, bins, gain))
        sent.unpersist()
        if not splits:
            break
        node, feature, bin_, gain_, left, total = (np.concatenate(c) for c in zip(*splits, strict=True))
        node = open_[node]
        counts[node] = total
        good = np.flatnonzero((feature >= 0) & (trees.depth < depth))
        order = good[np.argsort(node[good])]
        if not len(order):
            break
        gains[node[order]] = gain_[order]
        trees, open_ = trees.split(node[order], feature[order], bin_[order])
        counts = np.concatenate((counts, np.stack((left[order], total[order] - left[order]), axis=1).reshape(-1, k)))
        gains, level = np.concatenate((gains, np.zeros(len(open_)))), np.concatenate((level, np.full(len(open_), trees.depth, np.int32)))
        # a pure or small child has nothing to split
        n = counts[open_]
        least = np.array([x.least_split for x in kinds])[number[trees.tree[open_]] // size]
        open_ = open_[((n > 0).sum(axis=1) > 1) & (n.sum(axis=1) >= least)]
    return Forest(trees, size, level, counts, gains, weight)


def forest_probabilities(dealt: Dealt, forest: Forest, kinds: int, firsts: list[int], depths: list[int], name) -> DataFrame:
    """candidate (``name`` of kind, number of first trees and depth), sample_id, p; stored."""
    sent = dealt.spark.sparkContext.broadcast((forest.trees, forest.shares()))
    size, groups, firsts = forest.size, dealt.groups, sorted(firsts)
    jobs = list(product(range(kinds), depths))

    def rows(element):
        block, g, _ = element
        trees, value = sent.value
        out = []
        step = max(1, ENTRIES // max(1, len(block.y) * value.shape[1]))
        for kind, depth in jobs[g::groups]:
            total, at = np.zeros((len(block.y), value.shape[1])), 0
            for first in firsts:
                while at < first:
                    stop = min(first, at + step)
                    total += value[trees.walk(block.x, kind * size + np.arange(at, stop), depth)].sum(axis=0)
                    at = stop
                out += [(name(kind, first, depth), int(i), v) for i, v in zip(block.ids, (total / first).tolist(), strict=True)]
        return out

    return stored(dealt.spark.createDataFrame(dealt.rdd.flatMap(rows), "candidate string, sample_id long, p array<double>"), "scored")


def _cuts(x: np.ndarray, y: np.ndarray, ids: np.ndarray, wanted: np.ndarray, number: np.ndarray, size: int, kinds: list[Kind], depths: list[int], weight: np.ndarray, bins: int, width: int, seed: int):
    """Grows the trees ``number`` over the only block; (place in ``depths``, class shares of the ``wanted``
    rows by every tree cut there), in units of 2**-40."""
    features, k, count = len(x), len(weight), len(number)
    trees, open_, counts = Trees.roots(count), np.arange(count), np.zeros((count, k), np.int64)
    times = poisson_times(seed, number[:, None] + np.zeros(len(y), np.int64), ids + np.zeros((count, 1), np.int64))
    tree, row = np.nonzero(times)
    times, node, at = times[tree, row], tree, np.repeat(np.arange(count)[:, None], wanted.shape[1], axis=1)
    every = np.broadcast_to(np.arange(wanted.shape[1]), at.shape)

    def shares():
        w = counts * weight
        return np.rint(w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300) * SHARE).astype(np.int64)[at]

    for depth in range(max(depths) + 1):
        place = np.full(len(trees.tree), -1)
        place[open_] = np.arange(len(open_))
        own = place[node]
        keep = own >= 0
        own, tree, row, times, node = own[keep], tree[keep], row[keep], times[keep], node[keep]
        order = good = np.zeros(0, np.int64)
        # the last level's nodes aren't split; only a root's counts are still to be taken
        if len(own) and (depth < max(depths) or not depth):
            chosen = node_features(seed, number[trees.tree[open_]], trees.path[open_], features, width)
            left_out = lambda e, r, times=times: (np.arange(k) == y[r, None]) * times[e, None]
            key, sums = histogram(x, own, np.arange(len(own)), row, chosen, left_out, bins)
            found, feature, bin_, _, left, total = best_splits(key, sums, features, bins, gini_gain(weight, kinds, number[trees.tree[open_]] // size))
            found = open_[found]
            counts[found] = total
            good = np.flatnonzero((feature >= 0) & (depth < max(depths)))
            order = good[np.argsort(found[good])]
        if depth in depths:
            yield depths.index(depth), shares()
        if not len(order):
            for d in depths:
                if d > depth:
                    yield depths.index(d), shares()
            return
        trees, new = trees.split(found[order], feature[order], bin_[order])
        counts = np.concatenate((counts, np.stack((left[order], total[order] - left[order]), axis=1).reshape(-1, k)))
        for nodes, columns, rows in ((node, x, row), (at, wanted, every)):
            f = trees.feature[nodes]
            split = f >= 0
            was = nodes[split]
            nodes[split] = trees.left[was] + (columns[f[split], rows[split]] > trees.bin[was])
        n = counts[new]
        least = np.array([v.least_split for v in kinds])[number[trees.tree[new]] // size]
        open_ = new[((n > 0).sum(axis=1) > 1) & (n.sum(axis=1) >= least)]


def _more(a, b):
    """Votes (ids, sums by segment of the firsts) of the same rows, added up."""
    return a[0], {s: a[1].get(s, 0) + b[1].get(s, 0) for s in {**a[1], **b[1]}}


def forest_votes(rows: DataFrame, names: list[str], class_weight: list[float], trained: str, wanted: str, firsts: list[int], depths: list[int], kinds: list[Kind], seed: int = 42) -> DataFrame:
    """The predictions of ``forest_scores``. Trees grow a few at a time, what they say of the ``wanted`` rows is
    added up, and they are dropped. Over one block a task does so by itself; over several, which grow a level of
    trees by a job, a batch of trees is all that tasks and the driver hold."""
    edges = binned(rows, names)
    flag = lambda condition: F.when(F.expr(condition), 1.0).otherwise(0.0)
    table, count = blocks(rows.withColumns({"__trained": flag(trained), "__wanted": flag(wanted)}), names, edges, "true", ["__trained", "__wanted"], FORESTS)
    firsts, depths, size, weight = sorted(firsts), sorted(depths), max(firsts), np.array(class_weight)
    dealt = Dealt(table, count, len(kinds) * size)
    groups, bins, width = dealt.groups, max(map(len, edges)) + 1, max(1, int(np.sqrt(len(names))))

    def votes(element):
        block, g, _ = element
        own, told = np.flatnonzero(block.weights[0] > 0), np.flatnonzero(block.weights[1] > 0)
        x, y, ids = np.ascontiguousarray(block.x[:, own]), block.y[own], block.ids[own]
        out = np.zeros((len(kinds), len(depths), len(firsts), len(told), len(weight)), np.int64)
        number, step = np.arange(g, len(kinds) * size, groups), max(1, ENTRIES // max(1, len(y) * width))
        for a in range(0, len(number), step):
            some = number[a : a + step]
            for d, shares in _cuts(x, y, ids, block.x[:, told], some, size, kinds, depths, weight, bins, width, seed):
                for t, v in zip(some.tolist(), shares, strict=True):
                    out[t // size, d, np.searchsorted(firsts, t % size, side="right")] += v
        for k, d in product(range(len(kinds)), range(len(depths))):
            yield (0, k, d), (block.ids[told], dict(enumerate(out[k, d])))

    def told(item):
        (_, k, d), (ids, sums) = item
        total = np.zeros((len(ids), len(weight)), np.int64)
        for s, n in enumerate(firsts):
            total += sums.get(s, 0)
            name = f"{n}|{depths[d]}|{kinds[k].least_split}|{kinds[k].least_leaf}"
            yield from ((name, int(i), v) for i, v in zip(ids, (total / (n * SHARE)).tolist(), strict=True))

    found = dealt.rdd.flatMap(votes) if count == 1 else _batched_votes(dealt, kinds, size, firsts, depths, class_weight, len(names), bins, width, seed)
    added = found.reduceByKey(_more, count * len(kinds) * len(depths)).flatMap(told)
    scored = stored(dealt.spark.createDataFrame(added, "candidate string, sample_id long, p array<double>"), "scored")
    dealt.rdd.unpersist()
    return with_truth(scored, rows.where(wanted))


def _batched_votes(dealt: Dealt, kinds: list[Kind], size: int, firsts: list[int], depths: list[int], class_weight: list[float], features: int, bins: int, width: int, seed: int):
    """((block, kind, place in ``depths``), votes) of batches of trees, which are written as they are told."""
    groups, sc, parts = dealt.groups, dealt.spark.sparkContext, []
    batch = groups * max(1, ENTRIES // (FORESTS * ROWS * width))
    for a in range(0, len(kinds) * size, batch):
        number = np.arange(a, min(a + batch, len(kinds) * size))
        forest = grow_forest(dealt, kinds, size, max(depths), class_weight, features, bins, width, seed, number)
        sent = sc.broadcast((forest.trees, np.rint(forest.shares() * SHARE).astype(np.int64)))

        def votes(element, sent=sent, number=number):
            block, g, _ = element
            trees, shares = sent.value
            told, out = np.flatnonzero(block.weights[1] > 0), {}
            x = block.x[:, told]
            for t, d in product(range(g, len(number), groups), range(len(depths))):
                sums = out.setdefault((block.number, int(number[t]) // size, d), (block.ids[told], {}))[1]
                s = int(np.searchsorted(firsts, number[t] % size, side="right"))
                sums[s] = sums.get(s, 0) + shares[trees.walk(x, np.array([t]), depths[d])[0]]
            return list(out.items())

        added = dealt.rdd.flatMap(votes).reduceByKey(_more, dealt.count * groups).map(lambda kv: (bytearray(pickle.dumps(kv)),))
        parts.append(stored(dealt.spark.createDataFrame(added, "data binary"), "votes"))
        sent.unpersist()
    return sc.union([part.rdd.map(lambda r: pickle.loads(bytes(r.data))) for part in parts])


# --- searches


def with_truth(scored: DataFrame, rows: DataFrame) -> DataFrame:
    return scored.join(rows.select(*METADATA, F.col("y").cast("int").alias("true_idx")), "sample_id")


def boosted_scores(rows: DataFrame, names: list[str], weights: list[str], trained: str, wanted: str, rounds: list[int], runs: list[Run], settings: Settings, edges: list[list[float]] | None = None) -> tuple[DataFrame, Boosted]:
    """Predictions of the ``wanted`` rows by candidate ``weight|rounds|depth|rate``, for every run at
    every number of rounds; models learn from rows where ``trained`` holds."""
    edges = edges or binned(rows, names)
    table, count = blocks(rows, names, edges, trained, weights, BOOSTED)
    model = Boosted(Dealt(table, count, len(runs)), runs, settings, len(names), max(map(len, edges)) + 1)
    truth, parts = rows.where(wanted), None
    for n in sorted(set(rounds)):
        model.grow_to(n)
        part = with_truth(model.probabilities(lambda r, n=n: f"{weights[runs[r].weight]}|{n}|{runs[r].depth}|{runs[r].rate:g}"), truth)
        parts = part if parts is None else parts.unionByName(part)
    model.dealt.rdd.unpersist()
    return parts, model


def forest_scores(rows: DataFrame, names: list[str], class_weight: list[float], trained: str, wanted: str, firsts: list[int], depths: list[int], kinds: list[Kind], seed: int = 42) -> tuple[DataFrame, Forest]:
    """Predictions of the ``wanted`` rows by candidate ``trees|depth|split|leaf``."""
    edges = binned(rows, names)
    table, count = blocks(rows.withColumn("__one", F.lit(1.0)), names, edges, trained, ["__one"])
    dealt = Dealt(table, count, max(firsts))
    forest = grow_forest(dealt, kinds, max(firsts), max(depths), class_weight, len(names), max(map(len, edges)) + 1, seed=seed)
    scored = forest_probabilities(dealt, forest, len(kinds), firsts, depths, lambda k, n, d: f"{n}|{d}|{kinds[k].least_split}|{kinds[k].least_leaf}")
    dealt.rdd.unpersist()
    return with_truth(scored, rows.where(wanted)), forest
