"""Group bootstrap by hash draws: draw k of resample b picks group md5(seed:b:k) mod groups.

A resample is a table of multiplicities. Groups' confusion cells and loss sums are weighted by
them, so the work is resamples times groups, whatever the number of rows; AUC needs the distinct
scores of pairs of groups besides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import HEADLINE, argmax, auc, fill_cells, headline, long_metrics, nll, one_vs_rest, per_class
from .ordering import numbered, ranged, stored


#: Groups whose rows of the matrix of ordered pairs one task holds.
SLAB = 512


def multiplicities(groups: DataFrame, group: str, resamples: int, seed: int) -> DataFrame:
    """b, group, times: how often each resample drew each group. Draws are rows of a range, made in
    as many tasks as there are cores and counted before the shuffle."""
    spark = groups.sparkSession
    numbers = stored(numbered(groups.select(group).distinct(), "group_no", F.col(group)))
    n = numbers.count()
    draw = spark.range(resamples * n).select(F.floor(F.col("id") / F.lit(max(n, 1))).cast("int").alias("b"), (F.col("id") % F.lit(max(n, 1))).alias("k"))
    text = F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("k").cast("string"))
    g = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % F.lit(max(n, 1)) + 1
    return draw.groupBy("b", g.alias("group_no")).agg(F.count("*").alias("times")).join(numbers, "group_no").select("b", group, "times")


def resampled(rows: DataFrame, draws: DataFrame, keys: list[str], group: str, classes: int, with_auc: bool = False) -> DataFrame:
    """keys, b, metric, value: threshold metrics, the F1 of every class, and log loss. With AUC, the
    rows of every resample are ranked, at a cost of rows times resamples; ``resampled_auc`` gives
    the same for pairs of groups."""
    own = [*keys, "b"]
    cells = rows.groupBy(*keys, group, "true_idx", argmax(F.col("p")).alias("pred_idx")).agg(F.count("*").alias("c"))
    weighted = cells.join(draws, group).groupBy(*own, "true_idx", "pred_idx").agg(F.sum(F.col("c") * F.col("times")).alias("n"))
    base = headline(per_class(fill_cells(weighted, own, classes), own), own, classes, each_f1=True)
    # losses are added as decimals, so that equal rows give equal bits whatever the order
    loss = rows.groupBy(*keys, group).agg(F.sum(nll(F.col("p"), F.col("true_idx")).cast("decimal(38,18)")).cast("double").alias("loss"), F.count("*").alias("c"))
    weighted_loss = F.sum((F.col("loss") * F.col("times")).cast("decimal(38,15)")).cast("double")
    loss = loss.join(draws, group).groupBy(*own).agg((weighted_loss / F.sum(F.col("c") * F.col("times"))).alias("log_loss"))
    wide, names = base.join(loss, own), (*HEADLINE, *class_f1(classes), "log_loss")
    if with_auc:
        spread = rows.join(draws, group)
        area = auc(one_vs_rest(spread, own, F.col("times")), own)
        wide = wide.join(area.groupBy(*own).agg(F.avg("auc").alias("macro_auc")), own)
        names = (*names, "macro_auc")
    return long_metrics(wide, own, names)


def class_f1(classes: int) -> tuple[str, ...]:
    return tuple(f"f1_{k}" for k in range(classes))


def _wins(pos: np.ndarray, neg: np.ndarray, score: np.ndarray, group: np.ndarray, groups: int, step: int) -> np.ndarray:
    """groups x groups: positives of one group above negatives of another, ties as halves. Rows are dealt
    with in steps of the score order: pairs within a step are compared, those with earlier steps are an
    outer product of the groups' sums."""
    order = np.argsort(score, kind="stable")
    pos, neg, score, group = pos[order], neg[order], score[order], group[order]
    out, below = np.zeros((groups, groups)), np.zeros(groups)
    a = 0
    while a < len(score):
        b = min(len(score), a + step)
        b = int(np.searchsorted(score, score[b - 1], side="right")) if b - a <= step else b  # ties stay together
        s, g = score[a:b], group[a:b]
        p, n = pos[a:b], neg[a:b]
        out += np.outer(np.bincount(g, p, groups), below)
        hold, lose = np.flatnonzero(p), np.flatnonzero(n)
        losers = np.zeros((len(lose), groups))
        losers[np.arange(len(lose)), g[lose]] = n[lose]
        for c in range(0, len(hold), step):
            h = hold[c : c + step]
            beats = (s[h][:, None] > s[lose]) + (s[h][:, None] == s[lose]) / 2
            holders = np.zeros((len(h), groups))
            holders[np.arange(len(h)), g[h]] = p[h]
            out += holders.T @ (beats @ losers)
        below += np.bincount(g, n, groups)
        a = b
    return out


def ordered_pairs(rows: DataFrame, keys: list[str], group: str) -> DataFrame:
    """keys, class, g, h, pairs: how many positives of group g lie above negatives of group h, ties as
    halves; only pairs of groups that have any.

    Scores are dealt over tasks by ranges. A range counts its own pairs from matrices of its groups; pairs
    across ranges come from the groups' sums per range, ``SLAB`` groups at a time: so no row is joined
    with a table of groups, and a task holds at most ``SLAB`` rows of the matrix or the groups of a range."""
    own = [*keys, "class"]
    scored = one_vs_rest(rows.withColumn("__group", F.col(group)), [*keys, "__group"])
    parts = ranged(scored, *own, "score")
    types = dict(parts.dtypes)
    ddl = ", ".join(f"`{k}` {types[k]}" for k in own) + f", g {types['__group']}, h {types['__group']}, pairs double"

    def sparse(first: pd.DataFrame, matrix: np.ndarray, left, right) -> pd.DataFrame:
        a, b = np.nonzero(matrix)
        return pd.DataFrame({**{k: np.full(len(a), first[k].iloc[0]) for k in own}, "g": np.asarray(left)[a], "h": np.asarray(right)[b], "pairs": matrix[a, b]})

    def within(table: pd.DataFrame) -> pd.DataFrame:
        names, number = np.unique(table["__group"].to_numpy(), return_inverse=True)
        won = _wins(table.pos.to_numpy(float), table.neg.to_numpy(float), table.score.to_numpy(float), number, len(names), max(256, min(len(names), 2048)))
        return sparse(table, won, names, names)

    def across(table: pd.DataFrame) -> pd.DataFrame:
        names, number = np.unique(table["__group"].to_numpy(), return_inverse=True)
        ranges, at = np.unique(table["__part"].to_numpy(), return_inverse=True)
        mine = table.mine.to_numpy(bool)
        left = np.unique(number[mine])
        pos, neg = np.zeros((len(left), len(ranges))), np.zeros((len(ranges), len(names)))
        np.add.at(pos, (np.searchsorted(left, number[mine]), at[mine]), table.pos.to_numpy(float)[mine])
        np.add.at(neg, (at, number), table.neg.to_numpy(float))
        before = np.cumsum(neg, axis=0) - neg
        return sparse(table, pos @ before, names[left], names)

    sums = stored(parts.groupBy(*own, "__part", "__group").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "sums")
    slabs = sums.select("__group").distinct().count() // SLAB + 1
    slab = F.pmod(F.xxhash64("__group"), F.lit(slabs)).cast("int")
    spread = sums.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1)))).withColumn("mine", F.col("slab") == slab)
    inner = parts.select(*own, "__part", "__group", "score", "pos", "neg").groupBy(*own, "__part").applyInPandas(within, ddl)
    outer = spread.groupBy(*own, "slab").applyInPandas(across, ddl)
    return inner.unionByName(outer).groupBy(*own, "g", "h").agg(F.sum("pairs").alias("pairs"))


def resampled_auc(rows: DataFrame, draws: DataFrame, keys: list[str], group: str) -> DataFrame:
    """keys, b, metric (macro_auc), value, as ``resampled`` has it. Ordered pairs are counted once per pair
    of groups; a resample weighs the counts by both groups' multiplicities."""
    own = [*keys, "class"]
    ordered = ordered_pairs(rows, keys, group)
    one = draws.select("b", F.col(group).alias("g"), F.col("times").alias("times_g"))
    two = draws.select("b", F.col(group).alias("h"), F.col("times").alias("times_h"))
    won = ordered.join(one, "g").join(two, ["b", "h"]).groupBy(*own, "b").agg(F.sum(F.col("pairs") * F.col("times_g") * F.col("times_h")).alias("won"))
    spread = rows.select(*keys, F.col(group).alias("g"), "true_idx", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("class"))
    hit = F.col("true_idx") == F.col("class")
    sizes = spread.groupBy(*own, "g").agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))
    total = sizes.join(one, "g").groupBy(*own, "b").agg(F.sum(F.col("pos") * F.col("times_g")).alias("n_pos"), F.sum(F.col("neg") * F.col("times_g")).alias("n_neg"))
    area = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.coalesce("won", F.lit(0)) / (F.col("n_pos") * F.col("n_neg")))
    each = total.join(won, [*own, "b"], "left").select(*own, "b", area.alias("auc"))
    return long_metrics(each.groupBy(*keys, "b").agg(F.avg("auc").alias("macro_auc")), [*keys, "b"], ("macro_auc",))


#: Differences up to this count as none.
TOLERANCE = 1e-12


def interval(values: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """keys, low, high, n_valid: percentiles over resamples; undefined values are left out."""
    bounds = F.percentile("value", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return values.groupBy(*keys).agg(bounds.alias("q"), F.count("value").alias("n_valid")).select(*keys, F.element_at("q", 1).alias("low"), F.element_at("q", 2).alias("high"), "n_valid")


def paired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, b, metric, value: metric of a minus metric of b on identical resamples."""
    on = [*keys, "b", "metric"]
    return a.join(b.withColumnRenamed("value", "other"), on).select(*on, (F.col("value") - F.col("other")).alias("value"))
