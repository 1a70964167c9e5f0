"""Comparison of models over seeds, registration and readiness checks, and candidate choice."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import argmax, confusion, per_class
from .ordering import numbered, quantiles, ranged, value_ranks, with_earlier
from .resample import TOLERANCE, interval


def prediction_table(rows: DataFrame, names: list[str]) -> DataFrame:
    """Predictions with the predicted class, names, one probability column per class and a flag."""
    pred = argmax(F.col("p"))
    named = F.array(*[F.lit(n) for n in names])
    probs = [F.col("p")[k].alias(f"prob_{n}") for k, n in enumerate(names)]
    return rows.select(*[c for c in rows.columns if c != "p"], pred.alias("pred_idx"), F.element_at(named, F.col("true_idx") + 1).alias("true_name"), *probs, (pred == F.col("true_idx")).alias("correct"))


def strata_report(rows: DataFrame, keys: list[str], classes: int) -> DataFrame:
    by_class = per_class(confusion(rows, keys, classes), keys)
    recalls = [F.max(F.when(F.col("class") == k, F.col("recall"))).alias(f"recall_{k}") for k in range(classes)]
    return by_class.groupBy(*keys).agg(F.sum("support").alias("n"), (F.sum("hits") / F.sum("support")).alias("accuracy"), (F.sum("f1") / classes).alias("macro_f1"), *recalls)


def size_edges(train: DataFrame) -> DataFrame:
    """Tertile edges, linear between ranks, of the training rows."""
    rows = train.select(F.lit("all").alias("of"), "size")
    edges = quantiles(rows, ["of"], "size", {"low": 1 / 3, "high": 2 / 3, "least": 0.0, "most": 1.0})
    return edges.select("low", "high", "n", "least", "most")


def weighted_cross_entropy(rows: DataFrame, keys: list[str], weights: list[float], floor: float = 1e-12) -> DataFrame:
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.col("true_idx") + 1)
    loss = -F.ln(F.greatest(F.element_at("p", F.col("true_idx") + 1), F.lit(floor)))
    return rows.groupBy(*keys).agg((F.sum(w * loss) / F.sum(w)).alias("loss"))


def metric_delta(long: DataFrame, a: str, b: str) -> DataFrame:
    part = lambda m, name: long.where(F.col("model") == m).select("seed", "metric", F.col("value").alias(name))
    return part(a, "a").join(part(b, "b"), ["seed", "metric"]).withColumn("delta", F.col("b") - F.col("a"))


def all_pairs(long: DataFrame) -> DataFrame:
    other = long.select(F.col("model").alias("other"), "seed", "metric", F.col("value").alias("v2"))
    both = long.join(other, ["seed", "metric"]).where("model < other")
    return both.groupBy("model", "other", "metric").agg(F.avg("value").alias("mean"), F.avg("v2").alias("other_mean"), (F.avg("value") - F.avg("v2")).alias("gap"))


def seed_average(rows: DataFrame, classes: int) -> DataFrame:
    """Mean probabilities per (model, sample) over seeds."""
    means = [F.avg(F.col("p")[k]).alias(f"m{k}") for k in range(classes)]
    return rows.groupBy("model", "sample_id", "true_idx").agg(*means).select("model", "sample_id", "true_idx", F.array(*[f"m{k}" for k in range(classes)]).alias("p"))


def seed_spread(long: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, sample standard deviation (0 for one seed, null for none) and number of values."""
    n = F.count("value")
    std = F.when(n == 1, 0.0).when(n > 1, F.stddev_samp("value"))
    return long.groupBy(*keys).agg(F.avg("value").alias("mean"), std.alias("std"), n.alias("n"))


def report_table(long: DataFrame, keys: list[str], metrics) -> DataFrame:
    """One row per key, <metric>_mean and <metric>_std columns."""
    columns = []
    for m in metrics:
        value = F.when(F.col("metric") == m, F.col("value"))
        columns += [F.avg(value).alias(f"{m}_mean"), F.stddev_samp(value).alias(f"{m}_std")]
    return long.groupBy(*keys).agg(*columns)


def paired_intervals(means: DataFrame, baseline: str) -> DataFrame:
    """pair, metric, ci_low, ci_high, frac_a_greater, n_valid over resamples (model, b, metric,
    value): every pair of models, and every model against the baseline."""
    other = means.select(F.col("model").alias("other"), "b", "metric", F.col("value").alias("less"))
    both = means.join(other, ["b", "metric"]).where((F.col("model") != baseline) & ((F.col("other") == baseline) | (F.col("model") < F.col("other"))))
    gaps = both.select(F.concat(F.col("model"), F.lit("_vs_"), F.col("other")).alias("pair"), "b", "metric", (F.col("value") - F.col("less")).alias("value"))
    bounds = interval(gaps, ["pair", "metric"]).select("pair", "metric", F.col("low").alias("ci_low"), F.col("high").alias("ci_high"), "n_valid")
    greater = gaps.groupBy("pair", "metric").agg(F.avg((F.col("value") > TOLERANCE).cast("double")).alias("frac_a_greater"))
    return bounds.join(greater, ["pair", "metric"])


def latency_summary(timings: DataFrame, key: str) -> DataFrame:
    """Median, and the value at sorted index round(0.9 * (n - 1)), by places instead of a list."""
    ranks = value_ranks(timings, [key], "ms")
    at = F.bround(F.lit(0.9) * (F.col("n") - 1), 0)
    take = lambda k: F.max(F.when((F.col("low") <= k) & (k <= F.col("high")), F.col("ms")))
    middle = F.lit(0.5) * (F.col("n") - 1)
    return ranks.groupBy(key).agg(F.max("n").alias("n"), ((take(F.floor(middle)) + take(F.ceil(middle))) / 2).alias("median"), take(at).alias("p90"))


def bars(mean: DataFrame, bounds: DataFrame) -> DataFrame:
    """Means with distances to their bounds, 0 where there are none."""
    joined = mean.join(bounds, ["model", "metric"], "left")
    zero = F.lit(0.0)
    return joined.select("model", "metric", "mean", F.coalesce(F.col("mean") - F.col("low"), zero).alias("below"), F.coalesce(F.col("high") - F.col("mean"), zero).alias("above"))


def registration_status(found: DataFrame, registered: DataFrame, keys: list[str]) -> DataFrame:
    status = F.when(F.col("registered").isNull(), "unregistered").when(F.col("registered") != F.col("digest"), "mismatch").otherwise("ok")
    return found.join(registered, keys, "left").select(*keys, status.alias("status"))


def readiness(study: DataFrame, found: DataFrame, seeds: list[int]) -> DataFrame:
    """Every study model with whether its seeds are the expected ones, and whether all are ready."""
    ready = F.coalesce(F.col("seeds") == F.array(*[F.lit(s) for s in seeds]), F.lit(False))
    rows = study.join(found, "model", "left").select("model", ready.alias("ready"))
    return rows.crossJoin(F.broadcast(rows.agg(F.bool_and("ready").alias("all_ready"))))


def model_pairs(models: DataFrame, baseline: str) -> DataFrame:
    """All unordered pairs of a small model table, and each model against the baseline."""
    left, right = models.select(F.col("model").alias("left_model")), models.select(F.col("model").alias("right_model"))
    pairs = left.join(F.broadcast(right), F.col("left_model") < F.col("right_model"))
    return pairs.unionByName(models.select(F.col("model").alias("left_model"), F.lit(baseline).alias("right_model")))


def promotion(long: DataFrame, old: str, new: str, watched: str, least: float = 0.01) -> DataFrame:
    """Per seed the model to keep: the new one on a gain of macro F1 of at least ``least``, or on
    any gain with better balanced accuracy and a better watched metric."""
    delta = metric_delta(long, old, new)
    of = lambda m: F.max(F.when(F.col("metric") == m, F.col("delta")))
    d = delta.groupBy("seed").agg(of("macro_f1").alias("gain"), of("balanced_accuracy").alias("balanced"), of(watched).alias("watched"))
    better = (F.col("gain") >= least) | ((F.col("gain") > 0) & (F.col("balanced") > 0) & (F.col("watched") > 0))
    return d.withColumn("chosen", F.when(better, new).otherwise(old))


def reload_difference(a: DataFrame, b: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    other = b.select(*on, F.col("p").alias("q"))
    gap = F.array_max(F.zip_with("p", "q", lambda x, y: F.abs(x - y)))
    return a.join(other, on).groupBy(*keys).agg(F.max(gap).alias("max_abs_diff"), F.count("*").alias("n"))


def examples(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Per key the first wrong row, if any, and the first n - 1 right ones. Each part is a limit on a row
    number, which Spark applies before it shuffles."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy("sample_id"))
    first = lambda part, most: part.withColumn("k", k).where(F.col("k") <= most).drop("k")
    return first(rows.where("correct"), n - 1).unionByName(first(rows.where("NOT correct"), 1))


def _so_far(parts: DataFrame, **aggregates: Column) -> DataFrame:
    """``parts`` with, for each name, the largest value of the aggregate over the run's earlier ranges."""
    totals = parts.groupBy("run_id", "__part").agg(*[c.alias(n) for n, c in aggregates.items()])
    before = Window.partitionBy("run_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(totals.select("run_id", "__part", *[F.max(n).over(before).alias(n) for n in aggregates]), ["run_id", "__part"])


def _best_by_steps(history: DataFrame, patience: int, min_delta: float) -> DataFrame:
    """As ``best_so_far``, run by run in the order of epochs; a task holds one epoch at a time."""

    def run(batches):
        own, best, loss, stale, stopped = None, None, None, 0, False
        for batch in batches:
            out = []
            for r, e, f1, lo in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if r != own:
                    own, best, loss, stale, stopped = r, None, None, 0, False
                if stopped:
                    continue
                tie = best is not None and round(f1, 12) == round(best, 12) and None not in (lo, loss) and lo < loss
                improved = best is None or f1 > best + min_delta or tie
                best, loss, stale = (f1, lo, 0) if improved else (best, loss, stale + 1)
                stopped = stale >= patience
                out.append((r, e, improved, stale, stopped))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (batch.schema.field(0).type, batch.schema.field(1).type, pa.bool_(), pa.int32(), pa.bool_()), strict=True)], names=["run_id", "epoch", "improved", "stale", "stopped"])

    rows = history.select("run_id", "epoch", "val_macro_f1", "val_loss")
    types = dict(rows.dtypes)
    ordered = rows.repartition("run_id").sortWithinPartitions("run_id", "epoch")
    return ordered.mapInArrow(run, f"run_id {types['run_id']}, epoch {types['epoch']}, improved boolean, stale int, stopped boolean")


def best_so_far(history: DataFrame, patience: int, min_delta: float = 0.0) -> DataFrame:
    """run_id, epoch, improved, stale, stopped: an epoch improves on a score above the best by more than
    ``min_delta``, or on the same score with a lower loss (scores that agree to twelve places are the
    same); after ``patience`` stale epochs the run stops, and epochs after the stop are not in the result.
    With a ``min_delta`` what counts as best depends on all steps before, and runs are followed step by step.

    A segmented scan: the best so far is a running maximum of (score, -loss), the last improvement a
    running maximum of places. Both run within ranges of (run, epoch), and what earlier ranges of a run
    reached is joined on, so a run may be longer than a task."""
    if min_delta > 0:
        return _best_by_steps(history, patience, min_delta)
    rows = history.select("run_id", "epoch", F.struct(F.round("val_macro_f1", 12).alias("f1"), (-F.col("val_loss")).alias("loss")).alias("reached"))
    parts = ranged(rows, "run_id", "epoch")
    within = Window.partitionBy("run_id", "__part").orderBy("epoch")
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    sizes = with_earlier(parts, ["run_id"], {"__rows": F.count("*")}).drop("__before")
    best = F.greatest(F.max("reached").over(earlier), F.col("best"))
    marked = _so_far(sizes, best=F.max("reached")).select("run_id", "__part", "epoch", (F.col("__rows") + F.row_number().over(within)).alias("place"), F.coalesce(F.col("reached") > best, F.lit(True)).alias("improved"))
    at = F.when(F.col("improved"), F.col("place"))
    last = F.greatest(F.max(at).over(within), F.col("last"))
    scanned = _so_far(marked, last=F.max(at)).select("run_id", "epoch", "place", "improved", (F.col("place") - last).cast("int").alias("stale"))
    scanned = scanned.withColumn("stopped", F.col("stale") >= patience)
    stops = scanned.where("stopped").groupBy("run_id").agg(F.min("place").alias("stop"))
    kept = scanned.join(stops, "run_id", "left").where(F.col("stop").isNull() | (F.col("place") <= F.col("stop")))
    return kept.select("run_id", "epoch", "improved", "stale", "stopped")


def ranked_candidates(rows: DataFrame, order: list[Column], keep: list[str]) -> DataFrame:
    """Candidates by a complete key order; the first is selected."""
    placed = numbered(rows, "place", *order)
    return placed.select(*keep, F.col("place").cast("int").alias("place")).withColumn("selected", F.col("place") == 1)
