"""Evaluation of prediction tables: rows with a true class index and an array of probabilities.

Confusion cells, with any grouping keys, are the sufficient statistics of all threshold metrics;
everything after them works on at most classes * classes rows per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import ranged, stored, with_earlier

EPS64 = 2.220446049250313e-16


def argmax(p: Column) -> Column:
    """Index of the largest entry, the lowest of ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def renormalized(p: Column) -> Column:
    """A probability row divided by its sum; null where the sum isn't positive."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(p, lambda x: x / total))


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    raised = F.transform(x, lambda v: F.exp(v - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, v: a + v)
    return F.transform(raised, lambda v: v / total)


def nll(p: Column, true: Column, floor: float = EPS64) -> Column:
    q = F.element_at(renormalized(p), true + 1)
    return -F.ln(F.least(F.greatest(q, F.lit(floor)), F.lit(1.0)))


def confusion(rows: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """keys, true_idx, pred_idx, n, with zero cells for every key that has rows."""
    counted = rows.groupBy(*keys, "true_idx", argmax(F.col("p")).alias("pred_idx")).agg(F.count("*").alias("n"))
    return fill_cells(counted, keys, classes)


def fill_cells(counted: DataFrame, keys: list[str], classes: int) -> DataFrame:
    every = F.sequence(F.lit(0), F.lit(classes - 1))
    seen = counted.select(*keys).distinct() if keys else counted.agg(F.lit(1)).select()
    grid = seen.select("*", F.explode(every).alias("true_idx")).select("*", F.explode(every).alias("pred_idx"))
    return grid.join(counted, [*keys, "true_idx", "pred_idx"], "left").select(*keys, "true_idx", "pred_idx", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, class, precision, recall, f1, support; 0 on division by zero."""
    hit = F.when(F.col("true_idx") == F.col("pred_idx"), F.col("n")).otherwise(0)
    rows = F.explode(F.array(
        F.struct(F.col("true_idx").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), hit.cast("bigint").alias("hits")),
        F.struct(F.col("pred_idx").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
    ))
    sums = cells.withColumn("n", F.col("n").cast("bigint")).select(*keys, rows.alias("r")).groupBy(*keys, F.col("r.class").alias("class")).agg(*[F.sum(f"r.{c}").alias(c) for c in ("support", "predicted", "hits")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    return sums.select(*keys, "class", ratio(hits, predicted).alias("precision"), ratio(hits, support).alias("recall"), ratio(hits * 2, support + predicted).alias("f1"), "support", "hits")


HEADLINE = ("accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1")


def headline(by_class: DataFrame, keys: list[str], classes: int, each_f1: bool = False) -> DataFrame:
    """Accuracy, balanced accuracy over classes present in the truth, macro metrics over all
    classes, and support-weighted ones; with ``each_f1`` also f1_0, f1_1 and so on. Classes are
    added in their order, so that equal input gives equal bits."""

    def of(c: str, k: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("class") == k, F.col(c).cast("double"))), F.lit(0.0))

    def over(value) -> Column:
        return sum((value(k) for k in range(1, classes)), value(0))

    present = over(lambda k: F.when(of("support", k) > 0, 1).otherwise(0))
    balanced = over(lambda k: F.when(of("support", k) > 0, of("recall", k)).otherwise(0.0)) / F.nullif(present, F.lit(0))
    macro = [(over(lambda k, c=c: of(c, k)) / classes).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    weighted = [(over(lambda k, c=c: of(c, k) * of("support", k)) / F.sum("support")).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    each = [of("f1", k).alias(f"f1_{k}") for k in range(classes)] if each_f1 else []
    return by_class.groupBy(*keys).agg((F.sum("hits") / F.sum("support")).alias("accuracy"), balanced.alias("balanced_accuracy"), *macro, *weighted, *each)


def one_vs_rest(rows: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """keys, class, score, pos, neg: weighted counts per distinct score."""
    weight = F.lit(1) if weight is None else weight
    spread = rows.select(*keys, "true_idx", weight.alias("w"), F.posexplode("p").alias("class", "score"))
    is_class = F.col("true_idx") == F.col("class")
    return spread.groupBy(*keys, "class", "score").agg(F.sum(F.when(is_class, F.col("w")).otherwise(0)).alias("pos"), F.sum(F.when(is_class, 0).otherwise(F.col("w"))).alias("neg"))


def below_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    """``scores`` with ``pos_below`` and ``neg_below``, the counts at lower scores, and ``lower``,
    the counts of the next lower score. Ranges of scores are summed first, so a class may have any
    number of distinct scores."""
    own = [*keys, "class"]
    parts = ranged(scores, *own, "score")
    parts = with_earlier(parts, own, {"__pos": F.sum("pos"), "__neg": F.sum("neg")}, F.max_by(F.struct("pos", "neg"), "score"))
    within = Window.partitionBy(*own, "__part").orderBy("score")
    before = lambda c: F.coalesce(F.sum(c).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.select(
        *own, "score", "pos", "neg", (F.col("__pos") + before("pos")).alias("pos_below"), (F.col("__neg") + before("neg")).alias("neg_below"),
        F.coalesce(F.lag(F.struct("pos", "neg")).over(within), "__before").alias("lower"), "__part",
    )


def auc(scores: DataFrame, keys: list[str]) -> DataFrame:
    """keys, class, auc (null when a side is absent), positives: rank statistic, half credit for
    ties, over distinct scores only."""
    p, n = F.sum("pos"), F.sum("neg")
    area = F.sum((F.col("neg_below") + F.col("neg") / 2) * F.col("pos"))
    return below_scores(scores, keys).groupBy(*keys, "class").agg(F.when((p > 0) & (n > 0), area / (p * n)).alias("auc"), p.alias("positives"))


def roc_points(scores: DataFrame, keys: list[str]) -> DataFrame:
    """keys, class, k, fpr, tpr, threshold: thresholds descend from infinity; points on a line with
    both neighbours are dropped."""
    own = [*keys, "class"]
    c = below_scores(scores, keys)
    sizes = scores.groupBy(*own).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.max("score").alias("most"))
    c = c.join(sizes, own)
    # the next point adds what this one has: all three lie on a line
    straight = (F.col("lower.pos") == F.col("pos")) & (F.col("lower.neg") == F.col("neg"))
    kept = c.where((F.col("score") == F.col("most")) | ~F.coalesce(straight, F.lit(False)))
    fpr, tpr = (F.col("N") - F.col("neg_below")) / F.col("N"), (F.col("P") - F.col("pos_below")) / F.col("P")
    kept = stored(kept.select(*own, "score", fpr.alias("fpr"), tpr.alias("tpr"), "__part"), "points")
    placed = with_earlier(kept, own, {"__less": F.count("*")})
    lower = F.col("__less") + F.row_number().over(Window.partitionBy(*own, "__part").orderBy("score")) - 1
    totals = kept.groupBy(*own).agg(F.count("*").alias("__all"))
    points = placed.withColumn("__lower", lower).join(totals, own).select(*own, (F.col("__all") - F.col("__lower")).cast("bigint").alias("k"), "fpr", "tpr", F.col("score").alias("threshold"))
    zero = F.lit(0.0)
    origin = totals.select(*own, F.lit(0).cast("bigint").alias("k"), zero.alias("fpr"), zero.alias("tpr"), F.lit(float("inf")).alias("threshold"))
    return points.unionByName(origin)


def macro_roc(points: DataFrame, keys: list[str], grid: int = 200) -> DataFrame:
    """keys, k, fpr, tpr: the class mean of curves interpolated at ``grid`` even places. A segment
    makes the places that it covers, so the job grows with the points, not points times grid."""
    points = stored(points.select(*keys, "class", "k", "fpr", "tpr"), "points")
    after = points.select(*keys, "class", (F.col("k") - 1).alias("k"), F.col("fpr").alias("fpr2"), F.col("tpr").alias("tpr2"))
    seg = points.join(after, [*keys, "class", "k"], "left")
    last = F.col("fpr2").isNull()
    m = grid - 1
    lo = F.ceil(F.col("fpr") * m - 1e-9)
    hi = F.when(last, F.lit(m)).otherwise(F.ceil(F.col("fpr2") * m - 1e-9) - 1)
    spread = seg.where(hi >= lo).select("*", F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint"))).alias("g"))
    x = F.col("g") / m
    slope = F.when(last, F.lit(0.0)).otherwise((F.col("tpr2") - F.col("tpr")) / (F.col("fpr2") - F.col("fpr")))
    return spread.select(*keys, "g", (F.col("tpr") + slope * (x - F.col("fpr"))).alias("y")).groupBy(*keys, F.col("g").alias("k")).agg(F.avg("y").alias("tpr")).withColumn("fpr", F.col("k") / m)


def trapezoid(curve: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("k")
    pieces = curve.select(*keys, ((F.col("fpr") - F.lag("fpr").over(w)) * (F.col("tpr") + F.lag("tpr").over(w)) / 2).alias("area"))
    return pieces.groupBy(*keys).agg(F.sum("area").alias("auc"))


def calibration_bins(rows: DataFrame, keys: list[str], bins: int = 15) -> DataFrame:
    """keys, bin, n, accuracy, confidence of right-closed top-label bins; empty bins stay."""
    top = F.array_max("p")
    inner = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    number = F.size(F.filter(inner, lambda e: e < top))
    found = rows.select(*keys, number.alias("bin"), top.alias("c"), (argmax(F.col("p")) == F.col("true_idx")).cast("double").alias("hit"))
    found = found.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("c").alias("confidence"))
    every = found.select(*keys).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(found, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"), "accuracy", "confidence")


def calibration_error(bins: DataFrame, keys: list[str]) -> DataFrame:
    gap = F.coalesce(F.abs(F.col("accuracy") - F.col("confidence")) * F.col("n"), F.lit(0.0))
    return bins.groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def long_metrics(wide: DataFrame, keys: list[str], names=HEADLINE) -> DataFrame:
    """keys, metric, value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names]))
    return wide.select(*keys, pairs.alias("m")).select(*keys, "m.metric", "m.value")


def full_headline(rows: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """Threshold metrics, log loss and macro AUC per key."""
    base = headline(per_class(confusion(rows, keys, classes), keys), keys, classes)
    loss = rows.groupBy(*keys).agg(F.avg(nll(F.col("p"), F.col("true_idx"))).alias("log_loss"))
    area = auc(one_vs_rest(rows, keys), keys).groupBy(*keys).agg(F.avg("auc").alias("macro_auc"))
    return base.join(loss, keys).join(area, keys)
