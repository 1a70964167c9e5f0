"""Queries over prediction tables: metrics, resampling and comparison of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import compare as C
from ..operators import metrics as M
from ..operators import resample as B
from ..operators import splits as P
from ..operators.integrity import merkle_roots
from ..operators.ordering import quantiles
from .registry import query

RUN = ["model", "seed"]
K = 3


def to_digits(c: Column | str, digits: int = 6) -> Column:
    """The double rounded as SQL does it: scaled, half away from zero, scaled back. Spark's own rounding goes
    by the shortest decimal form, which parts from it next to ties."""
    return F.round((F.col(c) if isinstance(c, str) else c) * F.lit(10.0**digits), 0) / F.lit(10.0**digits)


def r6(c: Column | str) -> Column:
    return to_digits(c) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in names else F.col(c) for c in df.columns])


def _argmax(a="p0", b="p1", c="p2") -> str:
    return f"CASE WHEN {a} >= {b} AND {a} >= {c} THEN 0 WHEN {b} >= {c} THEN 1 ELSE 2 END"


def cells_sql(view: str, keys: str, n: str = "count(*)") -> str:
    """Confusion cells with zero cells; keys is 'a, b' or ''."""
    k, using = (f"{keys}, ", f"USING ({keys}, true_idx, pred_idx)") if keys else ("", "USING (true_idx, pred_idx)")
    source = f"(SELECT DISTINCT {keys} FROM {view})," if keys else ""
    return f"""SELECT {k}true_idx, pred_idx, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT * FROM {source} (SELECT unnest([0, 1, 2]) AS true_idx), (SELECT unnest([0, 1, 2]) AS pred_idx))
LEFT JOIN (SELECT {k}true_idx, {_argmax()} AS pred_idx, {n} AS n FROM {view} GROUP BY ALL) {using}"""


def class_sql(cells: str, keys: str) -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}class, CAST(sum(s) AS BIGINT) AS support, sum(h) AS hits, CASE WHEN sum(q) > 0 THEN sum(h) / sum(q) ELSE 0.0 END AS precision, CASE WHEN sum(s) > 0 THEN sum(h) / sum(s) ELSE 0.0 END AS recall,
CASE WHEN sum(s) + sum(q) > 0 THEN 2 * sum(h) / (sum(s) + sum(q)) ELSE 0.0 END AS f1
FROM (SELECT {k}true_idx AS class, CAST(n AS DOUBLE) AS s, 0.0 AS q, CASE WHEN true_idx = pred_idx THEN CAST(n AS DOUBLE) ELSE 0.0 END AS h FROM ({cells})
UNION ALL SELECT {k}pred_idx, 0.0, CAST(n AS DOUBLE), 0.0 FROM ({cells})) GROUP BY ALL"""


def headline_sql(by_class: str, keys: str) -> str:
    k, g = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    macro = ", ".join(f"sum({c}) / 3 AS macro_{c}" for c in ("precision", "recall", "f1"))
    weighted = ", ".join(f"sum({c} * support) / sum(support) AS weighted_{c}" for c in ("precision", "recall", "f1"))
    return f"SELECT {k}sum(hits) / sum(support) AS accuracy, avg(CASE WHEN support > 0 THEN recall END) AS balanced_accuracy, {macro}, {weighted} FROM ({by_class}) {g}"


NLL = "-ln(least(greatest((CASE true_idx WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END) / (p0 + p1 + p2), 2.220446049250313e-16), 1.0))"


def scores_sql(view: str, keys: str, weight: str = "1") -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}class, score, sum(CASE WHEN true_idx = class THEN w ELSE 0 END) AS pos, sum(CASE WHEN true_idx = class THEN 0 ELSE w END) AS neg
FROM (SELECT {k}true_idx, {weight} AS w, unnest([0, 1, 2]) AS class, unnest([p0, p1, p2]) AS score FROM {view}) GROUP BY ALL"""


def auc_sql(scores: str, keys: str) -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}class, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum((u + neg / 2) * pos) / (sum(pos) * sum(neg)) END AS auc, CAST(sum(pos) AS BIGINT) AS positives
FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {k}class ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM ({scores})) GROUP BY {k}class"""


def r6_sql(sql: str, *names: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({n}, 6) + 0.0 AS {n}' for n in names)}) FROM ({sql})"


def long_sql(wide: str, keys: str, names) -> str:
    return f"SELECT {keys}, unnest([{', '.join(repr(n) for n in names)}]) AS metric, unnest([{', '.join(f'CAST({n} AS DOUBLE)' for n in names)}]) AS value FROM ({wide})"


CELLS = cells_sql("fx_predictions", "model, seed")
BY_CLASS = class_sql(CELLS, "model, seed")
HEAD = headline_sql(BY_CLASS, "model, seed")


def full_sql(view: str) -> str:
    head = headline_sql(class_sql(cells_sql(view, "model, seed"), "model, seed"), "model, seed")
    return f"""SELECT * FROM ({head}) JOIN (SELECT model, seed, avg({NLL}) AS log_loss FROM {view} GROUP BY ALL) USING (model, seed)
JOIN (SELECT model, seed, avg(auc) AS macro_auc FROM ({auc_sql(scores_sql(view, 'model, seed'), 'model, seed')}) GROUP BY ALL) USING (model, seed)"""


FULL = full_sql("fx_predictions")
FULL_NAMES = (*M.HEADLINE, "log_loss", "macro_auc")
LONG = long_sql(FULL, "model, seed", FULL_NAMES)


def full(v) -> DataFrame:
    return M.full_headline(v.predictions, RUN, K)


def long_full(v) -> DataFrame:
    return M.long_metrics(full(v), RUN, FULL_NAMES)


@query("e01_confusion", CELLS)
def e01(v):
    return M.confusion(v.predictions, RUN, K).withColumn("n", F.col("n").cast("bigint"))


@query("e01_confusion_large", cells_sql("fx_pred_large", ""))
def e01_large(v):
    return M.confusion(v.pred_large.withColumn("one", F.lit(1)), ["one"], K).select("true_idx", "pred_idx", F.col("n").cast("bigint").alias("n"))


@query("e02_per_class", f"SELECT model, seed, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM ({BY_CLASS})")
def e02(v):
    return rounded(M.per_class(M.confusion(v.predictions, RUN, K), RUN), "precision", "recall", "f1").drop("hits")


@query("e03_headline", r6_sql(HEAD, *M.HEADLINE))
def e03(v):
    return rounded(M.headline(M.per_class(M.confusion(v.predictions, RUN, K), RUN), RUN, K), *M.HEADLINE)


@query("e04_auc", r6_sql(auc_sql(scores_sql("fx_predictions", "model, seed"), "model, seed"), "auc"))
def e04(v):
    return rounded(M.auc(M.one_vs_rest(v.predictions, RUN), RUN), "auc")


@query("e04_auc_summary", f"SELECT model, seed, round(avg(auc), 6) AS macro_auc, round(sum(auc * positives) / sum(positives), 6) AS weighted_auc FROM ({auc_sql(scores_sql('fx_predictions', 'model, seed'), 'model, seed')}) GROUP BY ALL")
def e04s(v):
    a = M.auc(M.one_vs_rest(v.predictions, RUN), RUN)
    return rounded(a.groupBy(*RUN).agg(F.avg("auc").alias("macro_auc"), (F.sum(F.col("auc") * F.col("positives")) / F.sum("positives")).alias("weighted_auc")), "macro_auc", "weighted_auc")


@query("e04_auc_large", r6_sql(auc_sql(scores_sql("fx_pred_large", ""), ""), "auc"))
def e04_large(v):
    one = v.pred_large.withColumn("one", F.lit(1))
    return rounded(M.auc(M.one_vs_rest(one, ["one"]), ["one"]), "auc").drop("one")


@query("e05_log_loss", f"SELECT model, seed, round(avg({NLL}), 6) AS log_loss, count(*) AS n FROM fx_predictions GROUP BY ALL")
def e05(v):
    return rounded(v.predictions.groupBy(*RUN).agg(F.avg(M.nll(F.col("p"), F.col("true_idx"))).alias("log_loss"), F.count("*").alias("n")), "log_loss")


ROC = f"""WITH s AS ({scores_sql('fx_predictions', 'model, seed')}),
c AS (SELECT *, sum(pos) OVER r AS tp, sum(neg) OVER r AS fp, sum(pos) OVER w AS pp, sum(neg) OVER w AS nn FROM s WINDOW r AS (PARTITION BY model, seed, class ORDER BY score DESC ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY model, seed, class)),
b AS (SELECT *, lead(tp) OVER d - 2 * tp + lag(tp) OVER d AS bt, lead(fp) OVER d - 2 * fp + lag(fp) OVER d AS bf FROM c WINDOW d AS (PARTITION BY model, seed, class ORDER BY score DESC)),
p AS (SELECT model, seed, class, fp / nn AS fpr, tp / pp AS tpr, score AS threshold FROM b WHERE coalesce(bt <> 0 OR bf <> 0, true)
UNION ALL SELECT DISTINCT model, seed, class, 0.0, 0.0, CAST('inf' AS DOUBLE) FROM s)
SELECT model, seed, class, row_number() OVER (PARTITION BY model, seed, class ORDER BY threshold DESC) - 1 AS k, fpr, tpr, threshold FROM p"""


@query("e06_roc_points", f"SELECT model, seed, class, k, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(threshold, 6) AS threshold FROM ({ROC}) WHERE k > 0")
def e06(v):
    return rounded(M.roc_points(M.one_vs_rest(v.predictions, RUN), RUN).where("k > 0"), "fpr", "tpr", "threshold")


CURVE = f"""WITH q AS ({ROC}), s AS (SELECT *, lead(fpr) OVER w AS fpr2, lead(tpr) OVER w AS tpr2 FROM q WINDOW w AS (PARTITION BY model, seed, class ORDER BY k)), g AS (SELECT i AS k, i / 199.0 AS x FROM range(200) t(i))
SELECT model, seed, g.k, avg(CASE WHEN fpr2 IS NULL THEN tpr ELSE tpr + (tpr2 - tpr) / (fpr2 - fpr) * (x - fpr) END) AS tpr, any_value(x) AS fpr
FROM s JOIN g ON x >= fpr - 1e-11 AND (fpr2 IS NULL OR x < fpr2 - 1e-11) GROUP BY ALL"""


@query("e07_macro_roc", f"SELECT model, seed, k, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM ({CURVE})")
def e07(v):
    return rounded(M.macro_roc(M.roc_points(M.one_vs_rest(v.predictions, RUN), RUN), RUN), "tpr", "fpr")


@query("e07_macro_roc_area", f"SELECT model, seed, round(sum(a), 6) AS auc FROM (SELECT model, seed, (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS a FROM ({CURVE}) WINDOW w AS (PARTITION BY model, seed ORDER BY k)) GROUP BY ALL")
def e07_area(v):
    return rounded(M.trapezoid(M.macro_roc(M.roc_points(M.one_vs_rest(v.predictions, RUN), RUN), RUN), RUN), "auc")


SIZE = "CASE WHEN size <= 20 THEN 'small' WHEN size <= 24 THEN 'medium' ELSE 'large' END"
SIZES_SQL = "SELECT sample_id, CAST(list_sum(tumor_mask) AS BIGINT) AS size FROM fx_samples"


def sizes(v) -> DataFrame:
    return v.samples.select("sample_id", F.aggregate("tumor_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("size"))


def with_bucket(v) -> DataFrame:
    return v.predictions.join(sizes(v), "sample_id").withColumn("bucket", S.size_bucket(F.col("size"), 20, 24))


@query("e08_prediction_table", f"SELECT model, seed, sample_id, patient_id, true_idx, {_argmax()} AS pred_idx, ['no', 'few', 'many'][true_idx + 1] AS true_name, round(p0, 6) AS prob_no, round(p1, 6) AS prob_few, round(p2, 6) AS prob_many, true_idx = {_argmax()} AS correct, size, {SIZE} AS bucket FROM fx_predictions JOIN ({SIZES_SQL}) USING (sample_id)")
def e08(v):
    return C.prediction_table(with_bucket(v), ["no", "few", "many"]).select(
        "model", "seed", "sample_id", "patient_id", "true_idx", "pred_idx", "true_name", r6("prob_no").alias("prob_no"), r6("prob_few").alias("prob_few"), r6("prob_many").alias("prob_many"), "correct", "size", "bucket"
    )


TOP = "greatest(p0, p1, p2)"
BIN = f"len(list_filter([k / 15.0 for k in range(1, 15)], lambda e: e < {TOP}))"
BINS = f"""SELECT model, seed, bin, coalesce(n, 0) AS n, accuracy, confidence FROM (SELECT * FROM (SELECT DISTINCT model, seed FROM fx_predictions), (SELECT CAST(i AS INT) AS bin FROM range(15) t(i)))
LEFT JOIN (SELECT model, seed, CAST({BIN} AS INT) AS bin, count(*) AS n, avg(CASE WHEN {_argmax()} = true_idx THEN 1.0 ELSE 0.0 END) AS accuracy, avg({TOP}) AS confidence FROM fx_predictions GROUP BY ALL) USING (model, seed, bin)"""


@query("e09_calibration_bins", r6_sql(BINS, "accuracy", "confidence"))
def e09(v):
    return rounded(M.calibration_bins(v.predictions, RUN), "accuracy", "confidence")


ECE = f"SELECT model, seed, sum(coalesce(abs(accuracy - confidence) * n, 0)) / sum(n) AS ece FROM ({BINS}) GROUP BY ALL"


@query("e09_calibration_error", r6_sql(ECE, "ece"))
def e09_ece(v):
    return rounded(M.calibration_error(M.calibration_bins(v.predictions, RUN), RUN), "ece")


BUCKETED = f"(SELECT *, {SIZE} AS bucket FROM fx_predictions JOIN ({SIZES_SQL}) USING (sample_id))"
BUCKET_CLASS = class_sql(cells_sql(BUCKETED, "model, seed, bucket"), "model, seed, bucket")


@query("e10_strata", f"SELECT model, seed, bucket, CAST(sum(support) AS BIGINT) AS n, round(sum(hits) / sum(support), 6) AS accuracy, round(sum(f1) / 3, 6) AS macro_f1, round(max(CASE class WHEN 0 THEN recall END), 6) AS recall_0, round(max(CASE class WHEN 1 THEN recall END), 6) AS recall_1, round(max(CASE class WHEN 2 THEN recall END), 6) AS recall_2 FROM ({BUCKET_CLASS}) GROUP BY ALL")
def e10(v):
    return rounded(C.strata_report(with_bucket(v), [*RUN, "bucket"], K), "accuracy", "macro_f1", "recall_0", "recall_1", "recall_2")


ORDER_SPLIT = """(WITH g AS (SELECT DISTINCT patient_id, label FROM fx_orders), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || patient_id)) rn, count(*) OVER (PARTITION BY label) n FROM g)
SELECT patient_id, label, CASE WHEN rn <= round_even(n * 0.7, 0) THEN 'train' WHEN rn <= round_even(n * 0.7, 0) + floor((n - round_even(n * 0.7, 0)) / 2) THEN 'val' ELSE 'test' END AS split FROM r)"""


@query("e11_size_edges", f"SELECT round(quantile_cont(size, 1 / 3.0), 6) AS low, round(quantile_cont(size, 2 / 3.0), 6) AS high, count(*) AS n, round(min(size), 6) AS least, round(max(size), 6) AS most FROM fx_orders o JOIN {ORDER_SPLIT} s ON s.patient_id = o.patient_id AND s.split = 'train'")
def e11(v):
    """Edges come from the training groups only."""
    train = P.assign_group_splits(v.orders, seed=42).where("split = 'train'").select("patient_id")
    return rounded(C.size_edges(v.orders.join(train, "patient_id", "left_semi")), "low", "high", "least", "most")


W12 = "(CASE true_idx WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE 0.5 END)"


@query("e12_weighted_ce", f"SELECT model, seed, round(sum({W12} * -ln(greatest(CASE true_idx WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 1e-12))) / sum({W12}), 6) AS loss FROM fx_predictions GROUP BY ALL")
def e12(v):
    return rounded(C.weighted_cross_entropy(v.predictions, RUN, [1.0, 2.0, 0.5]), "loss")


EPOCHED = "(SELECT *, CAST(sample_id % 5 AS INT) AS epoch FROM fx_predictions)"


@query("e13_epoch_metrics", r6_sql(f"SELECT model, seed, epoch, accuracy, balanced_accuracy, macro_f1, log_loss FROM ({headline_sql(class_sql(cells_sql(EPOCHED, 'model, seed, epoch'), 'model, seed, epoch'), 'model, seed, epoch')}) JOIN (SELECT model, seed, epoch, avg({NLL}) AS log_loss FROM {EPOCHED} GROUP BY ALL) USING (model, seed, epoch)", "accuracy", "balanced_accuracy", "macro_f1", "log_loss"))
def e13(v):
    keys = [*RUN, "epoch"]
    rows = v.predictions.withColumn("epoch", (F.col("sample_id") % 5).cast("int"))
    names = ("accuracy", "balanced_accuracy", "macro_f1", "log_loss")
    loss = rows.groupBy(*keys).agg(F.avg(M.nll(F.col("p"), F.col("true_idx"))).alias("log_loss"))
    return rounded(M.headline(M.per_class(M.confusion(rows, keys, K), keys), keys, K).join(loss, keys).select(*keys, *names), *names)


@query("e14_metric_delta", f"SELECT a.seed AS seed, a.metric, round(a.value, 6) AS a, round(b.value, 6) AS b, round(b.value - a.value, 6) + 0.0 AS delta FROM ({LONG}) a JOIN ({LONG}) b ON a.model = 'a' AND b.model = 'b' AND a.seed = b.seed AND a.metric = b.metric")
def e14(v):
    return rounded(C.metric_delta(long_full(v), "a", "b"), "a", "b", "delta")


AVERAGED = "(SELECT model, sample_id, true_idx, avg(p0) AS p0, avg(p1) AS p1, avg(p2) AS p2 FROM fx_predictions GROUP BY ALL)"


@query("e15_seed_average_auc", r6_sql(auc_sql(scores_sql(AVERAGED, "model"), "model"), "auc"))
def e15(v):
    return rounded(M.auc(M.one_vs_rest(C.seed_average(v.predictions, K), ["model"]), ["model"]), "auc")


@query("a18_confidence", f"SELECT model, true_idx = {_argmax()} AS correct, round(avg({TOP}), 6) AS mean, round(median({TOP}), 6) AS median, count(*) AS n FROM fx_predictions GROUP BY ALL")
def a18(v):
    rows = v.predictions.select("model", (M.argmax(F.col("p")) == F.col("true_idx")).alias("correct"), F.array_max("p").alias("c"))
    median = quantiles(rows, ["model", "correct"], "c", {"median": 0.5})
    return rounded(rows.groupBy("model", "correct").agg(F.avg("c").alias("mean")).join(median, ["model", "correct"]), "mean", "median")


N_RESAMPLES = 2000


def draws_sql(seed: int, n: int = N_RESAMPLES) -> str:
    return f"""(WITH g AS (SELECT patient_id, row_number() OVER (ORDER BY patient_id) - 1 AS g FROM (SELECT DISTINCT patient_id FROM fx_predictions)), n AS (SELECT count(*) AS n FROM g),
d AS (SELECT b, CAST(('0x' || substr(md5('{seed}:' || b || ':' || k.g), 1, 8)) AS BIGINT) % n AS g FROM n, range({n}) t(b), g k) SELECT b, patient_id, count(*) AS times FROM d JOIN g USING (g) GROUP BY ALL)"""


CLASS_F1 = B.class_f1(K)


def resampled_sql(view: str = "fx_predictions") -> str:
    """Threshold metrics and log loss, from cells and loss sums of groups."""
    hot = ", ".join(f"CASE WHEN a = {k} THEN 1.0 ELSE 0.0 END AS p{k}" for k in range(K))
    groups = f"(SELECT model, seed, patient_id, true_idx, {hot}, count(*) AS c, sum(loss) AS loss FROM (SELECT *, {_argmax()} AS a, {NLL} AS loss FROM {view}) GROUP BY model, seed, patient_id, true_idx, a)"
    rows = f"(SELECT p.*, d.b, d.times FROM {groups} p JOIN {draws_sql(7)} d USING (patient_id))"
    keys = "model, seed, b"
    by_class = class_sql(cells_sql(rows, keys, "sum(times * c)"), keys)
    each = ", ".join(f"max(f1) FILTER (class = {k}) AS {n}" for k, n in enumerate(CLASS_F1))
    wide = f"SELECT * FROM ({headline_sql(by_class, keys)}) JOIN (SELECT {keys}, {each} FROM ({by_class}) GROUP BY ALL) USING ({keys}) JOIN (SELECT {keys}, sum(loss * times) / sum(c * times) AS log_loss FROM {rows} GROUP BY ALL) USING ({keys})"
    return long_sql(wide, keys, NINE)


NINE = (*M.HEADLINE, *CLASS_F1, "log_loss")


def resampled_auc_sql() -> str:
    """Ordered pairs per class and pair of groups, weighed by how often a resample drew each."""
    return f"""WITH r AS (SELECT model, seed, patient_id, true_idx, unnest([0, 1, 2]) AS class, unnest([p0, p1, p2]) AS score FROM fx_predictions),
w AS (SELECT a.model, a.seed, a.class, a.patient_id AS g, b.patient_id AS h, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS won
 FROM r a JOIN r b ON a.model = b.model AND a.seed = b.seed AND a.class = b.class AND a.true_idx = a.class AND b.true_idx <> b.class GROUP BY ALL),
s AS (SELECT model, seed, class, patient_id AS g, count(*) FILTER (true_idx = class) AS pos, count(*) FILTER (true_idx <> class) AS neg FROM r GROUP BY ALL),
d AS (SELECT * FROM {draws_sql(7)}),
n AS (SELECT model, seed, class, b, sum(pos * times) AS n_pos, sum(neg * times) AS n_neg FROM s JOIN d ON d.patient_id = s.g GROUP BY ALL),
x AS (SELECT model, seed, class, x.b, sum(won * x.times * y.times) AS won FROM w JOIN d x ON x.patient_id = w.g JOIN d y ON y.patient_id = w.h AND y.b = x.b GROUP BY ALL)
SELECT model, seed, 'macro_auc' AS metric, avg(CASE WHEN n_pos > 0 AND n_neg > 0 THEN coalesce(won, 0) / (n_pos * n_neg) END) AS value FROM n LEFT JOIN x USING (model, seed, class, b) GROUP BY model, seed, b"""


def draws(v, n: int = N_RESAMPLES) -> DataFrame:
    return B.multiplicities(v.predictions, "patient_id", n, 7)


def resampled(v, n: int = N_RESAMPLES, rows: DataFrame | None = None) -> DataFrame:
    return B.resampled(v.predictions if rows is None else rows, draws(v, n), RUN, "patient_id", K)


def interval_sql(values: str, keys: str) -> str:
    return f"SELECT {keys}, round(quantile_cont(value, 0.025), 6) + 0.0 AS low, round(quantile_cont(value, 0.975), 6) + 0.0 AS high, count(value) AS n_valid FROM ({values}) GROUP BY ALL"


EACH_F1 = ", ".join(f"max(f1) FILTER (class = {k}) AS {n}" for k, n in enumerate(CLASS_F1))
LONG9 = long_sql(f"SELECT * FROM ({HEAD}) JOIN (SELECT model, seed, {EACH_F1} FROM ({BY_CLASS}) GROUP BY ALL) USING (model, seed) JOIN (SELECT model, seed, avg({NLL}) AS log_loss FROM fx_predictions GROUP BY ALL) USING (model, seed)", "model, seed", NINE)


@query("b01_group_bootstrap", f"SELECT * FROM ({interval_sql(resampled_sql(), 'model, seed, metric')}) JOIN (SELECT model, seed, metric, round(value, 6) AS point FROM ({LONG9})) USING (model, seed, metric)")
def b01(v, n: int = N_RESAMPLES):
    loss = v.predictions.groupBy(*RUN).agg(F.avg(M.nll(F.col("p"), F.col("true_idx"))).alias("log_loss"))
    wide = M.headline(M.per_class(M.confusion(v.predictions, RUN, K), RUN), RUN, K, each_f1=True).join(loss, RUN)
    point = M.long_metrics(wide, RUN, NINE).withColumnRenamed("value", "point")
    return rounded(B.interval(resampled(v, n=n), [*RUN, "metric"]).join(point, [*RUN, "metric"]), "low", "high", "point")


PAIRED = f"WITH r AS ({resampled_sql()}) SELECT a.seed, a.b, a.metric, a.value - o.value AS value FROM r a JOIN r o ON a.model = 'a' AND o.model = 'b' AND a.seed = o.seed AND a.b = o.b AND a.metric = o.metric"


def paired_rows(v, n: int = N_RESAMPLES) -> DataFrame:
    r = resampled(v, n=n)
    part = lambda m: r.where(F.col("model") == m).drop("model")
    return B.paired(part("a"), part("b"), ["seed"])


@query("b02_paired_bootstrap", f"SELECT * FROM ({interval_sql(PAIRED, 'seed, metric')}) JOIN (SELECT seed, metric, round(avg(CASE WHEN value > 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS frac_a_greater FROM ({PAIRED}) GROUP BY ALL) USING (seed, metric)")
def b02(v, n: int = N_RESAMPLES):
    p = paired_rows(v, n)
    frac = p.groupBy("seed", "metric").agg(F.avg((F.col("value") > B.TOLERANCE).cast("double")).alias("frac_a_greater"))
    return rounded(B.interval(p, ["seed", "metric"]).join(frac, ["seed", "metric"]), "low", "high", "frac_a_greater")


SEEDED = f"SELECT model, b, metric, avg(value) AS value FROM ({resampled_sql()}) GROUP BY ALL"


def seed_means(v, n: int = N_RESAMPLES) -> DataFrame:
    return resampled(v, n=n).groupBy("model", "b", "metric").agg(F.avg("value").alias("value"))


@query("b03_multi_seed_bootstrap", interval_sql(SEEDED, "model, metric"))
def b03(v, n: int = N_RESAMPLES):
    return rounded(B.interval(seed_means(v, n), ["model", "metric"]), "low", "high")


@query("b04_paired_multi_seed", interval_sql(f"WITH s AS ({SEEDED}) SELECT x.model || '-' || y.model AS pair, x.b, x.metric, x.value - y.value AS value FROM s x JOIN s y ON x.model <= y.model AND x.b = y.b AND x.metric = y.metric", "pair, metric"))
def b04(v, n: int = N_RESAMPLES):
    s = seed_means(v, n)
    other = s.select(F.col("model").alias("other"), "b", "metric", F.col("value").alias("less"))
    both = s.join(other, ["b", "metric"]).where("model <= other").select(F.concat_ws("-", "model", "other").alias("pair"), "b", "metric", (F.col("value") - F.col("less")).alias("value"))
    return rounded(B.interval(both, ["pair", "metric"]), "low", "high")


@query("b05_auc_bootstrap", interval_sql(resampled_auc_sql(), "model, seed, metric"))
def b05(v, n: int = N_RESAMPLES):
    """All runs; the cost is resamples times pairs of groups."""
    r = B.resampled_auc(v.predictions, draws(v, n), RUN, "patient_id")
    return rounded(B.interval(r, [*RUN, "metric"]), "low", "high")


# comparison tables
def spread_sql(values: str, keys: str) -> str:
    return f"SELECT {keys}, round(avg(value), 6) + 0.0 AS mean, round(CASE WHEN count(value) = 0 THEN NULL WHEN count(value) = 1 THEN 0.0 ELSE stddev_samp(value) END, 6) AS std, count(value) AS n FROM ({values}) GROUP BY ALL"


@query("c01_seed_headline", spread_sql(LONG, "model, metric"))
def c01(v):
    return rounded(C.seed_spread(long_full(v), ["model", "metric"]), "mean", "std")


@query("c02_seed_per_class", spread_sql(long_sql(BY_CLASS, "model, seed, class", ("precision", "recall", "f1")), "model, class, metric"))
def c02(v):
    wide = M.per_class(M.confusion(v.predictions, RUN, K), RUN)
    return rounded(C.seed_spread(M.long_metrics(wide, [*RUN, "class"], ("precision", "recall", "f1")), ["model", "class", "metric"]), "mean", "std")


@query("c03_seed_strata", spread_sql(f"SELECT model, seed, bucket, class, recall AS value FROM ({BUCKET_CLASS})", "model, bucket, class"))
def c03(v):
    keys = [*RUN, "bucket"]
    wide = M.per_class(M.confusion(with_bucket(v), keys, K), keys)
    return rounded(C.seed_spread(wide.select(*keys, "class", F.col("recall").alias("value")), ["model", "bucket", "class"]), "mean", "std")


@query("c04_seed_calibration", spread_sql(f"SELECT model, seed, ece AS value FROM ({ECE})", "model"))
def c04(v):
    e = M.calibration_error(M.calibration_bins(v.predictions, RUN), RUN)
    return rounded(C.seed_spread(e.withColumnRenamed("ece", "value"), ["model"]), "mean", "std")


@query("c05_confusion_sum", f"SELECT model, true_idx, pred_idx, CAST(sum(n) AS BIGINT) AS n FROM ({CELLS}) GROUP BY ALL")
def c05(v):
    return M.confusion(v.predictions, RUN, K).groupBy("model", "true_idx", "pred_idx").agg(F.sum("n").alias("n"))


C06 = ("accuracy", "macro_f1", "macro_auc")


@query("c06_headline_table", "SELECT model, " + ", ".join(f"round(avg(value) FILTER (metric = '{m}'), 6) AS {m}_mean, round(stddev_samp(value) FILTER (metric = '{m}'), 6) AS {m}_std" for m in C06) + f" FROM ({LONG}) GROUP BY model")
def c06(v):
    wide = C.report_table(long_full(v), ["model"], C06)
    return rounded(wide, *[c for c in wide.columns if c != "model"])


@query("c07_comparison", f"SELECT x.model, y.model AS other, x.metric, round(avg(x.value), 6) AS mean, round(avg(y.value), 6) AS other_mean, round(avg(x.value) - avg(y.value), 6) + 0.0 AS gap FROM ({LONG}) x JOIN ({LONG}) y ON x.model < y.model AND x.seed = y.seed AND x.metric = y.metric GROUP BY ALL")
def c07(v):
    return rounded(C.all_pairs(long_full(v)), "mean", "other_mean", "gap")


@query("c08_latency", "SELECT batch, count(*) AS n, round(median(ms), 6) AS median, round(list_sort(list(ms))[1 + CAST(round_even(0.9 * (count(*) - 1), 0) AS INT)], 6) AS p90 FROM fx_timings GROUP BY batch")
def c08(v):
    return rounded(C.latency_summary(v.timings, "batch"), "median", "p90")


COST = "(VALUES ('a', 4011391, 4.583), ('b', 98307, 0.9)) c(model, parameters, ms)"


@query("c09_score_vs_cost", f"SELECT model, round(avg(value), 6) AS macro_f1, parameters, CAST(ms AS DOUBLE) AS ms FROM ({LONG}) JOIN {COST} USING (model) WHERE metric = 'macro_f1' GROUP BY ALL")
def c09(v):
    cost = v.spark.createDataFrame([("a", 4011391, 4.583), ("b", 98307, 0.9)], "model string, parameters int, ms double")
    mean = C.seed_spread(long_full(v).where("metric = 'macro_f1'"), ["model"]).select("model", F.col("mean").alias("macro_f1"))
    return rounded(mean.join(F.broadcast(cost), "model"), "macro_f1")


@query("c10_headline_bars", f"WITH m AS (SELECT model, metric, avg(value) AS mean FROM ({LONG}) GROUP BY ALL), i AS (SELECT model, metric, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM ({SEEDED}) GROUP BY ALL) SELECT model, metric, round(mean, 6) AS mean, round(coalesce(mean - low, 0), 6) + 0.0 AS below, round(coalesce(high - mean, 0), 6) + 0.0 AS above FROM m LEFT JOIN i USING (model, metric)")
def c10(v, n: int = N_RESAMPLES):
    mean = C.seed_spread(long_full(v), ["model", "metric"]).select("model", "metric", "mean")
    return rounded(C.bars(mean, B.interval(seed_means(v, n), ["model", "metric"])), "mean", "below", "above")


# the report tables, and the whole comparison with a baseline: model a, seed 42, with its classes turned round
@query("c06_per_class_table", "SELECT model, class, " + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std" for m in ("precision", "recall", "f1")) + f" FROM ({BY_CLASS}) GROUP BY model, class")
def c06_per_class(v):
    by_class = M.per_class(M.confusion(v.predictions, RUN, K), RUN)
    wide = C.report_table(M.long_metrics(by_class, [*RUN, "class"], ("precision", "recall", "f1")), ["model", "class"], ("precision", "recall", "f1"))
    return rounded(wide, *[c for c in wide.columns if c not in ("model", "class")])


@query("c06_stratified_table", f"SELECT model, bucket, class, round(avg(recall), 6) AS recall_mean, round(stddev_samp(recall), 6) AS recall_std FROM ({BUCKET_CLASS}) GROUP BY ALL")
def c06_stratified(v):
    keys = [*RUN, "bucket"]
    by_class = M.per_class(M.confusion(with_bucket(v), keys, K), keys)
    return rounded(C.report_table(M.long_metrics(by_class, [*keys, "class"], ("recall",)), ["model", "bucket", "class"], ("recall",)), "recall_mean", "recall_std")


@query("c06_calibration_table", f"SELECT model, round(avg(ece), 6) AS ece_mean, round(stddev_samp(ece), 6) AS ece_std FROM ({ECE}) GROUP BY model")
def c06_calibration(v):
    e = M.calibration_error(M.calibration_bins(v.predictions, RUN), RUN)
    return rounded(C.report_table(M.long_metrics(e, RUN, ("ece",)), ["model"], ("ece",)), "ece_mean", "ece_std")


@query("c06_efficiency_table", "SELECT 'cpu' AS device, model, parameters, batch, round(quantile_cont(t.ms, 0.5), 6) AS ms_per_row FROM fx_timings t, " + COST + " GROUP BY ALL")
def c06_efficiency(v):
    """Parameters of every model beside the median time of every kind of batch."""
    cost = v.spark.createDataFrame([("a", 4011391), ("b", 98307)], "model string, parameters int")
    median = C.latency_summary(v.timings, "batch").select("batch", F.col("median").alias("ms_per_row"))
    return rounded(median.join(F.broadcast(cost)).select(F.lit("cpu").alias("device"), "model", "parameters", "batch", "ms_per_row"), "ms_per_row")


ALL_SQL = "(SELECT * FROM fx_predictions UNION ALL SELECT 'baseline', 0, sample_id, patient_id, true_idx, p1, p2, p0 FROM fx_predictions WHERE model = 'a' AND seed = 42)"
PAIRS_SQL = f"""WITH s AS (SELECT model, b, metric, avg(value) AS value FROM ({resampled_sql(ALL_SQL)}) GROUP BY ALL),
d AS (SELECT x.model || '_vs_' || y.model AS pair, x.b, x.metric, x.value - y.value AS value FROM s x JOIN s y ON x.b = y.b AND x.metric = y.metric AND ((x.model < y.model AND x.model <> 'baseline' AND y.model <> 'baseline') OR (x.model <> 'baseline' AND y.model = 'baseline')))
SELECT pair, metric, quantile_cont(value, 0.025) AS ci_low, quantile_cont(value, 0.975) AS ci_high, avg(CASE WHEN value > 1e-12 THEN 1.0 ELSE 0.0 END) AS frac_a_greater, count(value) AS n_valid FROM d GROUP BY ALL"""


def with_baseline(v) -> DataFrame:
    p = F.col("p")
    base = v.predictions.where("model = 'a' AND seed = 42").select(F.lit("baseline").alias("model"), F.lit(0).alias("seed"), "sample_id", "patient_id", "true_idx", F.array(p[1], p[2], p[0]).alias("p"))
    return v.predictions.select(base.columns).unionByName(base)


@query("c06_paired_table", f"SELECT pair, metric, round(ci_low, 6) + 0.0 AS ci_low, round(ci_high, 6) + 0.0 AS ci_high, round(frac_a_greater, 6) AS frac_a_greater, n_valid FROM ({PAIRS_SQL})")
def c06_paired(v):
    means = resampled(v, rows=with_baseline(v)).groupBy("model", "b", "metric").agg(F.avg("value").alias("value"))
    out = C.paired_intervals(means, "baseline")
    return out.withColumns({c: r6(c) for c in ("ci_low", "ci_high")}).withColumn("frac_a_greater", r6("frac_a_greater"))


ALL_BY_CLASS = class_sql(cells_sql(ALL_SQL, "model, seed"), "model, seed")


def _section(name: str, sql: str, part: str, metric: str, columns: str) -> str:
    return f"SELECT '{name}' AS section, {part} AS part, {metric} AS metric, {columns} FROM ({sql})"


_SPREAD, _NONE = "mean AS value, std AS spread, NULL::DOUBLE AS low, NULL::DOUBLE AS high, n", "NULL::DOUBLE AS low, NULL::DOUBLE AS high"
WHOLE_SQL = " UNION ALL BY NAME ".join(
    (
        _section("headline", spread_sql(long_sql(full_sql(ALL_SQL), "model, seed", FULL_NAMES), "model, metric"), "''", "metric", "model AS name, " + _SPREAD),
        _section("per_class", spread_sql(long_sql(ALL_BY_CLASS, "model, seed, class", ("precision", "recall", "f1")), "model, class, metric"), "CAST(class AS STRING)", "metric", "model AS name, " + _SPREAD),
        _section("stratified", spread_sql(f"SELECT model, seed, bucket, class, recall AS value FROM ({BUCKET_CLASS})", "model, bucket, class"), "bucket || ':' || class", "'recall'", "model AS name, " + _SPREAD),
        _section("calibration", spread_sql(f"SELECT model, seed, ece AS value FROM ({ECE})", "model"), "''", "'ece'", "model AS name, " + _SPREAD),
        _section("confusion", f"SELECT model, true_idx, pred_idx, sum(n) AS n FROM ({cells_sql(ALL_SQL, 'model, seed')}) GROUP BY ALL", "true_idx || ':' || pred_idx", "'n'", f"model AS name, CAST(n AS DOUBLE) AS value, NULL::DOUBLE AS spread, {_NONE}, CAST(n AS BIGINT) AS n"),
        _section("bootstrap", interval_sql(f"SELECT model, b, metric, avg(value) AS value FROM ({resampled_sql()}) GROUP BY ALL", "model, metric"), "''", "metric", "model AS name, NULL::DOUBLE AS value, NULL::DOUBLE AS spread, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high, n_valid AS n"),
        _section("paired", PAIRS_SQL, "''", "metric", "pair AS name, round(frac_a_greater, 6) AS value, NULL::DOUBLE AS spread, round(ci_low, 6) + 0.0 AS low, round(ci_high, 6) + 0.0 AS high, n_valid AS n"),
    )
)


@query("c07_whole_comparison", WHOLE_SQL)
def c07_whole(v):
    """Seed aggregates, intervals, confusion sums and paired tests of all models and the baseline."""
    rows, bucketed = with_baseline(v), with_bucket(v)
    by_class = M.per_class(M.confusion(rows, RUN, K), RUN)
    strata = M.per_class(M.confusion(bucketed, [*RUN, "bucket"], K), [*RUN, "bucket"])
    resamples = resampled(v, rows=rows).groupBy("model", "b", "metric").agg(F.avg("value").alias("value"))
    e = M.calibration_error(M.calibration_bins(v.predictions, RUN), RUN).withColumnRenamed("ece", "value").withColumn("metric", F.lit("ece"))
    sections = {
        "headline": C.seed_spread(M.long_metrics(M.full_headline(rows, RUN, K), RUN, FULL_NAMES), ["model", "metric"]).withColumn("part", F.lit("")),
        "per_class": C.seed_spread(M.long_metrics(by_class, [*RUN, "class"], ("precision", "recall", "f1")), ["model", "class", "metric"]).withColumn("part", F.col("class").cast("string")),
        "stratified": C.seed_spread(M.long_metrics(strata, [*RUN, "bucket", "class"], ("recall",)), ["model", "bucket", "class", "metric"]).withColumn("part", F.concat_ws(":", "bucket", "class")),
        "calibration": C.seed_spread(e, ["model", "metric"]).withColumn("part", F.lit("")),
    }
    parts = [p.select(F.lit(s).alias("section"), "part", "metric", F.col("model").alias("name"), r6("mean").alias("value"), to_digits("std").alias("spread"), "n") for s, p in sections.items()]
    cells = M.confusion(rows, RUN, K).groupBy("model", F.concat_ws(":", "true_idx", "pred_idx").alias("part")).agg(F.sum("n").cast("bigint").alias("n"))
    parts.append(cells.select(F.lit("confusion").alias("section"), "part", F.lit("n").alias("metric"), F.col("model").alias("name"), F.col("n").cast("double").alias("value"), "n"))
    bounds = lambda low, high: [r6(c).alias(n) for c, n in ((low, "low"), (high, "high"))]
    pooled = B.interval(resamples.where("model <> 'baseline'"), ["model", "metric"])
    parts.append(pooled.select(F.lit("bootstrap").alias("section"), F.lit("").alias("part"), "metric", F.col("model").alias("name"), *bounds("low", "high"), F.col("n_valid").alias("n")))
    pairs = C.paired_intervals(resamples, "baseline")
    parts.append(pairs.select(F.lit("paired").alias("section"), F.lit("").alias("part"), "metric", F.col("pair").alias("name"), r6("frac_a_greater").alias("value"), *bounds("ci_low", "ci_high"), F.col("n_valid").alias("n")))
    out = parts[-1].withColumn("spread", F.lit(None).cast("double"))
    for p in parts[:-1]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select("section", "name", "part", "metric", "value", "spread", "low", "high", "n")


# scalar functions over predictions
@query("f01_labels", "SELECT sample_id, label, CAST(label - 1 AS INT) AS idx, ['no', 'few', 'many'][label] AS name FROM fx_samples UNION ALL SELECT -1, 9, NULL, NULL")
def f01(v):
    extra = v.spark.range(1).select(F.lit(-1).cast("bigint").alias("sample_id"), F.lit(9).alias("label"))
    rows = v.samples.select("sample_id", "label").unionByName(extra)
    return rows.select("sample_id", "label", S.label_to_index(F.col("label"), [1, 2, 3]).alias("idx"), S.label_to_name(F.col("label"), {1: "no", 2: "few", 3: "many"}).alias("name"))


@query("f06_argmax", f"SELECT model, seed, sample_id, CAST({_argmax('round(p0, 1)', 'round(p1, 1)', 'round(p2, 1)')} AS INT) AS pred_idx FROM fx_predictions")
def f06(v):
    return v.predictions.select(*RUN, "sample_id", M.argmax(F.transform("p", lambda x: F.round(x, 1))).alias("pred_idx"))


@query("f07_softmax", "SELECT model, seed, sample_id, round(exp(p0 - m) / t, 6) AS s0, round(exp(p1 - m) / t, 6) AS s1, round(exp(p2 - m) / t, 6) AS s2 FROM (SELECT *, greatest(p0, p1, p2) AS m, exp(p0 - m) + exp(p1 - m) + exp(p2 - m) AS t FROM fx_predictions)")
def f07(v):
    s = M.softmax(F.col("p"))
    return v.predictions.select(*RUN, "sample_id", s.alias("s")).select(*RUN, "sample_id", *[r6(F.col("s")[k]).alias(f"s{k}") for k in range(3)])


@query("f08_renormalize", "SELECT model, seed, sample_id, round(p0 * 0.5 / t, 6) AS q0, round(p1 / t, 6) AS q1, round(p2 * 2 / t, 6) AS q2 FROM (SELECT *, p0 * 0.5 + p1 + p2 * 2 AS t FROM fx_predictions)")
def f08(v):
    q = M.renormalized(F.array(F.col("p")[0] * 0.5, F.col("p")[1], F.col("p")[2] * 2))
    return v.predictions.select(*RUN, "sample_id", q.alias("q")).select(*RUN, "sample_id", *[r6(F.col("q")[k]).alias(f"q{k}") for k in range(3)])


@query("f09_size_bucket", f"SELECT sample_id, size, {SIZE} AS bucket FROM ({SIZES_SQL})")
def f09(v):
    return sizes(v).withColumn("bucket", S.size_bucket(F.col("size"), 20, 24))


@query("f10_row_percent", f"SELECT model, seed, true_idx, pred_idx, round(coalesce(100.0 * n / nullif(sum(n) OVER (PARTITION BY model, seed, true_idx), 0), 0), 6) AS percent FROM ({CELLS})")
def f10(v):
    return rounded(S.row_percent(M.confusion(v.predictions, RUN, K), [*RUN, "true_idx"]), "percent").select(*RUN, "true_idx", "pred_idx", "percent")


def _bad_rows(v) -> DataFrame:
    return v.spark.createDataFrame([(-1, 0, [0.5, 0.3, 0.1]), (-2, 1, [float("nan"), 0.5, 0.5]), (-3, 7, [0.2, 0.3, 0.5]), (-4, 2, [1.5, -0.5, 0.0])], "sample_id bigint, true_idx int, p array<double>")


@query("v08_probability_rows", """WITH x AS (SELECT model, seed, CAST(sample_id AS BIGINT) AS sample_id, true_idx, p0, p1, p2 FROM fx_predictions
UNION ALL VALUES ('x', 0, -1, 0, 0.5, 0.3, 0.1), ('x', 0, -2, 1, CAST('nan' AS DOUBLE), 0.5, 0.5), ('x', 0, -3, 7, 0.2, 0.3, 0.5), ('x', 0, -4, 2, 1.5, -0.5, 0.0))
SELECT model, seed, sample_id, CASE WHEN isnan(p0) OR isnan(p1) OR isnan(p2) THEN 'not_finite' WHEN least(p0, p1, p2) < 0 THEN 'negative' WHEN abs(p0 + p1 + p2 - 1) > 1e-5 THEN 'row_sum' WHEN true_idx NOT BETWEEN 0 AND 2 THEN 'label' END AS rule FROM x
WHERE rule IS NOT NULL""")
def v08(v):
    """Bad rows of every run, and four planted ones of a run of their own."""
    from ..operators.quality import probability_violations

    planted = _bad_rows(v).withColumns({"model": F.lit("x"), "seed": F.lit(0)})
    rows = v.predictions.select(*RUN, "sample_id", "true_idx", "p").unionByName(planted)
    return probability_violations(rows, K).select(*RUN, "sample_id", "rule")


# pairing, registration and choice
@query("j12_registered_hash", "WITH f AS (SELECT model, seed, md5(string_agg(CAST(sample_id AS STRING) || ':' || CAST(true_idx AS STRING), ',' ORDER BY sample_id)) AS h FROM fx_predictions GROUP BY ALL), r AS (SELECT model, seed, CASE WHEN seed = 44 THEN 'x' ELSE h END AS r FROM f WHERE NOT (model = 'b' AND seed = 43)) SELECT model, seed, CASE WHEN r IS NULL THEN 'unregistered' WHEN r <> h THEN 'mismatch' ELSE 'ok' END AS status FROM f LEFT JOIN r USING (model, seed)")
def j12(v):
    named = v.predictions.select(*RUN, F.col("sample_id").cast("string").alias("name"), F.col("true_idx").cast("string").alias("true"))
    found = merkle_roots(named, RUN, "name", "true").drop("n")
    registered = found.where("NOT (model = 'b' AND seed = 43)").select(*RUN, F.when(F.col("seed") == 44, "x").otherwise(F.col("digest")).alias("registered"))
    return C.registration_status(found, registered, RUN)


@query("j13_paired_predictions", f"SELECT a.seed, a.sample_id, a.true_idx, {_argmax('a.p0', 'a.p1', 'a.p2')} AS pred_a, {_argmax('b.p0', 'b.p1', 'b.p2')} AS pred_b FROM fx_predictions a JOIN fx_predictions b ON a.model = 'a' AND b.model = 'b' AND a.seed = b.seed AND a.sample_id = b.sample_id")
def j13(v):
    one = lambda m: v.predictions.where(F.col("model") == m).select("seed", "sample_id", "true_idx", M.argmax(F.col("p")).alias(f"pred_{m}"))
    return one("a").join(one("b").drop("true_idx"), ["seed", "sample_id"])


@query("j14_model_pairs", "WITH m AS (SELECT DISTINCT model || '-' || seed AS model FROM fx_predictions) SELECT a.model AS left_model, b.model AS right_model FROM m a JOIN m b ON a.model < b.model UNION ALL SELECT model, 'baseline' FROM m")
def j14(v):
    m = v.predictions.select(F.concat_ws("-", "model", F.col("seed").cast("string")).alias("model")).distinct()
    return C.model_pairs(m, "baseline")


@query("m09_promotion", f"WITH l AS ({LONG}), x AS (SELECT a.seed, max(b.value - a.value) FILTER (a.metric = 'macro_f1') AS gain, max(b.value - a.value) FILTER (a.metric = 'balanced_accuracy') AS bal, max(b.value - a.value) FILTER (a.metric = 'macro_recall') AS watched FROM l a JOIN l b ON a.model = 'a' AND b.model = 'b' AND a.seed = b.seed AND a.metric = b.metric GROUP BY ALL) SELECT seed, CASE WHEN gain >= 0.01 OR (gain > 0 AND bal > 0 AND watched > 0) THEN 'b' ELSE 'a' END AS chosen FROM x")
def m09(v):
    return C.promotion(long_full(v), "a", "b", watched="macro_recall").select("seed", "chosen")


@query("m12_reload", "SELECT a.model, a.seed, round(max(greatest(abs(a.p0 - b.p0), abs(a.p1 - b.p1), abs(a.p2 - b.p2))), 6) AS max_abs_diff, count(*) AS n FROM fx_predictions a JOIN (SELECT * REPLACE (p0 + sample_id * 1e-5 AS p0) FROM fx_predictions) b USING (model, seed, sample_id) GROUP BY ALL")
def m12(v):
    again = v.predictions.withColumn("p", F.array(F.col("p")[0] + F.col("sample_id") * 1e-5, F.col("p")[1], F.col("p")[2]))
    return rounded(C.reload_difference(v.predictions, again, [*RUN, "sample_id"], RUN), "max_abs_diff")


@query("t03_leaderboard", f"SELECT model, seed, round(macro_f1, 6) AS macro_f1, row_number() OVER (ORDER BY macro_f1 DESC, model, seed) AS place FROM ({FULL})")
def t03(v):
    place = F.row_number().over(Window.orderBy(F.desc("macro_f1"), "model", "seed"))
    return rounded(full(v).select(*RUN, "macro_f1", place.cast("bigint").alias("place")), "macro_f1")


@query("t04_examples", f"WITH x AS (SELECT model, seed, sample_id, true_idx = {_argmax()} AS correct FROM fx_predictions), r AS (SELECT *, row_number() OVER (PARTITION BY model, seed, correct ORDER BY sample_id) AS k FROM x) SELECT model, seed, sample_id, correct FROM r WHERE (correct AND k <= 3) OR (NOT correct AND k = 1)")
def t04(v):
    rows = v.predictions.select(*RUN, "sample_id", (M.argmax(F.col("p")) == F.col("true_idx")).alias("correct"))
    return C.examples(rows, RUN, 4)


@query("j11_readiness", "WITH s AS (SELECT model, list_sort(list(DISTINCT seed)) AS seeds FROM fx_predictions WHERE NOT (model = 'b' AND seed = 44) GROUP BY model), r AS (SELECT m.model, coalesce(s.seeds = [42, 43, 44], false) AS ready FROM (VALUES ('a'), ('b'), ('c')) m(model) LEFT JOIN s USING (model)) SELECT model, ready, bool_and(ready) OVER () AS all_ready FROM r")
def j11(v):
    study = v.spark.createDataFrame([("a",), ("b",), ("c",)], "model string")
    found = v.predictions.where("NOT (model = 'b' AND seed = 44)").groupBy("model").agg(F.sort_array(F.collect_set("seed")).alias("seeds"))
    return C.readiness(study, found, [42, 43, 44])


@query("s07_expected_runs", "SELECT e.model, e.seed, p.n IS NULL AS missing, coalesce(p.n, 0) AS n FROM (SELECT * FROM (VALUES ('a'), ('b'), ('c')) m(model), (VALUES (42), (43), (44)) s(seed)) e LEFT JOIN (SELECT model, seed, count(*) AS n FROM fx_predictions GROUP BY ALL) p USING (model, seed)")
def s07(v):
    expected = v.spark.createDataFrame([(m, s) for m in "abc" for s in (42, 43, 44)], "model string, seed int")
    found = v.predictions.groupBy(*RUN).agg(F.count("*").alias("n"))
    return expected.join(found, RUN, "left").select(*RUN, F.col("n").isNull().alias("missing"), F.coalesce("n", F.lit(0)).alias("n"))
