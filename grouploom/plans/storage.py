"""Queries that write tables derived from the input and scan them again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources import tables as IO
from .evaluation import CELLS, HEAD, RUN, K, rounded
from .registry import query
from .tables import SPLIT_ROWS, split_rows


@query("s01_sample_files", "SELECT CAST(label AS BIGINT) AS number, count(*) AS n FROM fx_samples GROUP BY 1")
def s01(v):
    """One folder per class, named by its number; files are found by name and counted by rows."""
    path = IO.scratch_path(v.spark, "raw")
    v.samples.select("label", F.concat_ws(",", "sample_id", "patient_id").alias("value")).write.partitionBy("label").text(path)
    found = v.spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.regexp_extract(F.input_file_name(), r"/label=([0-9]+)/", 1).cast("bigint").alias("number"))
    return found.groupBy("number").agg(F.count("*").alias("n"))


@query("s01_found_files", "SELECT CAST(s_suppkey AS BIGINT) AS number, CAST(s_suppkey % 4 AS INT) AS folder FROM supplier WHERE s_suppkey > 0")
def s01_found(v):
    """One text file per supplier, named by its number, in folders; an index and another file, which
    aren't samples, lie among them. Spark's committer names files, so the folders carry the names."""
    path = IO.scratch_path(v.spark, "found")
    rows = v.table("supplier").select((F.col("s_suppkey") % 4).alias("folder"), F.concat(F.col("s_suppkey").cast("string"), F.lit(".sample")).alias("file"), F.col("s_name").alias("value"))
    other = rows.limit(2).select("folder", F.when(F.col("folder") >= 0, "index.sample").alias("file"), "value").unionByName(rows.limit(1).select("folder", F.lit("notes7.sample").alias("file"), "value"))
    # a file a row: tasks of few files each, which they put in place themselves instead of the driver
    tasks = max(v.spark.sparkContext.defaultParallelism, rows.count() // 500 + 1)
    dealt = rows.unionByName(other).repartition(tasks, "file")
    dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("folder", "file").text(path)
    found = IO.sample_files(v.spark, path, ".sample", "index.sample", by_folder="file=")
    return found.select("number", F.regexp_extract("path", r"/folder=([0-9]+)/", 1).cast("int").alias("folder")).where("number > 0")


@query("s02_typed_csv", f"SELECT sample_id, '00' || CAST(sample_id % 12 AS STRING) AS patient_id, label, split FROM {SPLIT_ROWS}")
def s02(v):
    """Group ids that look like numbers stay text."""
    path = IO.scratch_path(v.spark, "split")
    rows = split_rows(v).withColumn("patient_id", F.concat(F.lit("00"), (F.col("sample_id") % 12).cast("string")))
    rows.write.option("header", True).csv(path)
    return IO.typed_csv(v.spark, path, IO.SPLIT_SCHEMA, ["sample_id", "patient_id", "label", "split"])


def _records(v) -> DataFrame:
    """Experiment records of all runs, seed 43 in the older layout, written one file each."""
    cells = M.confusion(v.predictions, RUN, K)
    row = F.transform(F.sort_array(F.collect_list(F.struct("pred_idx", "n"))), lambda x: x["n"].cast("bigint"))
    matrix = F.transform(F.sort_array(F.collect_list(F.struct("true_idx", "row"))), lambda x: x["row"])
    matrices = cells.groupBy(*RUN, "true_idx").agg(row.alias("row")).groupBy(*RUN).agg(matrix.alias("matrix"))
    head = M.headline(M.per_class(cells, RUN), RUN, K).join(matrices, RUN)
    metrics, name, old = F.struct("accuracy", "macro_f1", "balanced_accuracy"), F.concat_ws("-", "model", F.col("seed").cast("string")), F.col("seed") == 43
    settings = F.struct(F.when(F.col("seed") == 44, 100).otherwise(2000).cast("bigint").alias("n"), F.lit(42).cast("bigint").alias("seed"), F.lit(0.05).alias("alpha"))
    records = head.select(
        name.alias("run"), F.when(~old, name).alias("experiment"), F.when(old, name).alias("name"), F.when(~old, metrics).alias("metrics"), F.when(old, metrics).alias("test_metrics"),
        F.when(~old, F.col("matrix")).alias("confusion"), F.when(old, F.col("matrix")).alias("test_confusion_matrix"), settings.alias("bootstrap"),
    )
    path = IO.scratch_path(v.spark, "runs")
    records.repartition("run").write.partitionBy("run").json(path)
    return IO.experiment_records(v.spark, path)


@query("s06_experiment_records", f"SELECT model || '-' || seed AS experiment, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(balanced_accuracy, 6) AS balanced_accuracy, hits FROM ({HEAD}) JOIN (SELECT model, seed, CAST(sum(n) FILTER (true_idx = pred_idx) AS BIGINT) AS hits FROM ({CELLS}) GROUP BY ALL) USING (model, seed)")
def s06(v):
    hits = sum((F.col("confusion")[k][k] for k in range(K)), F.lit(0).cast("bigint"))
    return rounded(_records(v).select("experiment", "accuracy", "macro_f1", "balanced_accuracy", hits.alias("hits")), "accuracy", "macro_f1", "balanced_accuracy")


@query("v10_record_violations", "SELECT 'bootstrap_settings' AS rule, model || '-' || seed AS key FROM (SELECT DISTINCT model, seed FROM fx_predictions) WHERE seed = 44")
def v10(v):
    return IO.record_violations(_records(v), K, {"n": 2000, "seed": 42, "alpha": 0.05})


@query("s08_result_tables", f"SELECT model, seed, round(accuracy, 6) AS accuracy, CASE WHEN seed = 44 THEN NULL ELSE round(macro_f1, 6) END AS macro_f1, 'r1' AS run_id FROM ({HEAD})")
def s08(v):
    """NaN becomes null on the way to the sink."""
    path = IO.scratch_path(v.spark, "results")
    head = M.headline(M.per_class(M.confusion(v.predictions, RUN, K), RUN), RUN, K).select(*RUN, "accuracy", F.when(F.col("seed") == 44, float("nan")).otherwise(F.col("macro_f1")).alias("macro_f1"))
    IO.write_results({"headline": head.limit(2)}, path, "r1")
    IO.write_results({"headline": head}, path, "r1")  # again, after a part
    return rounded(IO.read_results(v.spark, path, "headline"), "accuracy", "macro_f1")


@query("i03_file_digests", "SELECT label, CAST(sample_id // 64 AS BIGINT) AS part, sha256(string_agg(sample_id || ',' || patient_id || chr(10), '' ORDER BY sample_id)) AS sha256 FROM fx_samples GROUP BY ALL")
def i03(v):
    """A file for every class and range of ids, so that no task writes or reads a whole class."""
    from ..operators.integrity import file_digests

    path = IO.scratch_path(v.spark, "digests")
    part = F.floor(F.col("sample_id") / 64)
    rows = v.samples.select("label", part.alias("part"), "sample_id", F.concat_ws(",", "sample_id", "patient_id").alias("value"))
    rows.repartition("label", "part").sortWithinPartitions("label", "part", "sample_id").select("label", "part", "value").write.partitionBy("label", "part").text(path)
    files = v.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    number = lambda k, t: F.regexp_extract("path", rf"/{k}=([0-9]+)/", 1).cast(t).alias(k)
    return file_digests(files).select(number("label", "int"), number("part", "bigint"), "sha256")


STATES = "(SELECT unnest(['a', 'a', 'a', 'b', 'b', 'b', 'old', 'none']) AS model, unnest([42, 43, 44, 42, 43, 44, -1, -1]) AS seed)"
OLD = "SELECT 'old' AS model, -1 AS seed, sample_id, patient_id, true_idx, p0, p1, p2 FROM fx_predictions WHERE model = 'a' AND seed = 42"
STUDY = f"(SELECT * FROM fx_predictions WHERE model <> 'b' OR seed <> 44 UNION ALL {OLD})"


def first_run(history: DataFrame) -> DataFrame:
    """Rows of the run with the least id: as a value, the id goes into the scan, below the window that
    numbers epochs."""
    return history.where(F.col("run_id") == F.lit(history.agg(F.min("run_id")).first()[0]))


@query("s07_study_loader", f"""WITH s AS (SELECT * FROM {STUDY}), r AS (SELECT model, seed, count(*) AS n, avg(CASE WHEN (CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END) = true_idx THEN 1.0 ELSE 0.0 END) AS accuracy FROM s GROUP BY ALL),
h AS (SELECT count(*) AS n FROM fx_history WHERE run_id = (SELECT min(run_id) FROM fx_history))
SELECT e.model, e.seed, CASE WHEN r.n IS NULL THEN 'missing' WHEN e.seed = -1 THEN 'older' ELSE 'complete' END AS state, coalesce(r.n, 0) AS n_predictions, CASE WHEN r.n IS NULL THEN 0 ELSE h.n END AS n_epochs, round(r.accuracy, 6) AS recomputed, round(r.accuracy - CASE WHEN e.seed = 43 THEN 0.25 ELSE 0 END, 6) AS recorded FROM {STATES} e LEFT JOIN r USING (model, seed), h""")
def s07_study(v):
    """A study is written as folders of files: two models of three seeds (one of them lost, numbers of seed
    43 recorded wrongly) and an older one without seeds; then it is loaded, and the numbers of its records
    are computed again from its predictions."""
    root = IO.scratch_path(v.spark, "study")
    old = v.predictions.where("model = 'a' AND seed = 42").withColumns({"model": F.lit("old"), "seed": F.lit(-1)})
    rows = v.predictions.where("model <> 'b' OR seed <> 44").unionByName(old).select(*RUN, "sample_id", "true_idx", *[F.col("p")[k].alias(f"p{k}") for k in range(K)])
    # written seven times
    epochs = first_run(v.history).select("epoch", "val_macro_f1", "val_loss").persist()
    head = {tuple(r[c] for c in RUN): r for r in M.headline(M.per_class(M.confusion(rows.withColumn("p", F.array(*[f"p{k}" for k in range(K)])), RUN, K), RUN), RUN, K).collect()}
    rows = rows.persist()
    for (model, seed), r in head.items():
        folder = f"{root}/{model}" + (f"/seed{seed}" if seed >= 0 else "")
        own = rows.where((F.col("model") == model) & (F.col("seed") == seed)).drop(*RUN)
        numbers = {"accuracy": r["accuracy"] - (0.25 if seed == 43 else 0), "macro_f1": r["macro_f1"], "balanced_accuracy": r["balanced_accuracy"]}
        record = v.spark.createDataFrame([(json.dumps({"test_metrics" if seed < 0 else "metrics": numbers}),)], "value string")
        for name, df, kind in (("predictions.csv", own, "csv"), ("history.csv", epochs, "csv"), ("metrics.json", record, "text")):
            IO.write_as(df, folder, name, kind)
    rows.unpersist()
    epochs.unpersist()
    study = IO.load_study(v.spark, root, K)
    again = M.headline(M.per_class(M.confusion(study["predictions"], RUN, K), RUN), RUN, K).select(*RUN, F.col("accuracy").alias("recomputed"))
    count = lambda t, c: study[t].groupBy(*RUN).agg(F.count("*").alias(c))
    expected = v.spark.createDataFrame([(m, s) for m in "ab" for s in (42, 43, 44)] + [("old", -1), ("none", -1)], "model string, seed int")
    out = expected.join(count("predictions", "n_predictions"), RUN, "left").join(count("history", "n_epochs"), RUN, "left").join(study["records"], RUN, "left").join(again, RUN, "left")
    state = F.when(F.col("n_predictions").isNull(), "missing").when(F.col("older"), "older").otherwise("complete")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rounded(out.select(*RUN, state.alias("state"), zero("n_predictions"), zero("n_epochs"), "recomputed", F.col("accuracy").alias("recorded")), "recomputed", "recorded")


@query("j07_incremental_conversion", "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'failed' ELSE 'converted' END AS status, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE length(text) END AS n_chars FROM documents WHERE text IS NOT NULL AND doc_id % 20 < 9")
def j07_incremental(v):
    """A folder that grows between three calls; every file is dealt with once."""
    source, target = IO.scratch_path(v.spark, "incoming"), IO.scratch_path(v.spark, "converted")
    docs = v.table("documents").where("text IS NOT NULL").select("doc_id", "text")
    for k in range(3):
        part = docs.where((F.col("doc_id") % 20 >= 3 * k) & (F.col("doc_id") % 20 < 3 * k + 3))
        body = F.when(F.col("doc_id") % 9 == 0, "{").otherwise(F.to_json(F.struct("doc_id", "text")))
        part.select((F.col("doc_id") % 5).alias("part"), F.concat(F.col("doc_id").cast("string"), F.lit("\t"), body).alias("value")).write.mode("append").partitionBy("part").text(source)
        IO.convert_new(v.spark, source, target, _converted)
    return IO.converted(v.spark, target, "doc_id bigint, status string, n_chars bigint")


def _converted(files):
    """A row per line (id, tab, JSON): the text's length, or 'failed' where the JSON can't be read."""
    lines = files.select(F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line")).where("line <> ''")
    text = F.get_json_object(F.substring_index("line", "\t", -1), "$.text")
    return lines.select(F.substring_index("line", "\t", 1).cast("bigint").alias("doc_id"), F.when(text.isNull(), "failed").otherwise("converted").alias("status"), F.char_length(text).cast("bigint").alias("n_chars"))
