"""Typed scans and sinks: sample files, CSV tables, experiment records, result tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT_SCHEMA = "sample_id bigint, patient_id string, label int, split string"
PREDICTION_SCHEMA = "sample_id bigint, patient_id string, true_idx int, p array<double>"

_METRICS = "struct<accuracy:double,macro_f1:double,balanced_accuracy:double>"
RECORD_SCHEMA = f"experiment string, name string, model string, metrics {_METRICS}, test_metrics {_METRICS}, confusion array<array<bigint>>, test_confusion_matrix array<array<bigint>>, bootstrap struct<n:bigint,seed:bigint,alpha:double>"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; a temporary one where that is unset, on a
    local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-grouploom-")
    return f"{base.rstrip('/')}/grouploom-{uuid.uuid4().hex}/{name}"


def sample_files(spark: SparkSession, root: str, suffix: str, index_name: str, by_folder: str | None = None) -> DataFrame:
    """path, length, number of the digit-named files below ``root``, without the index file, in the
    order of their numbers. Contents aren't read. With ``by_folder``, a prefix, samples are what lies
    in folders of such names (as a partitioned sink writes them)."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (read if by_folder else read.option("pathGlobFilter", f"*{suffix}")).load(root).select("path", "length")
    name = F.regexp_extract("path", rf"/{by_folder}([^/]+)/[^/]+$" if by_folder else r"/([^/]+)$", 1)
    stem = F.regexp_extract(name, rf"^([0-9]+){suffix.replace('.', '[.]')}$", 1)
    numbered = found.withColumn("number", F.when(stem != "", stem.cast("bigint")))
    return numbered.where(F.col("number").isNotNull() & (name != index_name)).orderBy("number", "path")


def typed_csv(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """A CSV scan by explicit types: numeric-looking group ids stay text. Missing columns raise."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in required if c not in header]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    types = dict(x.split() for x in schema.split(", "))
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*[F.col(c).cast(types[c]).alias(c) for c in header if c in types])


def experiment_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per result JSON in either layout: metrics and matrix at the top or under test_*."""
    raw = spark.read.schema(RECORD_SCHEMA).option("multiLine", True).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    m = lambda c: F.coalesce(F.col(f"metrics.{c}"), F.col(f"test_metrics.{c}")).alias(c)
    return raw.select(F.coalesce("experiment", "name", "model").alias("experiment"), m("accuracy"), m("macro_f1"), m("balanced_accuracy"), F.coalesce("confusion", "test_confusion_matrix").alias("confusion"), "bootstrap")


def record_violations(records: DataFrame, classes: int, bootstrap: dict[str, float]) -> DataFrame:
    """rule, key: records without metrics, without a square matrix, or with other settings."""
    square = F.coalesce((F.size("confusion") == classes) & F.forall("confusion", lambda r: F.size(r) == classes), F.lit(False))
    other = ~F.coalesce((F.col("bootstrap.n") == bootstrap["n"]) & (F.col("bootstrap.seed") == bootstrap["seed"]) & (F.col("bootstrap.alpha") == bootstrap["alpha"]), F.lit(False))
    rules = {"missing_metric": F.col("accuracy").isNull() | F.col("macro_f1").isNull(), "matrix_shape": ~square, "bootstrap_settings": other}
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules.items()]))
    return records.select(F.explode(broken).alias("rule"), F.col("experiment").alias("key"))


MANIFEST = "manifest"


def write_results(tables: dict[str, DataFrame], path: str, run_id: str) -> None:
    """Result tables of a run, one folder per table, the run as partition; NaN becomes null.

    A run's partition replaces what an earlier attempt left of it, and its row of the manifest is written
    last: the same run written twice, or again after a crash, is there once, and a run that never ended
    isn't read."""
    spark, counts = None, []
    for name, df in tables.items():
        if name == MANIFEST:
            raise ValueError("the manifest is written by itself")
        spark = df.sparkSession
        clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
        _replace(df.select(*clean, F.lit(run_id).alias("run_id")), f"{path}/{name}")
        counts.append((name, run_id))
    if counts:
        _replace(spark.createDataFrame(counts, "table string, run_id string"), f"{path}/{MANIFEST}")


def _replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_as(df: DataFrame, folder: str, name: str, kind: str) -> None:
    """``df``, a small table, as the one file ``name`` in ``folder``."""
    spark = df.sparkSession
    writer = df.coalesce(1).write.mode("overwrite")
    part = f"{folder}/.{name}"
    (writer.option("header", True).csv if kind == "csv" else writer.text)(part)
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(part).getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(hadoop.Path(f"{part}/part-*"))[0].getPath()
    files.rename(found, hadoop.Path(f"{folder}/{name}"))
    files.delete(hadoop.Path(part), True)


def read_results(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of a result table whose run ended."""
    ended = spark.read.parquet(f"{path}/{MANIFEST}").where(F.col("table") == name).select(F.col("run_id").cast("string").alias("run_id")).distinct()
    rows = spark.read.parquet(f"{path}/{name}")
    return rows.withColumn("run_id", F.col("run_id").cast("string")).join(ended, "run_id", "left_semi").select(rows.columns)


# --- studies: folders of model runs


def load_study(spark: SparkSession, root: str, classes: int) -> dict[str, DataFrame]:
    """Tables of a folder ``root/<model>/seed<n>/`` of predictions.csv, history.csv and metrics.json:
    predictions, history and records, each with model and seed. A model without seeds (files right below
    its folder, metrics in the older layout) has seed -1."""

    def keyed(rows: DataFrame) -> DataFrame:
        at = F.col("_metadata.file_path")
        seed = F.regexp_extract(at, r"/seed([0-9]+)/[^/]+$", 1)
        model = F.regexp_extract(at, r"/([^/]+)(?:/seed[0-9]+)?/[^/]+$", 1)
        return rows.select(model.alias("model"), F.when(seed == "", -1).otherwise(seed.cast("int")).alias("seed"), *[c for c in rows.columns if c not in ("model", "seed")])

    files = lambda name: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name)
    types = "sample_id bigint, true_idx int, " + ", ".join(f"p{k} double" for k in range(classes))
    predictions = keyed(files("predictions.csv").option("header", True).option("enforceSchema", False).schema(types).csv(root))
    history = keyed(files("history.csv").option("header", True).option("enforceSchema", False).schema("epoch bigint, val_macro_f1 double, val_loss double").csv(root))
    records = keyed(files("metrics.json").schema(RECORD_SCHEMA).option("multiLine", True).json(root))
    number = lambda c: F.coalesce(F.col(f"metrics.{c}"), F.col(f"test_metrics.{c}")).alias(c)
    return {
        "predictions": predictions.select("model", "seed", "sample_id", "true_idx", F.array(*[f"p{k}" for k in range(classes)]).alias("p")), "history": history,
        "records": records.select("model", "seed", number("accuracy"), number("macro_f1"), F.col("metrics").isNull().alias("older")),
    }


# --- folders that grow


def convert_new(spark: SparkSession, source: str, target: str, convert) -> None:
    """Deals with the files that ``source`` gained since the last call: a stream over the folder, with its
    progress and its table below ``target``. ``convert`` maps a table (path, content) to
    the rows to keep, bad files as rows with a status of their own. Every file is met
    once, over any number of calls and restarts: a batch replaces its own partition, so one that died
    midway leaves nothing double. Spark's scan leaves out files without content."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").load(source)

    def keep(batch: DataFrame, number: int) -> None:
        done = convert(batch.select("path", "content"))
        done.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{target}/table")

    stream = files.writeStream.foreachBatch(keep).option("checkpointLocation", f"{target}/progress").trigger(availableNow=True).start()
    stream.awaitTermination()


def converted(spark: SparkSession, target: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch int").parquet(f"{target}/table").drop("batch")
