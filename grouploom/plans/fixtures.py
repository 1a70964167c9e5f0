"""Views over the driver's tables that feed the queries, for Spark and as SQL.

``Views(spark, sf_dir)`` builds each view on first use; ``with_views(sql)`` puts the same views, as
common table expressions, before a query's SQL.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (model, seed, offset of its three logits in the vector)
MODELS = [("a", 42, 0), ("a", 43, 3), ("a", 44, 6), ("b", 42, 9), ("b", 43, 12), ("b", 44, 15)]
CO_NAMES = [f"glcm_{p}_d{d}_a{a}" for p in ("contrast", "energy") for d in (1, 2) for a in (0, 45, 90, 135)]
LBP_NAMES = [f"lbp_{k}" for k in range(16)]


def hash_fraction(*parts) -> Column:
    """md5 of the parts joined by ':', its first 8 hex digits as a number below 2**32."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def samples(self) -> DataFrame:
        x = F.col("embedding")
        return self.table("embeddings").select(
            (F.col("vec_id") + 1).alias("sample_id"), self._patient(), (F.col("label") % 3 + 1).cast("int").alias("label"), F.lit(8).alias("height"), F.lit(8).alias("width"),
            F.transform(x, lambda v: F.when(v > 0, F.round(v.cast("double") * 10000).cast("int")).otherwise(0)).alias("image_raw"),
            F.transform(x, lambda v: F.when(v.cast("double") > 0.05, 1).otherwise(0)).alias("tumor_mask"),
        )

    @staticmethod
    def _patient() -> Column:
        return F.concat(F.lit("P"), (F.col("label") % 3 + 1).cast("string"), F.lit("_"), (F.col("vec_id") % 12).cast("string")).alias("patient_id")

    @cached_property
    def split(self) -> DataFrame:
        from ..operators.splits import assign_group_splits

        return assign_group_splits(self.samples.select("patient_id", "label"), seed=42)

    @cached_property
    def predictions(self) -> DataFrame:
        models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).alias("seed"), F.lit(o).alias("o")) for m, s, o in MODELS]))
        rows = self.table("embeddings").select("vec_id", "label", "embedding", models.alias("m"))
        logit = [F.exp(F.element_at("embedding", F.col("m.o") + k).cast("double") * 10).alias(f"e{k - 1}") for k in (1, 2, 3)]
        rows = rows.select("m.model", "m.seed", (F.col("vec_id") + 1).alias("sample_id"), self._patient(), (F.col("label") % 3).cast("int").alias("true_idx"), *logit)
        return self._shares(rows, ["model", "seed", "sample_id", "patient_id", "true_idx"])

    @staticmethod
    def _shares(rows: DataFrame, keep: list[str]) -> DataFrame:
        total = F.col("e0") + F.col("e1") + F.col("e2")
        return rows.select(*keep, F.array(*[F.col(f"e{k}") / total for k in range(3)]).alias("p"))

    @cached_property
    def pred_large(self) -> DataFrame:
        true = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
        rows = self.table("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("patient_id"), true.alias("true_idx"),
            F.exp(F.col("l_quantity") / 50).alias("e0"), F.exp(F.col("l_discount") * 10).alias("e1"), F.exp(F.col("l_tax") * 12.5).alias("e2"),
        )
        return self._shares(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "patient_id", "true_idx"])

    @cached_property
    def orders(self) -> DataFrame:
        joined = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return joined.select((F.col("o_orderkey") + 1).alias("sample_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("patient_id"), F.col("c_mktsegment").alias("label"), F.col("o_totalprice").alias("size"))

    @cached_property
    def history(self) -> DataFrame:
        from pyspark.sql import Window

        # partitioned by the column that the view gives, so that a choice of runs goes into the scan
        epoch = (F.row_number().over(Window.partitionBy("run_id").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))) - 1).cast("bigint").alias("epoch")
        rows = self.table("events").select(F.col("user_id").alias("run_id"), "ts", "event_id", (F.col("value") / 100).alias("val_macro_f1"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("val_loss"))
        return rows.select("run_id", epoch, "val_macro_f1", "val_loss")

    @cached_property
    def candidates(self) -> DataFrame:
        cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
        return self.table("part").select(F.col("p_partkey").alias("candidate_id"), F.col("p_brand").alias("weighting_mode"), F.col("p_size").alias("max_depth"), ((cents % 97) / 97.0).alias("macro_f1"), ((cents % 89) / 89.0).alias("balanced_accuracy"))

    @cached_property
    def files(self) -> DataFrame:
        part = F.when(F.substring(F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string")).cast("binary")), 1, 1) < "b", "train").otherwise("test")
        return self.table("documents").select("doc_id", F.concat(F.lit("d/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("content_sha256"), part.alias("split"), "text")

    @cached_property
    def timings(self) -> DataFrame:
        return self.table("events").select(F.col("event_type").alias("batch"), F.col("value").alias("ms"))

    def _features(self, names: list[str], first: int) -> DataFrame:
        base = self.table("embeddings").select((F.col("vec_id") + 1).alias("sample_id"), self._patient(), (F.col("label") % 3 + 1).cast("int").alias("label"), "embedding")
        wide = base.join(self.split.select("patient_id", "split"), "patient_id")
        return wide.select("sample_id", "patient_id", "label", "split", *[F.element_at("embedding", first + k).cast("double").alias(n) for k, n in enumerate(names)])

    @cached_property
    def features_a(self) -> DataFrame:
        return self._features(CO_NAMES, 1)

    @cached_property
    def features_b(self) -> DataFrame:
        return self._features(LBP_NAMES, 17)


_MODELS = ", ".join(str(m) for m in MODELS)


def _feature_sql(names: list[str], first: int) -> str:
    columns = ", ".join(f"CAST(embedding[{first + k}] AS DOUBLE) AS {n}" for k, n in enumerate(names))
    return f"""SELECT vec_id + 1 AS sample_id, s.patient_id, s.label, s.split, {columns}
FROM embeddings JOIN fx_split s ON s.patient_id = 'P' || CAST(embeddings.label % 3 + 1 AS STRING) || '_' || CAST(vec_id % 12 AS STRING)"""


#: View -> SQL; a view may use those above it.
SQL = {
    "fx_samples": """SELECT vec_id + 1 AS sample_id, 'P' || CAST(label % 3 + 1 AS STRING) || '_' || CAST(vec_id % 12 AS STRING) AS patient_id, CAST(label % 3 + 1 AS INT) AS label, 8 AS height, 8 AS width,
 list_transform(embedding, lambda x: CASE WHEN x > 0 THEN CAST(round(CAST(x AS DOUBLE) * 10000) AS INT) ELSE 0 END) AS image_raw,
 list_transform(embedding, lambda x: CASE WHEN CAST(x AS DOUBLE) > 0.05 THEN 1 ELSE 0 END) AS tumor_mask FROM embeddings""",
    "fx_split": """WITH g AS (SELECT DISTINCT patient_id, label FROM fx_samples), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || patient_id)) rn, count(*) OVER (PARTITION BY label) n FROM g)
SELECT patient_id, label, CASE WHEN rn <= round_even(n * 0.7, 0) THEN 'train' WHEN rn <= round_even(n * 0.7, 0) + floor((n - round_even(n * 0.7, 0)) / 2) THEN 'val' ELSE 'test' END AS split FROM r""",
    "fx_predictions": f"""WITH m(model, seed, o) AS (VALUES {_MODELS}), s AS (SELECT model, seed, vec_id + 1 AS sample_id, 'P' || CAST(label % 3 + 1 AS STRING) || '_' || CAST(vec_id % 12 AS STRING) AS patient_id, CAST(label % 3 AS INT) AS true_idx,
 exp(10 * CAST(embedding[o + 1] AS DOUBLE)) e0, exp(10 * CAST(embedding[o + 2] AS DOUBLE)) e1, exp(10 * CAST(embedding[o + 3] AS DOUBLE)) e2 FROM embeddings, m)
SELECT model, seed, sample_id, patient_id, true_idx, e0 / (e0 + e1 + e2) p0, e1 / (e0 + e1 + e2) p1, e2 / (e0 + e1 + e2) p2 FROM s""",
    "fx_pred_large": """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'S' || CAST(l_suppkey AS STRING) patient_id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END true_idx,
 exp(l_quantity / 50) e0, exp(10 * l_discount) e1, exp(12.5 * l_tax) e2 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, patient_id, true_idx, e0 / (e0 + e1 + e2) p0, e1 / (e0 + e1 + e2) p1, e2 / (e0 + e1 + e2) p2 FROM s""",
    "fx_orders": "SELECT o_orderkey + 1 AS sample_id, 'C' || CAST(o_custkey AS STRING) AS patient_id, c_mktsegment AS label, o_totalprice AS size FROM orders JOIN customer ON o_custkey = c_custkey",
    "fx_history": "SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch, value / 100 AS val_macro_f1, CAST(props->>'$.k' AS DOUBLE) / 100 AS val_loss FROM events",
    "fx_candidates": "SELECT p_partkey AS candidate_id, p_brand AS weighting_mode, p_size AS max_depth, (CAST(round(p_retailprice * 100) AS BIGINT) % 97) / 97.0 AS macro_f1, (CAST(round(p_retailprice * 100) AS BIGINT) % 89) / 89.0 AS balanced_accuracy FROM part",
    "fx_files": "SELECT doc_id, 'd/' || source || '/' || CAST(doc_id AS STRING) || '.txt' AS path, sha256(text) AS content_sha256, CASE WHEN substr(md5('42:' || CAST(doc_id AS STRING)), 1, 1) < 'b' THEN 'train' ELSE 'test' END AS split, text FROM documents",
    "fx_timings": "SELECT event_type AS batch, value AS ms FROM events",
    "fx_features_a": _feature_sql(CO_NAMES, 1),
    "fx_features_b": _feature_sql(LBP_NAMES, 17),
}


def with_views(sql: str) -> str:
    """``sql`` with the views that it uses, directly or through others."""
    needed, text = [], sql
    for name in reversed(SQL):
        if re.search(rf"\b{name}\b", text):
            needed.append(name)
            text += SQL[name]
    views = ",\n".join(f"{name} AS ({SQL[name]})" for name in reversed(needed))
    return f"WITH {views}\nSELECT * FROM ({sql})" if views else sql
