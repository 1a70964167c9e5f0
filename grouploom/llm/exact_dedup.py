"""Exact dedup over a persistent digest index.

The index is a Parquet table with one row per distinct text, bucketed and sorted by digest. A
batch is deduplicated by a sort-merge anti-join against it: the index side is read bucket by
bucket without a shuffle, only the batch's digests move. What is new is appended, so the next
batch sees it. Only DataFrame functions are used.

A batch can come in parts, which meet the index one after the other: a part appends what the index
lacks, and what is better than the row that an earlier part of its batch brought. Rows of earlier
batches stay whatever comes. An index's row of a digest is the best that its batch brought.

A batch has a name that its caller gives. The index tells which batch brought a digest, so a job
that died after its append, or in the midst of it, is repeated under the same name: digests of
that name count as the batch's own. The number of buckets is stored beside the index.

Defined results: a null text counts as empty, and empty texts equal one another. Among rows with
equal text the one with the most code points stays, then the smallest doc_id (a null doc_id comes
last), then, of repeated rows, one. Very long texts are hashed whole; only digests are shuffled.
Extra columns take no part. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, fresh, saved, shared_folder, table

#: A digest with more than this share of a batch's rows is hot; there are at most 1000 such
#: digests, so their index rows can be broadcast.
HOT_SHARE = 1000

#: Parts in which ``op10`` brings its table to the index.
PARTS = 2

INDEX_COLUMNS = "digest BINARY, keep_id BIGINT, n_chars BIGINT, batch STRING"


def rank(keep_id: Column, n_chars: Column) -> Column:
    """More code points are better, then smaller ids; a null id is the worst."""
    return F.struct(n_chars.alias("n"), F.coalesce(-keep_id, F.lit(-(2**63))).alias("a"))


def fingerprints(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id, row number, code points of the text and SHA-256 of the text without white space."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
        F.char_length(text).cast("bigint").alias("n_chars"),
        F.unhex(F.sha2(F.regexp_replace(text, WHITE, "").cast("binary"), 256)).alias("digest"),
    )


class DigestIndex:
    """A digest index at ``path``; it is created when absent and attached again when present, with
    the number of buckets that it was created with. Another number is refused."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        stored = self._stored(spark, path)
        if stored and buckets and stored != buckets:
            raise ValueError(f"the index at {path} has {stored} buckets, not {buckets}")
        self.spark, self.buckets = spark, stored or buckets or buckets_of(spark)
        if not stored:
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.parquet(path + "_buckets")
        self.name = "digest_index_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({INDEX_COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    @staticmethod
    def _stored(spark: SparkSession, path: str) -> int | None:
        try:
            return spark.read.parquet(path + "_buckets").first()["buckets"]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def held(self) -> DataFrame:
        """One row per digest: first_id, first_chars and the batch that brought it."""
        best = F.max(F.struct(rank(F.col("keep_id"), F.col("n_chars")).alias("r"), "keep_id", "n_chars", "batch"))
        return self.rows().groupBy("digest").agg(best.alias("best")).select(
            "digest", F.col("best.keep_id").alias("first_id"), F.col("best.n_chars").alias("first_chars"), "best.batch"
        )

    def append_new(self, summary: DataFrame, batch: str) -> None:
        """Adds the digests of ``summary`` that the index lacks, or has from this batch with a worse
        row (sort-merge anti-join)."""
        there = self.rows().select("digest", F.col("keep_id").alias("first_id"), F.col("n_chars").alias("first_chars"), F.col("batch").alias("by"))
        stays = (F.col("by") != batch) | (rank(F.col("first_id"), F.col("first_chars")) >= rank(F.col("keep_id"), F.col("n_chars")))
        mine = summary.withColumnRenamed("digest", "own")
        new = mine.join(there.hint("merge"), (F.col("own") == F.col("digest")) & stays, "left_anti").withColumnRenamed("own", "digest")
        # one task per bucket, so that each append adds one sorted file to a bucket
        (
            new.repartition(self.buckets, "digest")
            .select("digest", "keep_id", "n_chars", F.lit(batch).alias("batch"))
            .write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )


def best_row(prints: DataFrame) -> DataFrame:
    """One row per digest; copies collapse map-side, so a hot digest sends one row per task."""
    best = F.max(F.struct(rank(F.col("doc_id"), F.col("n_chars")).alias("r"), (-F.col("row")).alias("b"), "doc_id", "row", "n_chars"))
    return prints.groupBy("digest").agg(best.alias("best"), F.count("*").alias("n_rows")).select(
        "digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "best.n_chars", "n_rows"
    )


def deduplicate(prints: DataFrame, index: DigestIndex, batch: str | None = None, parts: int = 1) -> DataFrame:
    """Appends a batch's new digests to the index and decides every row of the batch.

    ``prints`` is a saved table: its rows keep their numbers. ``batch`` names the batch; give it
    where the job may be repeated. It is brought to the index in ``parts``. Returns doc_id, row, digest, keep_id, group_size (rows of this
    batch with that text) and kept. In a batch whose text was indexed by an earlier one, no row is
    kept."""
    batch = batch or uuid.uuid4().hex
    told = []
    for k in range(parts):
        part = prints if parts == 1 else prints.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == k)
        told.append(saved(best_row(part), f"summary{k}"))
        index.append_new(told[-1], batch)
    # the row that stays is the one the index holds, where this batch brought it
    own = (F.col("batch") == batch) & F.col("keep_id").eqNullSafe(F.col("first_id")) & (F.col("n_chars") == F.col("first_chars"))
    group = (
        reduce(DataFrame.unionByName, told).join(index.held().hint("merge"), "digest").groupBy("digest")
        .agg(F.sum("n_rows").alias("group_size"), F.any_value("first_id").alias("keep_id"), F.coalesce(F.min(F.when(own, F.col("keep_row"))), F.lit(-1)).alias("keep_row"))
    )
    least = prints.count() // HOT_SHARE + 1
    hot = group.where(F.col("group_size") > least)
    rows = prints.select("doc_id", "row", "digest")
    marked = rows.join(F.broadcast(hot), "digest", "left")
    cold = marked.where(F.col("group_size").isNull()).select("doc_id", "row", "digest").join(group, "digest")
    columns = ["doc_id", "row", "digest", "keep_id", "keep_row", "group_size"]
    both = marked.where(F.col("group_size").isNotNull()).select(columns).unionByName(cold.select(columns))
    return both.withColumn("kept", F.col("row") == F.col("keep_row"))


def buckets_of(spark: SparkSession) -> int:
    return min(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), 100_000)


def new_index(spark: SparkSession) -> DigestIndex:
    return DigestIndex(spark, f"{shared_folder(spark)}/index")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay; one of equal rows.

    Rows are numbered once, in a saved copy that both the digests and the result are read from."""
    own = fresh(docs, "own_number")
    numbered = saved(docs.withColumn(own, F.monotonically_increasing_id()), "numbered")
    kept_row = fresh(numbered, "kept_row")
    prints = fingerprints(numbered, F.col(own))
    kept = deduplicate(saved(prints, "prints"), new_index(docs.sparkSession)).where("kept").select(F.col("row").alias(kept_row))
    return numbered.join(kept, F.col(own) == F.col(kept_row), "left_semi").drop(own)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = saved(fingerprints(table(spark, sf_dir, "documents")), "prints")
    return deduplicate(prints, new_index(spark), parts=PARTS).select(
        "doc_id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP10_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size
      FROM t WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM r
"""
