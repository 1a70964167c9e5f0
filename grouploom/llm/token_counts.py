"""Token counts of documents in flat token files, by a separator scan.

A token file is a run of uint16 ids in which every document ends with the separator; nothing says
where. It is read as blocks of ``BLOCK`` ids, cut without regard to documents. Blocks are searched
for separators with one vector comparison each; a two-level prefix scan over the blocks' counts
(within chunks of blocks, then over chunks) gives every block its place, the number of documents
before it and the last separator before it, which stitches documents that cross blocks.

Defined results: a document without ids between two separators has 0 tokens. Ids after a file's
last separator are a last document with ``ended`` false. An empty file has no documents. For
tables of documents, null texts count as empty and special strings are ordinary text; very long
texts are encoded whole and may fill many blocks; repeated rows are counted each; an empty table
gives no rows; extra columns take no part. Vocabularies whose ids exceed 65,535 are refused.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import saved, table, text_parts

BLOCK, CHUNK = 65_536, 1024
FILES = "file long, block long, ids binary, first_no long, docs array<long>"
_encodings: dict = {}


def _encoding(ranks: bytes, pattern: str):
    if pattern not in _encodings:
        import tiktoken

        table_ = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encodings[pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table_, special_tokens={})
    return _encodings[pattern]


def token_files(docs: DataFrame, ranks_path: str, pattern: str, separator: int) -> DataFrame:
    """Documents (doc_id, text) as token files, one per task, written in the shared folder.

    Rows hold either a block (file, block, ids: little-endian uint16) or, beside the file, the
    doc_ids in its order (file, first_no, docs)."""
    spark = ship(docs.sparkSession)
    with open(ranks_path, "rb") as file:
        content = file.read()
    largest = max(separator, *(int(line.split()[1]) for line in content.splitlines() if line))
    if largest > 65_535:
        raise ValueError(f"id {largest} doesn't fit a file of 16-bit ids")
    ranks = spark.sparkContext.broadcast(content)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def rows(file, blocks, first, names):
        n = len(blocks) + 1
        return pa.RecordBatch.from_arrays(
            [pa.array([file] * n, pa.int64()), pa.array([b for b, _ in blocks] + [None], pa.int64()), pa.array([x.tobytes() for _, x in blocks] + [None], pa.binary()),
             pa.array([None] * (n - 1) + [first], pa.int64()), pa.array([None] * (n - 1) + [names], pa.list_(pa.int64()))],
            names=["file", "block", "ids", "first_no", "docs"],
        )

    def run(batches):
        encoding = _encoding(ranks.value, pattern)
        file, block, first, rest = int.from_bytes(os.urandom(8), "little") >> 1, 0, 0, np.zeros(0, np.uint16)
        end = np.array([separator], np.uint16)
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for row, data, offsets in text_parts(batch.column("text"), 1 << 20):
                whole, got = data.tobytes(), [rest]
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    got += [np.array(encoding.encode_ordinary(whole[a:b].decode("utf-8", "replace")), np.uint16), end]
                ids = np.concatenate(got)
                full = len(ids) // BLOCK
                n = len(offsets) - 1
                yield rows(file, [(block + k, ids[k * BLOCK : (k + 1) * BLOCK]) for k in range(full)], first, names[row : row + n])
                block, first, rest = block + full, first + n, ids[full * BLOCK :]
        if len(rest):
            yield rows(file, [(block, rest)], first, [])

    return saved(docs.mapInArrow(run, FILES), "tokens")


def _search(separator: int):
    def run(batches):
        for batch in batches:
            n, places = [], []
            for ids in batch.column("ids"):
                x = np.frombuffer(ids.as_buffer(), np.uint16)
                n.append(len(x))
                places.append(np.flatnonzero(x == separator))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(n, pa.int64()), pa.array(places, pa.list_(pa.int64()))], names=["file", "block", "n", "places"])

    return run


def separator_scan(blocks: DataFrame, separator: int) -> DataFrame:
    """file, doc_no (from 0), start, n_tokens, ended: every document of token files given as
    blocks (file, block, ids)."""
    ship(blocks.sparkSession)
    found = saved(blocks.select("file", "block", "ids").mapInArrow(_search(separator), "file long, block long, n long, places array<long>"), "found")
    found = found.withColumn("chunk", F.floor(F.col("block") / CHUNK))
    last = F.when(F.size("places") > 0, F.element_at("places", -1))
    inside = Window.partitionBy("file", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = found.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumn("no", F.coalesce(F.sum(F.size("places")).over(inside), F.lit(0)))
    local = local.withColumn("before", F.max(F.col("at") + last).over(inside))
    chunks = local.groupBy("file", "chunk").agg(F.sum("n").alias("n"), F.sum(F.size("places")).alias("seps"), F.max(F.col("at") + last).alias("last"))
    over = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("chunk_at", F.coalesce(F.sum("n").over(over), F.lit(0))).withColumn("chunk_no", F.coalesce(F.sum("seps").over(over), F.lit(0)))
    chunks = chunks.withColumn("chunk_before", F.max(F.col("chunk_at") + F.col("last")).over(over)).select("file", "chunk", "chunk_at", "chunk_no", "chunk_before")
    placed = local.join(chunks, ["file", "chunk"]).select(
        "file", F.col("chunk_no") + F.col("no"), F.transform("places", lambda p: p + F.col("chunk_at") + F.col("at")),
        F.coalesce(F.col("chunk_at") + F.col("before"), "chunk_before", F.lit(-1)), F.col("chunk_at") + F.col("at") + F.col("n"),
    ).toDF("file", "no", "ends", "before", "stop")
    starts = F.concat(F.array(F.col("before") + 1), F.transform("ends", lambda p: p + 1))
    docs = placed.select("file", "no", starts.alias("starts"), F.posexplode("ends").alias("k", "end")).select(
        "file", (F.col("no") + F.col("k")).alias("doc_no"), F.element_at("starts", F.col("k") + 1).alias("start"), "end"
    )
    whole = docs.select("file", "doc_no", "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("ended"))
    tail = placed.groupBy("file").agg(F.max("stop").alias("stop"), F.coalesce(F.max(F.when(F.size("ends") > 0, F.element_at("ends", -1))), F.lit(-1)).alias("last"), F.sum(F.size("ends")).cast("long").alias("doc_no"))
    tail = tail.where("stop > last + 1").select("file", "doc_no", (F.col("last") + 1).alias("start"), (F.col("stop") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(tail)


def document_counts(docs: DataFrame, ranks_path: str, pattern: str, separator: int) -> DataFrame:
    """doc_id, n_tokens of every row: token files are written, scanned and named again."""
    files = token_files(docs, ranks_path, pattern, separator)
    counts = separator_scan(files.where("block IS NOT NULL"), separator)
    names = files.where("block IS NULL").select("file", "first_no", F.posexplode("docs").alias("k", "doc_id")).select("file", (F.col("first_no") + F.col("k")).alias("doc_no"), "doc_id")
    return names.join(counts, ["file", "doc_no"]).select("doc_id", "n_tokens")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return document_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)
