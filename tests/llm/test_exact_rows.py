"""Exact dedup of a table whose scan is split anew between two jobs."""

from grouploom.llm import exact_dedup


def test_other_splits_between_jobs(spark, tmp_path):
    rows = [(k, f"text {k % 40} " * 30, k) for k in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, extra long").repartition(6).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        spark.conf.set(names[2], "6")
        kept = exact_dedup.deduplicated(docs)
        # as if executors had been lost: files share splits
        for name, value in zip(names, ("1g", "1", "1"), strict=True):
            spark.conf.set(name, value)
        got = [tuple(r) for r in kept.collect()]
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert kept.columns == docs.columns and sorted(got) == rows[:40]
