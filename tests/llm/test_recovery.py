"""Exact dedup that is repeated, attached anew and fed by computed tables."""

import pytest
from pyspark.sql import functions as F

from grouploom.llm import exact_dedup as X
from grouploom.llm.common import saved


def prints(spark, rows):
    return saved(X.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")))


def kept(df):
    return sorted(r.doc_id for r in df.where("kept").collect())


def test_a_batch_repeated_after_its_append_keeps_its_rows(spark, tmp_path):
    index = X.DigestIndex(spark, str(tmp_path / "f" / "index"), 4)
    assert kept(X.deduplicate(prints(spark, [(1, "a"), (2, "b")]), index, "one")) == [1, 2]
    rows = [(3, "b"), (4, "c"), (5, "c "), (6, "d")]
    # the job dies between the append and its result
    index.append_new(saved(X.best_row(prints(spark, rows))), "two")
    size = index.rows().count()
    again = X.deduplicate(prints(spark, rows[::-1]), index, "two")
    assert kept(again) == [5, 6] and index.rows().count() == size == 4
    assert {r.doc_id: r.keep_id for r in again.collect()} == {3: 2, 4: 5, 5: 5, 6: 6}
    # or in the midst of the append
    index.append_new(saved(X.best_row(prints(spark, [(7, "e")]))), "three")
    assert kept(X.deduplicate(prints(spark, [(7, "e"), (8, "f")]), index, "three")) == [7, 8]
    assert kept(X.deduplicate(prints(spark, [(9, "e"), (10, "f")]), index, "four")) == []


def test_parts_meet_the_index_one_after_the_other(spark, tmp_path):
    rows = [(k, f"text {k % 50}" + " " * (k % 7)) for k in range(400)] + [(None, "text 3" + " " * 9), (None, "alone"), (5, "text 5"), (900, None), (901, " ")]
    index = X.DigestIndex(spark, str(tmp_path / "f" / "index"), 4)
    assert kept(X.deduplicate(prints(spark, [(1000, "text1"), (1001, "other")]), index, "old")) == [1000, 1001]
    table = prints(spark, rows)
    got = X.deduplicate(table, index, "new", parts=3).collect()
    best = {}
    for k, t in rows:
        key = "".join((t or "").split())
        best[key] = max(best.get(key, (-1, 0, None)), (len(t or ""), -(2**63) if k is None else -k, k))
    sizes = {}
    for _, t in rows:
        key = "".join((t or "").split())
        sizes[key] = sizes.get(key, 0) + 1
    want = {k: (1000 if key == "text1" else best[key][2], sizes[key]) for k, t in rows if k is not None for key in ["".join((t or "").split())]}
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got if r.doc_id is not None} == want
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(best) - 1
    assert {r.doc_id for r in got if r.kept} == {v[2] for key, v in best.items() if key != "text1"}
    # some parts found better rows than earlier ones, and a repeated batch appends nothing
    size = index.rows().count()
    assert size > len(best) + 1
    again = X.deduplicate(table, index, "new", parts=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, got)) and index.rows().count() == size
    assert kept(X.deduplicate(prints(spark, [(2000, "text 9" + " " * 99), (2001, "last")]), index, "next")) == [2001]


def test_an_index_keeps_its_number_of_buckets(spark, tmp_path):
    path = str(tmp_path / "f" / "index")
    index = X.DigestIndex(spark, path, 4)
    X.deduplicate(prints(spark, [(k, f"text {k}") for k in range(50)]), index).count()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.sql(f"DROP TABLE {index.name}")  # a fresh catalog; the table's folder stays
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        again = X.DigestIndex(spark, path)
        assert again.buckets == 4 and again.rows().count() == 50
        assert kept(X.deduplicate(prints(spark, [(k, f"text {k}") for k in range(40, 60)]), again)) == list(range(50, 60))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError, match="buckets"):
        X.DigestIndex(spark, path, 8)


def test_a_computed_input(spark):
    """Rows that come out in another order each time they are computed."""
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 20).alias("text"), F.rand().alias("r")).orderBy(F.rand())
    got = X.deduplicated(docs.repartition(5)).collect()
    assert sorted(r.doc_id for r in got) == list(range(20))


def test_very_long_texts_and_clashing_columns(spark):
    long = "word " * 400_000
    df = spark.createDataFrame([(1, long, "x"), (2, long.replace(" ", "\t"), "y"), (3, long + "more", "z")], "doc_id long, text string, digest string").withColumns({"keep_id": F.lit("x"), "row": F.lit(1), "group_size": F.lit(0)})
    out = X.deduplicated(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
