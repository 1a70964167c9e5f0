"""Hash trees, sinks that can be repeated, growing folders."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from grouploom.operators import integrity as I
from grouploom.sources import tables as IO

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def table(spark, names):
    return spark.createDataFrame(sorted(names.items()), "path string, sha256 string").repartition(3)


def root_by_hand(names, depth):
    sha = lambda parts: hashlib.sha256("\n".join(sorted(parts)).encode()).hexdigest()
    level = {}
    for path, digest in names.items():
        level.setdefault(hashlib.md5(path.encode()).hexdigest()[:depth], []).append(f"{path}:{digest}")
    level = {k: sha(v) for k, v in level.items()}
    for d in range(depth - 1, -1, -1):
        up = {}
        for k, h in level.items():
            up.setdefault(k[:d], []).append(f"{k}:{h}")
        level = {k: sha(v) for k, v in up.items()}
    return level[""]


def test_hash_tree_and_its_difference(spark):
    old = {f"d/{k}.txt": hashlib.sha256(str(k).encode()).hexdigest() for k in range(300)}
    new = dict(old) | {"d/7.txt": "x", "d/new.txt": "y"}
    del new["d/100.txt"]
    for depth in (1, 2):
        r = I.directory_digest(table(spark, old), depth).first()
        assert (r.digest, r.n_files) == (root_by_hand(old, depth), 300)
    a, b = (I.merkle(table(spark, t), [], "path", "sha256", 2) for t in (old, new))
    paths = {p for p in ("d/7.txt", "d/new.txt", "d/100.txt")}
    assert {r.node for r in I.merkle_difference(a, b, [], 2).collect()} == {hashlib.md5(p.encode()).hexdigest()[:2] for p in paths}
    assert a.join(b, ["level", "node", "digest"]).where("level = 2").count() >= a.where("level = 2").count() - 3
    assert {tuple(r) for r in I.changed_names(table(spark, old), table(spark, new), "path", "sha256", 2).collect()} == {("d/7.txt", "changed"), ("d/new.txt", "added"), ("d/100.txt", "removed")}
    assert I.changed_names(table(spark, old), table(spark, old), "path", "sha256").count() == 0


def test_ordered_digest_of_several_levels(spark):
    keys = list(range(0, 350, 3))
    want = [hashlib.sha256(",".join(str(k) for k in keys if k // 5 == p).encode()).hexdigest() for p in sorted({k // 5 for k in keys})]
    parts, at = sorted({k // 5 for k in keys}), len({k // 5 for k in keys})
    while True:
        groups = {}
        for p, h in zip(parts, want, strict=True):
            groups.setdefault(p // 5, []).append(h)
        parts = sorted(groups)
        want = [hashlib.sha256(",".join(groups[p]).encode()).hexdigest() for p in parts]
        if parts == [0]:
            break
    r = I.ordered_digest(spark.createDataFrame([(k,) for k in keys], "k long").repartition(4), "k", 5).first()
    assert (r.digest, r.parts) == (want[0], at)


def test_a_run_is_there_once_and_only_when_it_ended(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.range(10).select("id", (F.col("id") / 3).alias("value"))
    for run in ("r1", "r2", "r1"):
        IO.write_results({"t": rows, "u": rows.limit(3)}, path, run)
    assert {(r.run_id, r["count"]) for r in IO.read_results(spark, path, "t").groupBy("run_id").count().collect()} == {("r1", 10), ("r2", 10)}
    # a third run dies between its tables and the manifest
    IO._replace(rows.withColumn("run_id", F.lit("r3")), f"{path}/t")
    assert IO.read_results(spark, path, "t").count() == 20 and spark.read.parquet(f"{path}/t").count() == 30
    with pytest.raises(ValueError):
        IO.write_results({"manifest": rows}, path, "r1")


def test_files_are_dealt_with_once_over_restarts(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    plain = lambda files: files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.length("content").cast("bigint").alias("n"))

    def dies(files):
        plain(files).count()
        raise RuntimeError("killed midway")

    for k in range(3):
        for j in range(4):
            (source / f"{k}-{j}.bin").write_bytes(os.urandom(k + j + 1))
        if k == 1:
            with pytest.raises(Exception, match="killed midway"):
                IO.convert_new(spark, str(source), target, dies)
        IO.convert_new(spark, str(source), target, plain)
        got = sorted(tuple(r) for r in IO.converted(spark, target, "name string, n long").collect())
        assert got == sorted((f"{a}-{b}.bin", a + b + 1) for a in range(k + 1) for b in range(4))


def test_the_first_run_is_chosen_in_the_scan(spark):
    from grouploom.plans.fixtures import Views
    from grouploom.plans.storage import first_run

    history = Views(spark, SF).history
    found = first_run(history)
    assert "EqualTo(user_id" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == history.join(history.agg({"run_id": "min"}).toDF("run_id"), "run_id").count() > 0
