"""Every stage of the pipeline against plain Python on its own input, with nulls, empty texts,
repeated rows, extra columns of clashing names and empty tables."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from grouploom.llm import bpe, mixing, quality
from grouploom.llm.common import saved
from grouploom.llm.common import table as load

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CLASH = ("row", "digest", "kept", "component_id", "score", "rate", "p0", "n_chars", "n", "copies")
#: Names of the stages' own helper columns.
CLASH += ("labelled", "gone", "own_number", "kept_row", "own_id", "own_rate", "copy", "__row", "__own", "__gone", "__id", "__rate", "__copy", "__text", "ids", "text_", "node", "x", "y")


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage, over documents with planted rows."""
    import corpus_pipeline as c

    docs = load(spark, SF, "documents")
    some = {r.doc_id: r for r in docs.orderBy("doc_id").limit(40).collect()}
    planted = [(9_000_001, None, "en", "s", 0), (9_000_002, "", None, None, None), (9_000_003, " \n", "en", "s", 2), (None, "text without an id, kept as it is", "en", "s", 3)]
    planted += [tuple(r) for r in list(some.values())[:5]]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema)).withColumns({k: F.lit("clash") for k in CLASH})
    out, frame = {}, saved(docs)
    for name, stage in c.STAGES:
        after = saved(stage(spark, frame, SF))
        out[name] = (frame, after)
        frame = after
    return out


def key(r):
    return (r.doc_id is None, r.doc_id or 0, r.text or "", r.text is None)


def words(text, n=5):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set())


def test_columns_stay(stages):
    for name, (before, after) in stages.items():
        if name != "bpe":
            assert after.columns == before.columns


def test_quality_stage(spark, stages):
    before, after = stages["quality"]
    labels = load(spark, SF, "labels")
    model = quality.fit(quality.features(quality.training_documents(before, labels)), labels)
    rows = before.collect()
    want = []
    for r in rows:
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        if model.score(quality.text_features(data, np.array([0, len(data)])))[0] >= 0.5:
            want.append(key(r))
    assert sorted(want) == sorted(map(key, after.collect()))


def test_exact_stage(stages):
    before, after = stages["exact_dedup"]
    groups = {}
    for r in before.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append(r)
    best = lambda rows: min((-len(r.text or ""), r.doc_id is None, r.doc_id or 0) for r in rows)
    assert sorted(best(g) for g in groups.values()) == sorted(best([r]) for r in after.collect())


def test_near_stage(stages):
    before, after = stages["near_dedup"]
    rows = before.collect()
    named = [(r.doc_id, words(r.text)) for r in rows if r.doc_id is not None]
    root = {k: k for k, _ in named}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, s) in enumerate(named):
        for b, t in named[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = [key(r) for r in rows if r.doc_id is None or find(r.doc_id) == r.doc_id]
    assert sorted(want) == sorted(map(key, after.collect()))


def test_mixing_stage(spark, stages):
    import corpus_pipeline as c

    before, after = stages["mixing"]
    labelled = mixing.labelled_domains(before, load(spark, SF, "labels"), with_quality=False)
    _, rates, _ = mixing.fitted_rates(before, labelled, c.TARGETS, least=1.0)
    rate = {}
    for r in rates.collect():
        rate.setdefault(r.doc_id, []).append(r.rate)
    chance = {r.d: r.c for r in before.select(F.col("doc_id").alias("d"), (F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1_000_000)) / 1_000_000).alias("c")).collect()}
    copies, got = {}, {}
    for r in before.collect():
        own = 1 if r.doc_id is None else max(1, int(np.floor(np.mean(rate[r.doc_id]) + chance[r.doc_id])))
        copies[key(r)] = copies.get(key(r), 0) + own
    for r in after.collect():
        got[key(r)] = got.get(key(r), 0) + 1
    assert got == copies and set(got) == {key(r) for r in before.collect()}


def test_encoding_stage(stages):
    from tokenizers import Tokenizer

    before, after = stages["bpe"]
    lib = Tokenizer.from_file(bpe.default_tokenizer())
    want = sorted((r.doc_id or 0, lib.encode(r.text or "", add_special_tokens=False).ids) for r in before.collect())
    got = after.collect()
    assert sorted((r.doc_id or 0, r.ids) for r in got) == want and all(r.n_tokens == len(r.ids) for r in got)


def test_empty_table(spark):
    import corpus_pipeline as c

    docs = load(spark, SF, "documents").where("false")
    for _, stage in c.STAGES:
        docs = saved(stage(spark, docs, SF))
        assert docs.count() == 0
