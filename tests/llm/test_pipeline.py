"""The corpus pipeline stage by stage over the smallest tables."""

import os

from grouploom.llm import bpe
from grouploom.llm.common import saved
from grouploom.llm.common import table as load

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_pipeline(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline as c

    assert [name for name, _ in c.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "bpe"]
    docs = load(spark, SF, "documents")
    columns, texts, sizes = docs.columns, {r.doc_id: r.text for r in docs.collect()}, {}
    for name, stage in c.STAGES:
        docs = saved(stage(spark, docs, SF))
        sizes[name] = docs.select("doc_id").distinct().count()
        if name != "bpe":
            assert docs.columns == columns
    labels = {r.doc_id: r.quality for r in load(spark, SF, "labels").collect()}
    assert sizes["quality"] >= 0.9 * sum(labels.values()) / len(labels) * len(texts)
    assert sizes["quality"] >= sizes["exact_dedup"] >= sizes["near_dedup"] == sizes["mixing"] == sizes["bpe"]
    lib = Tokenizer.from_file(bpe.default_tokenizer())
    for r in docs.limit(20).collect():
        assert r.ids == lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_encoding_stage_decodes(spark):
    import hashlib

    from tokenizers import Tokenizer

    import corpus_pipeline as c

    lib = Tokenizer.from_file(bpe.default_tokenizer())
    texts = ["Zwei  Worte,\n und 3 mehr", "", None]
    docs = spark.createDataFrame([(k, t, "de", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for r in c.encoding_stage(spark, docs, SF).collect():
        want = lib.decode(lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.n_tokens == len(r.ids)
