"""Mixing, the quality classifier, top k and token counts against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grouploom.llm import mixing, near_dedup, quality, token_counts, topk

WORDS = [["river", "stone", "cloud", "paper"], ["fluss", "stein", "wolke", "papier"], ["riviere", "pierre", "nuage", "papier"]]


def test_posteriors_and_rates_are_the_least_squares_ones(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(90):
        words = [rng.choice(WORDS[k % 3] if rng.random() < 0.7 else WORDS[rng.randrange(3)]) for _ in range(rng.randrange(1, 140))]
        rows.append((k, " ".join(words)))
        labels.append((k, "abc"[k % 3]))
    rows += [(200, None), (201, " \n"), (202, "river " * 5000), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("row", "p0", "w", "bucket", "rate")})
    labelled = spark.createDataFrame(labels, "labelled_id long, domain string")
    domains, rates, missed = mixing.fitted_rates(df, labelled, {"a": 0.2, "b": 0.3, "c": 0.5})
    got = rates.collect()
    # the same by hand; only the numbers of words' buckets come from Spark
    every = sorted({w for _, t in rows for w in (t or "").lower().split()})
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", mixing._bucket(F.col("w")).alias("b")).collect()}
    counts, sizes = np.full((3, mixing.BUCKETS), 0.5), np.zeros(3)
    for k, domain in labels:
        sizes["abc".index(domain)] += 1
        for text in [t for i, t in rows if i == k]:
            for w in text.split():
                counts["abc".index(domain), bucket[w]] += 1
    weights = np.log(counts / counts.sum(axis=1, keepdims=True))
    texts = {}
    for i, t in rows:
        words = (t or "").split()
        z = np.log(sizes / sizes.sum()) + sum((weights[:, bucket[w]] for w in words), np.zeros(3)) * mixing.EVIDENCE / max(len(words), mixing.EVIDENCE)
        p = np.exp(z - z.max())
        texts[i] = (len(words), p / p.sum())
    assert domains == ["a", "b", "c"] and len(got) == len(rows)
    for r in got:
        assert r.n_tokens == texts[r.doc_id][0] and (r.p0, r.p1, r.p2) == pytest.approx(tuple(texts[r.doc_id][1]), abs=1e-9)
    tokens, p = np.array([r.n_tokens for r in got]), np.array([[r.p0, r.p1, r.p2] for r in got])
    have = (tokens[:, None] * p * np.array([r.rate for r in got])[:, None]).sum(axis=0)
    assert have / tokens.sum() == pytest.approx([0.2, 0.3, 0.5], abs=1e-3) and missed < 1e-3 and min(r.rate for r in got) >= 0


def test_targets_that_no_rates_meet_are_reported(spark):
    df = spark.createDataFrame([(k, "river stone") for k in range(20)], "doc_id long, text string")
    labelled = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(20)], "labelled_id long, domain string")
    with pytest.warns(UserWarning, match="misses a target"):
        _, rates, missed = mixing.fitted_rates(df, labelled, {"a": 0.9, "b": 0.1})
    assert missed > 0.3 and rates.count() == 20


def test_more_domains_than_a_page(spark):
    rows = [(k, f"word{k % 25} " * 10) for k in range(200)]
    labelled = spark.createDataFrame([(k, f"d{k % 25:02d}") for k in range(200)], "labelled_id long, domain string")
    domains, rates, missed = mixing.fitted_rates(spark.createDataFrame(rows, "doc_id long, text string"), labelled, {f"d{k:02d}": 1 + k % 3 for k in range(25)})
    assert len(domains) == 25 and missed < 1e-2 and rates.count() == 200


def test_features_and_scores_by_hand(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcXYZ .,!?\n\t0189é#-") for _ in range(rng.randrange(1, 300))) for _ in range(60)] + ["", None, "one", "A B\nA B\nC", "word " * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("x", F.lit("clash")).withColumn("score", F.lit("clash"))
    found = {r.doc_id: dict(zip(quality.NAMES, r.x)) for r in quality.features(df).collect()}
    for k, t in enumerate(texts):
        b, words = (t or "").encode(), [w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", (t or "").encode()) if w]
        lines = [x for x in b.split(b"\n")]
        lines = lines[:-1] if lines and not lines[-1] else lines
        want = {
            "share_upper": sum(65 <= c <= 90 for c in b) / max(len(b), 1), "share_digit": sum(48 <= c <= 57 for c in b) / max(len(b), 1), "log_bytes": math.log1p(len(b)), "log_words": math.log1p(len(words)),
            "mean_word": sum(map(len, words)) / max(len(words), 1), "distinct_words": len(set(words)) / max(len(words), 1), "repeat_next": sum(a == c for a, c in zip(words, words[1:])) / max(len(words), 1),
            "short_words": sum(len(w) <= 3 for w in words) / max(len(words), 1), "entropy": -sum(n / len(b) * math.log2(n / len(b)) for n in map(b.count, set(b))) if b else 0.0,
            "mean_line": math.log1p(len(b) / max(len(lines), 1)),
        }
        for name, value in want.items():
            assert found[k][name] == pytest.approx(value, abs=1e-9), (k, name)
    labels = spark.createDataFrame([(k, int(found[k]["share_upper"] > 0.15)) for k in range(60)], "doc_id long, quality int")
    model = quality.fit(quality.features(df), labels)
    for r in quality.scored(quality.features(df), model).collect():
        x = [found[r.doc_id][n] for n in quality.NAMES]
        bins = [sum(v >= e for e in edges) for v, edges in zip(x, model.edges)]
        z = model.intercept + sum(t[b] for t, b in zip(model.tables, bins)) + sum(t[bins[i], bins[j]] for (i, j), t in zip(model.pairs, model.pair_tables))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
    assert model.pairs and any(t.any() for t in model.pair_tables)


def test_top_k_of_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(k, [k % 5, k % 3]) for k in range(40)], "id long, v array<long>").withColumns({c: F.lit("clash") for c in ("rank", "score", "rb", "qb")})
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df.where("id = 20"), df, 3).collect()}
    want = sorted((-((k % 5) * 0 + (k % 3) * 2), k) for k in range(40) if k != 20)[:3]
    assert got == {(20, i + 1): (k, -s) for i, (s, k) in enumerate(want)}
    assert topk.top_k(df, df.where("false"), 3).count() == 0


def test_token_counts_of_long_repeated_and_clashing_rows(spark):
    import public_tokenizers

    args = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)
    rows = [(1, "a river " * 60_000), (2, "twice"), (2, "twice"), (3, None), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("file", "block", "ids", "n")})
    with open(args[0], "rb") as f:
        encoding = token_counts._encoding(f.read(), args[1])
    got = sorted(((r.doc_id or 0), r.n_tokens) for r in token_counts.document_counts(df, *args).collect())
    assert got == sorted(((k or 0), len(encoding.encode_ordinary(t or ""))) for k, t in rows)
    with pytest.raises(ValueError, match="16-bit"):
        token_counts.document_counts(df, args[0], args[1], 70_000)


def test_a_hot_centre_keeps_all_links(spark):
    """Thousands of edited copies of one text, each linked with it alone."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    rows = [(0, " ".join(base))]
    for k in range(1, 1500):
        words = list(base)
        at = rng.randrange(60)
        words[at] = f"edit{k}"
        rows.append((k, " ".join(words)))
    rows += [(9000 + k, " ".join(f"x{k}y{j}" for j in range(60))) for k in range(50)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85)
    assert {r.doc_id: r.component_id for r in got.collect()} == {k: 0 if k < 9000 else k for k, _ in rows}


def test_recall_just_above_the_bound(spark):
    """Isolated pairs of similarity 0.85 to 0.90: nearly all are found."""
    rows, n = [], 600
    for k in range(n):
        common = [f"p{k}w{j}" for j in range(100)]
        rows += [(2 * k, " ".join(common)), (2 * k + 1, " ".join([*common[:-3], f"p{k}e0", f"p{k}e1", f"p{k}e2"]))]
    a, b = (near_dedup.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), 3)[0] for _, t in rows[:2])
    similarity = len(set(a) & set(b)) / len(set(a) | set(b))
    assert 0.85 <= similarity <= 0.95
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85)
    assert got.where("component_id <> doc_id").count() >= 0.995 * n
