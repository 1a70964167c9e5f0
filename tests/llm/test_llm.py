"""Corpus operators against brute force on small fixtures, with nulls, empty and long texts, ties,
repeated rows, empty tables and clashing extra columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grouploom.llm import bpe, chat, context_tree, exact_dedup, mixing, near_dedup, quality, repeats, token_counts, topk

SCHEMA = "doc_id long, text string, lang string, kept string, row string, digest string, n_shingles string, x string, score string, ids string, batch string, p0 string, node string"
WORDS = "the and of to in river stone cloud paper green window seven table light over under maybe never always after".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", ","]) for _ in range(n))


def corpus():
    rng = random.Random(5)
    texts = {k: prose(rng, rng.randrange(3, 90)) for k in range(40)}
    texts[40], texts[41], texts[42], texts[43] = None, "", "  \n\t ", "one"
    texts[44], texts[45] = texts[3], texts[3].replace(" ", "  ") + "\n"
    near = texts[7].split() if len(texts[7].split()) > 40 else prose(rng, 80).split()
    texts[7] = " ".join(near)
    texts[46] = " ".join([*near[:20], "changed", *near[21:]])
    texts[47] = prose(rng, 30) + " " + texts[9] + " " + prose(rng, 10)
    texts[48] = "Ünïcödé ß " * 20 + prose(rng, 12)
    texts[49] = prose(rng, 6000)
    return texts


def table(spark, rows):
    full = [(k, t, "en" if (k or 0) % 2 else "fr", *["clash"] * 10) for k, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, list(corpus().items())).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# exact dedup
def strip(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_dedup(spark, docs, none):
    got = {r.doc_id: r for r in exact_dedup.deduplicate(exact_dedup.saved(exact_dedup.fingerprints(docs)), exact_dedup.new_index(spark)).collect()}
    texts = corpus()
    for k, t in texts.items():
        same = [j for j, u in texts.items() if strip(u) == strip(t)]
        keep = min(same, key=lambda j: (-len(texts[j] or ""), j))
        assert (got[k].keep_id, got[k].group_size, got[k].kept) == (keep, len(same), keep == k)
        assert bytes(got[k].digest).hex() == hashlib.sha256(strip(t).encode()).hexdigest()
    assert exact_dedup.deduplicated(none).count() == 0


def test_exact_dedup_repeated_rows_and_second_batch(spark, tmp_path):
    rows = [(1, "a b"), (1, "a b"), (2, "ab"), (None, "zz"), (None, None)]
    kept = exact_dedup.deduplicated(table(spark, rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None", "None"] and kept.columns == table(spark, rows).columns
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "folder" / "index"), 4)
    first = exact_dedup.saved(exact_dedup.fingerprints(table(spark, [(5, "x y"), (6, "q")])))
    assert exact_dedup.deduplicate(first, index).where("kept").count() == 2
    again = exact_dedup.DigestIndex(spark, str(tmp_path / "folder" / "index"), 4)
    second = exact_dedup.saved(exact_dedup.fingerprints(table(spark, [(7, "xy"), (8, "new")])))
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.deduplicate(second, again).collect()}
    assert got == {7: (5, False), 8: (8, True)} and again.rows().count() == 3


# near dedup
def shingles(t, n):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set())


def brute_components(texts, n, percent):
    sets = [(k, shingles(t, n)) for k, t in texts]
    root = {k: k for k, _ in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k, _ in sets}, sets


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_dedup(docs, n, percent):
    want, sets = brute_components(list(corpus().items()), n, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, n, percent).collect()}
    assert got == {k: (len(s), want[k], want[k] == k) for k, s in sets}


def test_near_dedup_of_edited_copies(spark, none):
    """A chain-like group of edits: links only between near neighbours, one component."""
    rng = random.Random(9)
    base = prose(rng, 120).split()
    texts = []
    for k in range(60):
        w = list(base)
        for j in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = rng.choice(WORDS) + str(j)
        texts.append((100 + k, " ".join(w)))
    texts += [(100, texts[0][1]), (None, texts[1][1])]
    want, _ = brute_components([t for t in texts if t[0] is not None], 3, 85)
    got = near_dedup.near_duplicates(table(spark, texts), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert [r.kept for r in got if r.doc_id is None] == [True]
    left = near_dedup.without_near_duplicates(table(spark, texts), 3, 85)
    assert left.columns == none.columns and near_dedup.near_duplicates(none).count() == 0


# top k
def test_top_k(spark):
    rng = np.random.default_rng(3)
    v = {k: rng.normal(0, 0.2, 16).tolist() for k in range(160)}
    for k in range(20, 45):
        v[k] = v[0]
    rows = [(k, x) for k, x in v.items()] + [(500, None), (501, [1.0, None]), (502, [float("nan")] * 16), (520, [0.5] * 3)]
    q = {k: [math.floor(64 * a) for a in x] for k, x in rows if x and all(a is not None and math.isfinite(a) for a in x)}
    df = spark.createDataFrame([(k, [math.floor(64 * a) for a in x]) for k, x in rows if k in q], "id long, v array<long>")
    found = topk.top_k(df.where("id % 20 = 0"), df, 20).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for k, x in q.items():
        if k % 20 == 0:
            dots = sorted(((-sum(a * b for a, b in zip(x, y)), j) for j, y in q.items() if j != k))[:20]
            assert sorted(got[k]) == [(i + 1, j, -s) for i, (s, j) in enumerate(dots)]
    assert topk.top_k(df.where("false"), df, 20).count() == 0


# BPE
def test_bpe_of_every_code_point_equals_the_library():
    """Code points whose words this library splits by itself, all of them; of the others, which the library
    splits, every seventeenth."""
    with open(bpe.default_tokenizer(), encoding="utf-8") as f:
        spec = f.read()
    lib, encoder = Tokenizer.from_str(spec), bpe.Encoder(bpe.Vocabulary(spec))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    own = [c for c in points if not bpe.STRANGE.search(c)]
    for group in (own, [c for c in points if bpe.STRANGE.search(c)][::17]):
        texts = [" ".join(f"a{c}b {c}" for c in group[a : a + 300]) for a in range(0, len(group), 300)]
        want = lib.encode_batch(texts, add_special_tokens=False)
        assert [np.frombuffer(x, np.int32).tolist() for x in encoder.encode(texts)[0]] == [w.ids for w in want]


def test_bpe_equals_the_library(docs, none):

    lib = Tokenizer.from_file(bpe.default_tokenizer())
    got = {r.doc_id: (r.ids, r.decoded) for r in bpe.encode(docs, bpe.default_tokenizer()).collect()}
    extra = ["<|endoftext|> A<|startoftext|>", "don't I'LL 's", "ΑΣ Σς", "x" * 6000, "日本 ½ 1234", "a b\x85c", "!?" * 300]
    for k, t in [*corpus().items()]:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[k] == (ids, lib.decode(ids, skip_special_tokens=False))
    with open(bpe.default_tokenizer(), encoding="utf-8") as f:
        encoder = bpe.Encoder(bpe.Vocabulary(f.read()))
    packed, _ = encoder.encode(extra)
    assert [np.frombuffer(p, np.int32).tolist() for p in packed] == [lib.encode(t, add_special_tokens=False).ids for t in extra]
    assert bpe.encode(none, bpe.default_tokenizer()).count() == 0


# repeats
@pytest.mark.parametrize("batch_bytes,unit,bits", [(1 << 22, 1 << 23, None), (2000, 1 << 23, None), (1 << 22, 700, None), (2000, 1 << 23, 4), (1 << 22, 1 << 23, 1)])
def test_repeats(spark, monkeypatch, batch_bytes, unit, bits):
    """Any cut into batches and units gives the same result; so do clashing digit hashes, with
    which suffixes stay that could leave."""
    if bits:
        monkeypatch.setattr(repeats, "hash_bits", lambda n: bits)
    texts = dict(corpus())
    texts[60] = texts[49][:300]
    # one common line, its anchor, in many surroundings, some of which repeat; a periodic text
    line = "all rights reserved by the owners of this long common line of text"
    texts |= {70 + k: f"{k % 5} before {line} after {k % 7}" for k in range(25)}
    texts |= {100: "ab" * 200, 101: "ab" * 30 + "c" + "ab" * 30, 102: "x" * 49, 103: "y" * 50, 104: "y" * 50}
    rows = [*texts.items(), (9, texts[9]), (None, texts[49][100:400])]
    got = repeats.without_repeats(table(spark, rows).repartition(3), batch_bytes=batch_bytes, unit=unit).collect()
    first = {}
    for k, t in texts.items():
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], k), k)
    for r in got:
        b = ((texts[r.doc_id] if r.doc_id is not None else rows[-1][1]) or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if r.doc_id is None or first[b[i : i + 50]] < r.doc_id:
                gone[i : i + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), int(gone.sum()), spans)
        assert bytes(r.kept) == bytes(np.frombuffer(b, np.uint8)[~gone])
    assert len(got) == len(rows)


def test_repeats_of_nothing(none):
    assert repeats.without_repeats(none).count() == 0


# context trees
def brute_tree(texts, depth):
    """Counts per (context, choice) of the training texts, and the weights by direct recursion."""
    counts = {}
    for k, t in texts:
        if k is None or zlib.crc32(str(k).encode()) % 10 == 0:
            continue
        b = bytes(depth) + (t or "").encode() + b"\0"
        b = bytes(x + 32 if 65 <= x <= 90 else x for x in b)
        for i in range(depth, len(b)):
            for step in range(8):
                node, bit = (1 << step) | (b[i] >> (8 - step)), (b[i] >> (7 - step)) & 1
                for d in range(depth + 1):
                    c = counts.setdefault((b[i - d : i][::-1], node), [0, 0])
                    c[bit] += 1
    children = {}
    for context, node in counts:
        if context:
            children.setdefault((context[:-1], node), []).append((context, node))
    own = lambda c: math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(c) + 1)
    share, weighted = {}, {}
    for key in sorted(counts, key=lambda x: -len(x[0])):
        mine = own(counts[key])
        if len(key[0]) == depth:
            weighted[key], share[key] = mine, 1.0
        else:
            below = sum(weighted[c] for c in children.get(key, []))
            weighted[key] = np.logaddexp(mine, below) - math.log(2)
            share[key] = math.exp(mine - math.log(2) - weighted[key])

    def score(t):
        b = bytes(depth) + (t or "").encode() + b"\0"
        b = bytes(x + 32 if 65 <= x <= 90 else x for x in b)
        total = 0.0
        for i in range(depth, len(b)):
            for step in range(8):
                node, bit = (1 << step) | (b[i] >> (8 - step)), (b[i] >> (7 - step)) & 1
                one = 0.5
                for d in range(depth, -1, -1):
                    key = (b[i - d : i][::-1], node)
                    c = counts.get(key, [0, 0])
                    w = share.get(key, 1.0 if d == depth else 0.5)
                    one = w * (c[1] + 0.5) / (sum(c) + 1) + (1 - w) * one
                total += math.log10(one if bit else 1 - one)
        return total

    return score


@pytest.mark.parametrize("batch_bytes", [1 << 22, 3000])
def test_code_lengths(spark, batch_bytes):
    rows = [(k, t if k != 49 else t[:2000]) for k, t in corpus().items()] + [(1, "again"), (None, "no id")]
    score = brute_tree(rows, context_tree.DEPTH)
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")), None]
    train = {}
    for k, t in rows:
        if k is not None and zlib.crc32(str(k).encode()) % 10:
            for w in tokens(t):
                train[w] = train.get(w, 0) + 1
    n, v = sum(train.values()), len(train)
    got = context_tree.code_lengths(table(spark, rows).repartition(3), batch_bytes).collect()
    assert len(got) == len(rows)
    texts = {}
    for k, t in rows:
        texts.setdefault(k, []).append(t)
    for r in got:
        possible = [(score(t), len(tokens(t)), sum(w in train for w in tokens(t)), sum(math.log10((train.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for t in texts[r.doc_id]]
        assert any(r.score == pytest.approx(s, rel=1e-8, abs=1e-8) and (r.n_tokens, r.n_known) == (a, b) and r.base_score == pytest.approx(c, rel=1e-9) for s, a, b, c in possible)
        assert r.train_tokens == n


def test_code_lengths_of_nothing(none):
    assert context_tree.code_lengths(none).count() == 0


# quality
def test_quality(spark, none):
    rng = random.Random(2)
    good = [(k, prose(rng, 60)) for k in range(150)]
    bad = [(1000 + k, " | ".join(rng.choice(WORDS).upper() + "!!" for _ in range(40))) for k in range(60)]
    rows = [*good, *bad, (5000, None), (5001, ""), (5002, "word " * 20000)]
    df = table(spark, rows)
    labels = spark.createDataFrame([(k, 1) for k, _ in good] + [(k, 0) for k, _ in bad] + [(7, None), (3, 1)], "doc_id long, quality int")
    found = quality.features(df)
    model = quality.fit(found, labels)
    score = {r.doc_id: r.score for r in quality.scored(found, model).collect()}
    held = [k for k, _ in good + bad if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(score[k] >= 0.5) == (k < 1000) for k in held]) > 0.95
    assert all(0 <= s <= 1 for s in score.values()) and len(score) == len(rows)
    kept = quality.accepted(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {k for k, s in score.items() if s >= 0.5}
    plain = quality.fit(quality.features(none), labels.limit(0))
    assert quality.scored(quality.features(df), plain).agg(F.min("score"), F.max("score")).first()[:] == (0.5, 0.5)
    assert quality.accepted(none, model).count() == 0


# token counts
def test_token_counts(spark, docs, none):
    import public_tokenizers

    args = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)
    got = {r.doc_id: r.n_tokens for r in token_counts.document_counts(docs, *args).collect()}
    with open(args[0], "rb") as f:
        encoding = token_counts._encoding(f.read(), args[1])
    assert got == {k: len(encoding.encode_ordinary(t or "")) for k, t in corpus().items()}
    assert token_counts.document_counts(none, *args).count() == 0


def test_separator_scan_across_blocks(spark):
    rng = random.Random(4)
    rows, want = [], set()
    for file in range(3):
        ids, sizes = [], [rng.choice([0, 1, 5, 40]) for _ in range(4000)]
        for n in sizes:
            ids += [rng.randrange(9) for _ in range(n)] + [9]
        rest = [1] * (7 * file)
        cut = np.array(ids + rest, np.uint16)
        rows += [(file, b, cut[a : a + 11].tobytes()) for b, a in enumerate(range(0, len(cut), 11))]
        at = 0
        for no, n in enumerate(sizes):
            want.add((file, no, at, n, True))
            at += n + 1
        if rest:
            want.add((file, len(sizes), at, len(rest), False))
    blocks = spark.createDataFrame(rows, "file long, block long, ids binary")
    assert {tuple(r) for r in token_counts.separator_scan(blocks, 9).collect()} == want


# chat
def test_quotes_are_linked_and_removed(spark):
    rows = [
        (1, 0, "user", "Hello there\nfriend.\n\nWhat is the plan?"), (1, 1, "assistant", "We meet at noon."), (1, 2, "user", "On Monday x wrote:\n> hello   there friend.\n\nFine, thanks."),
        (1, 3, "assistant", "> Fine, thanks.\n> > Hello there\n> > friend.\n\nGood."), (1, 4, "user", "> not said by anyone\nHm."), (2, 0, "user", "> We meet at noon.\nother conversation"), (2, None, "user", None), (None, 3, None, "> x"), (2, 0, "user", "again"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("thread", F.lit("clash")).withColumn("passages", F.lit("clash"))
    got = {(r.conv_id, r.turn): r for r in chat.reply_ordered(df).collect()}
    assert [(got[1, k].reply_to, got[1, k].thread, got[1, k].depth) for k in range(5)] == [(None, 0, 0), (None, 1, 0), (0, 0, 1), (2, 0, 2), (None, 4, 0)]
    assert got[1, 2].text == "Fine, thanks." and got[1, 3].text == "Good." and got[1, 4].text == "Hm." and got[2, 0].reply_to is None
    assert got[1, 3].chat == "<|assistant|>\nGood.\n" and got[2, None].text == "" and chat.reply_ordered(df).count() == len(rows)
    assert chat.reply_ordered(df.where("false")).count() == 0


# mixing
def test_rates_match_targets(spark, none):
    rng = random.Random(8)
    other = [w[::-1] + "x" for w in WORDS]
    rows = [(k, prose(rng, 50)) for k in range(80)] + [(200 + k, " ".join(rng.choice(other) for _ in range(50))) for k in range(40)] + [(900, None), (901, ""), (1, prose(rng, 50))]
    df = table(spark, rows)
    labelled = spark.createDataFrame([(k, "a" if k < 200 else "b") for k, _ in rows[:120]] + [(5, None)], "labelled_id long, domain string")
    domains, rates = mixing.mixed_rates(df, labelled, {"a": 0.5, "b": 0.5, "unknown": 1.0})
    got = rates.agg(*[F.sum(F.col("n_tokens") * F.col("rate") * F.col(f"p{k}")).alias(f"t{k}") for k in range(2)], F.sum("n_tokens").alias("n"), F.min("rate").alias("least")).first()
    assert domains == ["a", "b"] and got.least >= 0 and rates.count() == len(rows)
    assert got.t0 == pytest.approx(got.n / 2, rel=1e-3) and got.t1 == pytest.approx(got.n / 2, rel=1e-3)
    out = mixing.repeated_to_targets(df, labelled, {"a": 0.5, "b": 0.5})
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert set(counts) == {k for k, _ in rows} and out.columns == df.columns
    assert sum(c for k, c in counts.items() if 200 <= k < 300) == pytest.approx(80, abs=12)
    assert mixing.mixed_rates(none, labelled, {"a": 1.0})[1].count() == 0
    assert mixing.mixed_rates(df, labelled.where("false"), {"a": 1.0})[1].count() == len(rows)


def test_word_scores_are_those_of_the_model_and_send_no_strings(spark, monkeypatch):
    rows = [(k, " ".join(f"w{(k * j) % 7}" for j in range(k % 5))) for k in range(40)] + [(None, "a b"), (50, None)]
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "n_bytes"]
    answer = lambda df: sorted(map(repr, df.select(columns).collect()))
    want = answer(context_tree.code_lengths(table(spark, rows).repartition(3), 100))
    monkeypatch.setattr(context_tree, "strings", None)
    monkeypatch.setattr(context_tree, "upper_nodes", None)
    found = context_tree.word_scores(table(spark, rows).repartition(3), 100)
    assert answer(found) == want and len(want) == 42
    assert context_tree._kinds(0, 0, 8) == [(0, 8, 0)]
