"""The FM-index, the prefix tree and whitening against plain Python, with the defined cases."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grouploom.llm import fm_index, prefix_tree, whitening

CLASHES = ("row", "ids", "item", "shard", "spans", "conv", "seq", "key", "range", "x", "n", "first")


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns})


# --- FM-index


def test_suffix_order_and_ranks():
    rng = np.random.default_rng(1)
    for _ in range(20):
        texts = [rng.integers(0, 3, rng.integers(0, 30)) for _ in range(rng.integers(1, 8))]
        texts += [texts[0], np.zeros(40, np.int64)]
        symbols = np.concatenate([np.concatenate((t + len(texts), [k])) for k, t in enumerate(texts)])
        order = fm_index.suffix_order(symbols)
        assert order.tolist() == sorted(range(len(symbols)), key=lambda p: symbols[p:].tolist())
        levels = int(symbols.max()).bit_length()
        tree = fm_index.WaveletTree(len(symbols), levels, fm_index.WaveletTree.build(symbols, levels))
        at = np.arange(len(symbols))
        found, rank = tree.symbols(at)
        assert found.tolist() == symbols.tolist()
        assert rank.tolist() == [int((symbols[:p] == symbols[p]).sum()) for p in at]


def words_of(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination_by_hand(docs, items, width):
    windows = {}
    for item, text in items:
        if item is None:
            continue
        w = words_of(text)
        for a in range(max(len(w) - width + 1, min(len(w), 1))):
            windows.setdefault(tuple(w[a : a + width]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if items_of := windows.get(tuple(w[a : a + n])):
                    hit |= set(range(a, a + n))
                    found |= items_of
        out.append((doc, len(w), tuple(sorted(hit)), tuple(sorted(found))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard, round_", [(1 << 19, 1 << 20), (23, 1 << 20), (40, 60)])
def test_contamination_equals_brute_force(spark, monkeypatch, shard, round_):
    monkeypatch.setattr(fm_index, "ROUND", round_)
    monkeypatch.setattr(fm_index, "PIECE", 7)
    rng = random.Random(shard)
    text = lambda n: " ".join(rng.choice(["a", "B", "Straße", "x9", "ø"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 8, 14, 30]))) for k in range(12)] + [(3, text(12)), (20, None), (21, " ..! "), (None, text(11)), (22, "MISSING word"), (23, items_text := text(25)), (24, items_text)]
    docs = [(k, rng.choice([text(rng.randrange(60)), text(5) + ",\n" + items_text + "!" + text(3)])) for k in range(30)]
    docs += [(40, None), (41, ""), (42, "?! --"), (5, docs[5][1]), (None, items_text), (43, text(400)), (44, "q" * 70000), (45, ("a " * 300))]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    index = fm_index.build(df, 10, shard)
    found = fm_index.search(index, fm_index.phrase_table(clashing(spark.createDataFrame(items, "item_id long, text string")), 10), 10).collect()
    got = [(r.doc_id, r.n_words, tuple(k for s in r.spans for k in range(s["first"], s["last"])), tuple(r["items"])) for r in found]
    assert sorted(got, key=repr) == contamination_by_hand(docs, items, 10)
    whole = dict(docs)
    for r in found:
        assert all(a["last"] < b["first"] for a, b in zip(r.spans, r.spans[1:], strict=False))
        if r.doc_id is not None:
            w = words_of(whole[r.doc_id])
            for s in r.spans:
                assert words_of((whole[r.doc_id] or "").encode()[s["start"] : s["stop"]].decode()) == w[s["first"] : s["last"]]


def test_spans_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "Keep this. one two three FOUR five six seven eight nine ten, and this"), (2, "clean"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three four five six seven eight nine ten")], "item_id long, text string")
    out = {r.doc_id: r.text for r in fm_index.without_spans(docs, fm_index.contamination(docs, items)).collect()}
    assert out == {1: "Keep this. , and this", 2: "clean", 3: None}


def test_empty_benchmark_and_empty_documents(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [(r.doc_id, r.n_words, r.spans, r["items"]) for r in fm_index.contamination(docs, items).collect()] == [(1, 2, [], [])]
    assert fm_index.contamination(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).collect() == []


# --- prefix tree


def tree_by_hand(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
    members = {}
    for c, s in full.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) > len(n) for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(full[c]) == len(node)))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_prefix_tree_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_tree, "RUN", 3)
    rng = random.Random(5)
    rows = []
    for c in [*range(70), -3, -7, 1003, 2004]:
        for t in range(rng.choice([1, 2, 3, 9, 12])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["ä", "yes", "no", "", None])))
    for c in range(100, 140):  # copies, which collapse
        rows += [(c, t, "user", "same") for t in range(10)]
    rows += [(200, None, "user", "null turn"), (200, None, "user", "another"), (200, 0, "user", "b"), (200, 0, "user", "a"), (200, 0, "user", "a"), (None, 1, "user", "lost"), (300, 1, "x", "long " * 50000)]
    rows += [(205, t, "user", f"hot {t % 7}") for t in range(600)]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7))
    turns = prefix_tree.ordered_turns(df)
    found = prefix_tree.tree(prefix_tree.rebuilt(turns, F.crc32(F.col("conv").cast("string").cast("binary")) % 9))
    got = sorted(map(tuple, prefix_tree.with_ends(found).collect()), key=repr)
    assert got == tree_by_hand(rows)


def test_tree_of_conversations_as_they_are(spark):
    rows = [(1, 0, "u", "hi"), (1, 1, "a", "yo"), (2, 0, "u", "hi"), (3, 0, "u", "hi"), (3, 1, "a", "no")]
    turns = prefix_tree.ordered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    whole = prefix_tree.as_they_are(turns)
    found = prefix_tree.tree(whole)
    assert sorted((r["first"], r.weight) for r in found.leaves.collect()) == [(1, 1), (3, 1)]
    texts = prefix_tree.node_texts(found.nodes, whole, turns).collect()
    assert sorted((r.conv_id, r.depth, r.role, r.text, r.n_convs, r.saved_tokens) for r in texts) == [(1, 1, "u", "hi", 3, 4), (1, 2, "a", "yo", 1, 0), (3, 2, "a", "no", 1, 0)]


def test_no_conversations(spark):
    turns = prefix_tree.ordered_turns(spark.createDataFrame([(None, 1, "u", "x")], "conv_id long, turn long, role string, text string"))
    assert prefix_tree.with_ends(prefix_tree.tree(prefix_tree.as_they_are(turns))).collect() == []


# --- whitening


def whitened(spark, rows, kind="float"):
    df = clashing(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3))
    return whitening.whitened(whitening.images(df)).collect()


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(0, 1, 5).round(3).tolist()) for k in range(60)]
    rows += [(3, rows[3][1]), (70, rows[3][1]), (71, None), (72, [1.0, None, 0.0, 0.0, 0.0]), (73, [float("nan")] * 5), (74, [float("inf")] * 5), (75, [0.25, 0.5]), (76, []), (None, [0.1] * 5), (77, [1e300] * 5)]
    got = whitened(spark, rows, "double")
    x = {}
    for k, v in rows:
        if v is not None and all(c is not None and math.isfinite(c) and abs(c) < 1e200 for c in v):
            x.setdefault(k, []).append([math.floor(64 * c) + 1000000 for c in v] + [1000000] * (5 - len(v)))
    fit = np.array(sorted({tuple(v) for vs in x.values() for v in vs}))
    n, mean = len(fit), fit.mean(axis=0)
    e, w = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    e, w, sums = e[::-1], w[:, ::-1], fit.sum(axis=0)
    assert len(got) == 5 * sum(map(len, x.values())) and {r.n for r in got} == {n}
    signs = {}
    for r in got:
        v = np.array(x[r.vec_id][0])
        want = (v - mean) @ w[:, r.component - 1] / math.sqrt(e[r.component - 1])
        sign = signs.setdefault(r.component, math.copysign(1, want * r.whitened))
        assert r.whitened == pytest.approx(sign * want, abs=1e-9)
        assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums, strict=True))
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9) and r.identity_error < 1e-9


def test_dependent_dimensions_have_no_scale(spark):
    got = whitened(spark, [(k, [k / 64.0, 0.5, -k / 64.0]) for k in range(9)])
    assert {(r.component, r.whitened is None) for r in got} == {(1, False), (2, True), (3, True)} and got[0].identity_error < 1e-9
    one = whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, 0.0)] * 4


def test_wide_values_stay_exact(spark):
    rng = random.Random(3)
    values = [[rng.choice([-1, 1]) * rng.random() * 2.0**45, 3.0, float(k % 2)] for k in range(12)]
    fit = np.array([[math.floor(64 * c) + 1000000 for c in v] for v in values], object)
    df = whitening.images(spark.createDataFrame(list(enumerate(values)), "vec_id long, embedding array<double>"))
    found = whitening.fit(df.select("x").distinct())
    for a in range(3):
        for b in range(3):
            mean = [Fraction(int(fit[:, k].sum()), 12) for k in (a, b)]
            assert Fraction(found.scaled[a][b], 144) == sum((int(r[a]) - mean[0]) * (int(r[b]) - mean[1]) for r in fit) / 12
    assert {r.deviation for r in whitening.whitened(df).where("vec_id = 0").collect()} == {None}


def test_vectors_of_no_rows_or_no_dimensions(spark):
    assert whitened(spark, [(1, None)]) == [] and whitened(spark, [(1, [])]) == []


def test_square_sums_in_both_ways():
    y = np.array([[1, -2, 3], [4, 5, -6]])
    big = y * (1 << 40)
    assert whitening.square_sums(y) == [17, 1 + 81, 16 + 4, 29, 1 + 1, 45]
    assert whitening.square_sums(big) == [v << 80 for v in whitening.square_sums(y)]
    assert whitening.matrix(pa.array([[1, 2], [3]], pa.list_(pa.int64())), 2).tolist() == [[1, 2], [3, whitening.SHIFT]]
