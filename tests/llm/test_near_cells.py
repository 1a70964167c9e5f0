"""Shingles that many prefixes hold: every pair that can be linked meets, once, in one cell."""

import numpy as np
import pytest

from grouploom.llm import near_dedup


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_rows_of_hot_shingles_meet_once(spark, percent):
    rng = np.random.default_rng(percent)
    # shingle 0 is in a third of all rows, 1 to 4 in some, others in two or three
    shingles = np.concatenate((np.zeros(300, int), rng.integers(1, 5, 120), np.repeat(np.arange(10, 200), 2), [10, 11, 12]))
    sizes = rng.integers(1, 120, len(shingles))
    rows = [(int(s), k, k, int(n), 1) for k, (s, n) in enumerate(zip(shingles, sizes, strict=True))]
    prefix = spark.createDataFrame(rows, "s long, node long, comp long, n long, place long")
    one, two = near_dedup._cells(prefix, percent)
    met = [(r.node, r.node2) for r in one.join(two, ["s", "band", "i", "j"]).where("comp < comp2").select("node", "node2").collect()]
    assert len(met) == len(set(met))
    want = set()
    for s in set(shingles.tolist()):
        at = np.flatnonzero(shingles == s)
        want |= {(int(x), int(y)) for x in at for y in at if x < y and 100 * min(sizes[x], sizes[y]) >= percent * max(sizes[x], sizes[y])}
    assert want <= set(met)
    # a cell holds a small part of the hot shingle's rows
    assert max(r["count"] for r in one.where("s = 0").groupBy("band", "i", "j").count().collect()) < 40


def test_edited_texts_with_common_rare_shingles(spark):
    """Components that share keys and their rarest shingles, against brute force."""
    rng = np.random.default_rng(7)
    rows = []
    for k in range(120):
        words = [f"c{i}" for i in range(40)] + [f"g{k % 6}x{i}" for i in range(20)]
        for _ in range(int(rng.integers(0, 9))):
            words[int(rng.integers(0, len(words)))] = f"e{int(rng.integers(0, 30))}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 70).collect()}
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if 100 * len(sets[x] & sets[y]) >= 70 * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    assert got == {k: find(k) for k in range(len(rows))}
