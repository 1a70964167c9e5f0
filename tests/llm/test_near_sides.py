"""Pairs just at the bound share a key."""

import numpy as np
import pyarrow as pa
import pytest

from grouploom.llm import near_dedup


@pytest.mark.parametrize("percent", [70, 80, 85, 90])
def test_pairs_at_the_bound(percent):
    # 2 percent common words and 100 - percent own words each
    n, own = 4000, 100 - percent
    texts = []
    for k in range(n):
        common = [f"w{k}x{i}" for i in range(2 * percent)]
        texts += [" ".join(common + [f"w{k}{c}{i}" for i in range(own)]) for c in "ab"]
    side = near_dedup.sides(percent)
    assert near_dedup.found_share(side, percent) >= 0.999
    batch = pa.RecordBatch.from_arrays([pa.array(range(2 * n), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    halves = np.concatenate([np.array(part.column("halves").to_pylist()) for part in near_dedup._signatures(1, side)([batch])])
    equal = halves[::2] == halves[1::2]
    missed = n - int((equal[:, :side].any(axis=1) & equal[:, side:].any(axis=1)).sum())
    assert missed <= 14
