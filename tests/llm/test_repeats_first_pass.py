"""The first pass of op8: one digit per window, at the depth that the window chooses."""

import numpy as np
import pyarrow as pa

from grouploom.llm import repeats
from grouploom.llm.batches import Batch, _pack


def test_few_digits_find_the_windows_that_may_be_repeated():
    rng = np.random.default_rng(3)
    fresh = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = fresh(100)
    texts = [fresh(3000) + passage + fresh(500), fresh(10), passage, fresh(2000), None]
    rows = next(_pack(1 << 30)([pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], names=["doc_id", "text"])]))
    suffixes = repeats.Suffixes(Batch(rows))
    own = repeats.Chosen(suffixes, 50, 28, 40)
    data = suffixes.data.tobytes()
    m = len(data) - 49
    held = [a in range(3000, 3051) or a in range(3610, 3661) for a in range(m)]
    assert data[3000:3100] == data[3610:3710] == passage.encode()
    live = own.live(own.several, m)
    # besides, windows that hold a chosen string of the passage: at most 22 before it and after it
    assert live[held].all() and live.sum() <= 2 * (51 + 22)
    # only these windows' first digits are exchanged next
    needed = repeats._needed(suffixes, live, 50, 16)
    assert needed.sum() <= 2 * (85 + 2 * 22) and len(own.digits) < len(data) / 7
