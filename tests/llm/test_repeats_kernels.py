"""What op8's steps hash and sort: only what stayed, in the order that a plain sort gives."""

import numpy as np
import pyarrow as pa
import pytest

from grouploom.llm import repeats
from grouploom.llm.batches import Batch, _pack


def test_stretches_hash_only_the_bytes_of_windows_that_stayed(monkeypatch):
    rng = np.random.default_rng(4)
    text = "".join(map(chr, rng.integers(97, 123, 20_000)))
    rows = next(_pack(1 << 30)([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])]))
    suffixes, stay = repeats.Suffixes(Batch(rows)), np.zeros(20_000 - 49, bool)
    stay[[100, 101, 102, 140, 9000]] = True
    stay[12_000:12_300] = True
    hashed, plain = [], repeats._FIRST.sums
    monkeypatch.setattr(repeats._FIRST, "sums", lambda data: hashed.append(len(data)) or plain(data))
    own = repeats.Stretches(suffixes, stay, 50, 28)
    # 100 to 189, 9000 to 9049, 12000 to 12348
    assert sum(hashed) == 90 + 50 + 349
    assert sorted(p for a, n in zip(own.start, own.count, strict=True) for p in range(a, a + n)) == np.flatnonzero(stay).tolist()
    # stretches end where windows aren't neighbours, however close they are
    assert {100, 140, 9000, 12_000} <= set(own.start.tolist())
    place, doc, *_ = own.windows(np.full(len(own.high), 2, np.uint8))
    assert place.tolist() == np.flatnonzero(stay).tolist() and set(doc.tolist()) == {1}


@pytest.mark.parametrize("width", [1, 2, 3, 8, 23])
def test_sliding_minimum(width):
    values = np.random.default_rng(width).integers(0, 1000, 100).astype(np.uint64)
    assert repeats.sliding_minimum(values, width).tolist() == [values[k : k + width].min() for k in range(101 - width)]


@pytest.mark.parametrize("lows", [1, 3])
def test_classes_and_orders_equal_plain_sorts(lows):
    rng = np.random.default_rng(lows)
    high, doc = rng.integers(0, 30, 400).astype(np.uint64) << np.uint64(40), rng.integers(0, 99, 400)
    low = high // np.uint64(7) + rng.integers(0, lows, 400).astype(np.uint64)
    h, w, least, cls = repeats.classes(high, low, doc)
    keys = sorted(set(zip(high.tolist(), low.tolist(), strict=True)))
    assert list(zip(h.tolist(), w.tolist(), strict=True)) == keys
    assert [keys[c] for c in cls] == list(zip(high.tolist(), low.tolist(), strict=True))
    assert least.tolist() == [doc[cls == k].min() for k in range(len(keys))]
    for bits, key in ((50, high >> np.uint64(20)), (64, high)):
        order, found = repeats._ordered(key, bits)
        assert order.tolist() == np.argsort(key, kind="stable").tolist() and found.tolist() == np.sort(key).tolist()
