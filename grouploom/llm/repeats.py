"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every suffix of every text is sorted by its own leading bytes, most significant digit first, and
only through ``LENGTH`` bytes; groups that are equal after the last pass are exactly the repeated
windows. A suffix leaves the sort as soon as one of its digits stands alone.

* A first pass over one digit of ``ANCHOR`` bytes, at the depth that the window itself chooses: the
  string with the least hash, the same in equal windows. Neighbours share it, so that only about a
  tenth as many digits as suffixes are exchanged. Suffixes whose digit occurs in a single text
  leave: no other text has their window.
* Passes over the digits of ``DIGIT`` bytes at depths 0, 16, 32 and ``LENGTH - DIGIT`` of the
  suffixes that stayed. The digit of a suffix at depth d is the first digit of the suffix d bytes
  further on, so one exchange of first digits serves all of these passes, under the same rule.
  Digits are told apart by a hash with about four slots per suffix of the corpus, so that a few
  suffixes stay that could leave; none leaves that must stay.
* The last pass decides on the whole window. Suffixes that stayed come in stretches of neighbours,
  and windows of a stretch that share the ``ANCHOR``-byte string with the least hash are sorted as
  one, by the bytes that they cover. Where stretches with one anchor differ, their windows are
  sorted one by one.

A digit's group is found by counting in the bucket of its hash (the order of digits is immaterial
to which suffixes are equal). Each batch of documents sends a digit once, however often it occurs
there, so copies and common passages collapse before the shuffle; buckets sort what they get and
answer the batches. A batch's row for a bucket is the unit of the exchange.

Equality in the last pass is equality of 128 bits: 32 of the anchor and 96 of the bytes covered.
With 10^13 stretches (some 10^14 bytes) the chance that any two unequal ones agree is below 1e-12.

Defined results: a null text counts as empty; texts shorter than ``LENGTH`` bytes lose nothing.
Rows that repeat a doc_id don't take bytes from one another. Rows without doc_id come after all
others and take nothing. Very long texts are sorted in units of ``UNIT`` suffixes with the same
result. Equal windows at several places of one text aren't repeats. An empty table gives no rows;
extra columns take no part.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .batches import Batch, from_planes, packed, planes
from .common import Rolling, mixed, saved, table

LENGTH, DIGIT, ANCHOR = 50, 16, 28
#: Suffixes that are hashed at once: what is held of them fits a core's cache.
CHUNK = 1 << 17
#: Suffixes whose first digits are sorted at once, in one worker's memory.
UNIT = 1 << 22
#: Bytes of text in a batch.
BATCH_BYTES = 8 << 20
#: Suffixes of the corpus per bucket of first digits.
BUCKET_SUFFIXES = 12 << 20
NO_ID = np.int64(2**62)
_FIRST, _SECOND = Rolling(1), Rolling(2)
_PLACE, _FACTOR = np.uint64((1 << 24) - 1), np.uint64(0xD6E8FEB86659FD93)
_DIGITS = "batch long, unit int, bucket int, n int, digits binary, several binary"
_WINDOWS = "batch long, bucket int, n int, high binary, low binary, docs binary"
_ANSWERS = "batch long, pass int, unit int, bucket int, answer binary"


def _squeezed(data: bytes) -> bytes:
    return pa.compress(data, "zstd", asbytes=True)


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(pa.decompress(data, -(-n // 8), "zstd", asbytes=True), np.uint8), count=n)


def _columns(out: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in ddl.split(", ")]
    columns = zip(*out, strict=True) if out else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[c for c, _ in fields])


class Suffixes:
    """The suffixes of a batch's texts."""

    def __init__(self, batch: Batch):
        self.batch, self.data = batch, batch.data
        sizes = np.diff(np.concatenate(([0], batch.ends)))
        self.text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.docs = np.array([NO_ID if k is None else k for k in batch.ids], np.int64)

    def inside(self, place: np.ndarray, length: int) -> np.ndarray:
        """Whether the string at each place lies in one text."""
        return self.text[place] == self.text[place + (length - 1)]

    def units(self, size: int):
        for unit, a in enumerate(range(0, len(self.data), size)):
            yield unit, a, min(a + size, len(self.data))


def digit_hashes(data: np.ndarray, digit: int) -> np.ndarray:
    """A hash of the ``digit`` bytes from every place on, read as words of eight bytes."""
    if digit % 8 or len(data) < digit:
        return _FIRST.grams(_FIRST.sums(data), digit)
    words = np.ndarray(len(data) - 7, np.dtype("<u8"), np.ascontiguousarray(data), strides=(1,)).copy()
    m = len(data) - digit + 1
    out = words[:m] * _FACTOR
    for k in range(8, digit, 8):
        out ^= out >> np.uint64(32)
        out += words[k : k + m]
        out *= _FACTOR
    out ^= out >> np.uint64(29)
    out *= _FACTOR
    return out


class FirstDigits:
    """The ``needed`` ones of the suffixes a to b of a batch in the order of their first digits' hashes."""

    def __init__(self, suffixes: Suffixes, needed: np.ndarray, a: int, b: int, digit: int, bits: int):
        keys, n = np.empty(b - a, np.uint64), 0
        for c in range(a, b, CHUNK):
            place = np.flatnonzero(needed[c : min(b, c + CHUNK)])
            if not len(place):
                continue
            data = suffixes.data[c : min(b, c + CHUNK) + digit - 1]
            hashes = digit_hashes(data, digit)[place] >> np.uint64(64 - bits)
            keys[n : n + len(place)] = (hashes << np.uint64(24)) | (place + (c - a)).astype(np.uint64)
            n += len(place)
        keys = keys[:n]
        keys.sort()
        self.place = (keys.astype(np.uint32) & np.uint32(_PLACE)).view(np.int32)
        keys >>= np.uint64(24)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))).astype(np.int32) if n else np.zeros(0, np.int32)
        self.digits = keys[first]
        del keys
        self.count = np.diff(first, append=np.int32(n))
        # places rise within a group, so its first and last text tell whether there are several
        self.several, more = np.zeros(len(first), bool), np.flatnonzero(self.count > 1)
        last = first[more] + self.count[more] - 1
        self.several[more] = suffixes.text[self.place[first[more]] + a] != suffixes.text[self.place[last] + a]


def bucket_ranges(bits: int, buckets: int) -> np.ndarray:
    """The least hash of each bucket, and one more."""
    return np.array([-(-(k << bits) // buckets) for k in range(buckets + 1)], np.uint64)


def hash_bits(suffixes: int) -> int:
    """Four to eight slots per suffix; beyond 2^38 suffixes fewer, and more suffixes stay."""
    return min(40, max(8, math.ceil(math.log2(4 * suffixes + 1))))


def _digit_rows(number: int, unit: int, digits: np.ndarray, several: np.ndarray, ranges: np.ndarray) -> list[tuple]:
    """Rows of distinct hashes in order, one per bucket."""
    cuts, out = np.searchsorted(digits, ranges), []
    for bucket in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        x, y = cuts[bucket], cuts[bucket + 1]
        steps = np.diff((digits[x:y] - ranges[bucket]).astype(np.uint32), prepend=np.uint32(0))
        out.append((number, unit, bucket, y - x, _squeezed(planes(steps)), _squeezed(np.packbits(several[x:y]).tobytes())))
    return out


def _answered(digits: np.ndarray, answers: dict, unit: int, ranges: np.ndarray) -> np.ndarray:
    """Which of a unit's distinct hashes occur in several texts."""
    cuts, out = np.searchsorted(digits, ranges), np.zeros(len(digits), np.uint8)
    for bucket in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        out[cuts[bucket] : cuts[bucket + 1]] = _bits(answers[unit, bucket], int(cuts[bucket + 1] - cuts[bucket]))
    return out.view(bool)


def _ordered(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of keys of ``bits`` bits, and the keys in order."""
    low = max(1, len(key).bit_length())
    if bits + low > 64:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    # numpy sorts plain words several times as fast as places
    both = (key << np.uint64(low)) | np.arange(len(key), dtype=np.uint64)
    both.sort()
    return (both & np.uint64((1 << low) - 1)).astype(np.int64), both >> np.uint64(low)


class Chosen:
    """The digits that a batch's windows choose, in the order of their hashes."""

    def __init__(self, suffixes: Suffixes, length: int, anchor: int, bits: int):
        keys, texts, self.windows, self.repeats = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        m = max(0, len(suffixes.data) - length + 1)
        for a in range(0, m, CHUNK):
            b = min(m, a + CHUNK)
            window = np.flatnonzero(suffixes.text[a:b] == suffixes.text[a + length - 1 : b + length - 1])
            if len(window):
                data = suffixes.data[a : b + length - 1]
                grams = _FIRST.grams(_FIRST.sums(data), anchor)
                least = sliding_minimum((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), length - anchor + 1)
                at = (least[window] & _PLACE).astype(np.int64)
                first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                # the least of several hashes is small: it is mixed again for the buckets
                keys.append(mixed(grams[at[first]]) >> np.uint64(64 - bits))
                texts.append(suffixes.text[window[first] + a])
                self.windows.append(window + a)
                self.repeats.append(np.diff(first, append=len(at)))
        key, text = np.concatenate(keys), np.concatenate(texts)
        order, sorted_key = _ordered(key, bits)
        first = np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.digits, count = sorted_key[first], np.diff(first, append=len(key))
        self.several = text[order[first]] != text[order[first + count - 1]]
        self.cls = np.empty(len(key), np.int64)
        self.cls[order] = np.repeat(np.arange(len(first)), count)

    def live(self, shared: np.ndarray, m: int) -> np.ndarray:
        """Which of the first ``m`` suffixes have a chosen digit that is ``shared``."""
        out = np.zeros(m, bool)
        out[np.concatenate(self.windows)] = np.repeat(shared[self.cls], np.concatenate(self.repeats))
        return out


def _send_chosen(length: int, anchor: int, bits: int, buckets: int):
    ranges = bucket_ranges(bits, buckets)

    def run(rows):
        for part in rows:
            for k in range(part.num_rows):
                batch = Batch(part, k)
                own = Chosen(Suffixes(batch), length, anchor, bits)
                yield _columns(_digit_rows(batch.number, 0, own.digits, own.several, ranges), _DIGITS)

    return run


def _live(length: int, anchor: int, bits: int, buckets: int):
    """Answer 0 of a batch: which of its suffixes stay after the first pass."""
    ranges = bucket_ranges(bits, buckets)

    def run(key, rows, answers):
        suffixes = Suffixes(Batch(rows.combine_chunks().to_batches()[0]))
        own = Chosen(suffixes, length, anchor, bits)
        live = own.live(_answered(own.digits, _by_pass(answers)[1], 0, ranges), max(0, len(suffixes.data) - length + 1))
        return pa.Table.from_batches([_columns([(key[0].as_py(), 0, 0, 0, _squeezed(np.packbits(live).tobytes()))], _ANSWERS)])

    return run


def _depths(length: int, digit: int) -> list[int]:
    return sorted({min(k, length - digit) for k in range(0, length, digit)})


def _needed(suffixes: Suffixes, live: np.ndarray, length: int, digit: int) -> np.ndarray:
    """The suffixes whose first digits the passes over live suffixes look at."""
    out = np.zeros(len(suffixes.data), bool)
    for depth in _depths(length, digit):
        out[depth : depth + len(live)] |= live
    return out


def _send_digits(length: int, digit: int, bits: int, buckets: int, size: int):
    ranges = bucket_ranges(bits, buckets)

    def run(key, rows, answers):
        suffixes, live = _stayed(rows, _by_pass(answers), length)
        needed, out = _needed(suffixes, live, length, digit), []
        for unit, a, b in suffixes.units(size):
            own = FirstDigits(suffixes, needed, a, b, digit, bits)
            out += _digit_rows(key[0].as_py(), unit, own.digits, own.several, ranges)
            del own
        return pa.Table.from_batches([_columns(out, _DIGITS)])

    return run


def _resolve_digits(bits: int, buckets: int):
    ranges = bucket_ranges(bits, buckets)

    def run(key, rows):
        """For each digit that a batch sent, whether it occurs in several texts: the counts of a
        bucket's digits, up to two."""
        bucket, sizes = key[0].as_py(), rows["n"].to_pylist()
        sent = list(zip(rows["digits"], sizes, strict=True))
        digits = lambda d, n: np.cumsum(from_planes(pa.decompress(d.as_buffer(), 4 * n, "zstd", asbytes=True), n, np.uint32), dtype=np.uint32)
        counts = np.zeros(int(ranges[bucket + 1] - ranges[bucket]), np.uint8)
        for (d, n), several in zip(sent, rows["several"].to_pylist(), strict=True):
            at = digits(d, n)
            counts[at] = np.minimum(counts[at] + 1 + _bits(several, n), 2)
        answers = [_squeezed(np.packbits(counts[digits(d, n)] > 1).tobytes()) for d, n in sent]
        fill = lambda x: pa.array([x] * len(sizes), pa.int32())
        return pa.table({"batch": rows["batch"], "pass": fill(1), "unit": rows["unit"], "bucket": fill(bucket), "answer": pa.array(answers, pa.binary())})

    return run


def _staying(suffixes: Suffixes, live: np.ndarray, answers: dict, length: int, digit: int, bits: int, buckets: int, size: int) -> np.ndarray:
    """Which of the live suffixes have only digits that occur in several texts."""
    shared, ranges, own = np.zeros(len(suffixes.data), bool), bucket_ranges(bits, buckets), None
    needed = _needed(suffixes, live, length, digit)
    for unit, a, b in suffixes.units(size):
        del own
        own = FirstDigits(suffixes, needed, a, b, digit, bits)
        shared[own.place + a] = np.repeat(_answered(own.digits, answers, unit, ranges), own.count)
    stay = live.copy()
    for depth in _depths(length, digit):
        stay &= shared[depth : depth + len(live)]
    return stay


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from minima of twice as many each time."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    more = width - have
    return np.minimum(values[: len(values) - more], values[more:]) if more else values


def covered(data: np.ndarray, window: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that the windows at these rising places cover, without those between, and the windows'
    places among them."""
    first = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1] + 1)))
    change = np.zeros(len(data) + 1, np.int32)
    change[window[first]] = 1
    change[window[np.append(first[1:] - 1, len(window) - 1)] + length] -= 1
    there = np.cumsum(change[:-1], dtype=np.int32) > 0
    return data[there], np.cumsum(there, dtype=np.int32)[window].astype(np.int64) - 1


def classes(high: np.ndarray, low: np.ndarray, doc: np.ndarray):
    """Distinct (high, low) in order with their least doc, and the class of every input."""
    order = np.argsort(high)
    h, w = high[order], low[order]
    new = np.ones(len(order), bool)
    new[1:] = h[1:] != h[:-1]
    if (~new[1:] & (w[1:] != w[:-1])).any():  # seldom: 64 bits agree and the others don't
        order = np.lexsort((low, high))
        h, w = high[order], low[order]
        new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    first, cls = np.flatnonzero(new), np.empty(len(order), np.int64)
    cls[order] = np.cumsum(new) - 1
    return h[first], w[first], np.minimum.reduceat(doc[order], first) if len(first) else doc[order], cls


class Stretches:
    """The suffixes of a batch that stayed, as stretches of windows with one anchor, in classes."""

    def __init__(self, suffixes: Suffixes, stay: np.ndarray, length: int, anchor: int):
        self.suffixes, self.length = suffixes, length
        found = []
        for a in range(0, len(stay), CHUNK):
            window = np.flatnonzero(stay[a : a + CHUNK])
            if len(window):
                data, place = covered(suffixes.data[a : a + min(CHUNK, len(stay) - a) + length - 1], window, length)
                one, two = _FIRST.sums(data), _SECOND.sums(data)
                grams = _FIRST.grams(one, anchor)
                least = sliding_minimum((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), length - anchor + 1)
                at = (least[place] & _PLACE).astype(np.int64)
                first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1))))
                start, count = place[first], np.diff(np.append(first, len(window)))
                stop = start + count - 1 + length
                high = (grams[at[first]] & np.uint64(0xFFFFFFFF00000000)) | (_FIRST.of(one, start, stop) >> np.uint64(32))
                found.append((window[first] + a, count, high, _SECOND.of(two, start, stop)))
        empty = (*(np.zeros(0, np.int64),) * 2, *(np.zeros(0, np.uint64),) * 2)
        self.start, self.count, high, low = (np.concatenate(x) for x in zip(*(found or [empty]), strict=True))
        self.doc = suffixes.docs[suffixes.text[self.start]]
        self.high, self.low, self.least, self.cls = classes(high, low, self.doc)

    def windows(self, answer: np.ndarray):
        """Place and doc of the windows of stretches that stand for their class's least document
        and whose anchor has other stretches, and their classes."""
        asked = np.flatnonzero((answer[self.cls] & 2 > 0) & (self.doc == self.least[self.cls]))
        places, high, low, docs = [], [], [], []
        for a in range(0, len(self.suffixes.data), CHUNK):
            own = asked[(self.start[asked] >= a) & (self.start[asked] < a + CHUNK)]
            if len(own):
                count = self.count[own]
                place = np.repeat(self.start[own] - a - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
                data, at = covered(self.suffixes.data[a : a + CHUNK + self.length - 1 + int(count.max())], place, self.length)
                # equal windows have equal anchors: the anchor leads the key
                anchor = np.repeat(self.high[self.cls[own]] & np.uint64(0xFFFFFFFF00000000), count)
                one, two = (r.grams(r.sums(data), self.length)[at] for r in (_FIRST, _SECOND))
                high.append(anchor | (one >> np.uint64(32)))
                low.append(two)
                places.append(place + a)
                docs.append(np.repeat(self.doc[own], count))
        if not places:
            high, low, places, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        doc = np.concatenate(docs)
        return np.concatenate(places), doc, *classes(np.concatenate(high), np.concatenate(low), doc)


def _bucket(high: np.ndarray, buckets: int) -> np.ndarray:
    return ((mixed(high >> np.uint64(32)) >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


def _parted(high: np.ndarray, buckets: int):
    bucket = _bucket(high, buckets)
    # words of 16 bits are sorted by counting
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(b, order[cuts[b] : cuts[b + 1]]) for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()]


def _rows(number: int, high: np.ndarray, low: np.ndarray, docs: np.ndarray, buckets: int) -> pa.RecordBatch:
    return _columns([(number, b, len(at), planes(high[at]), planes(low[at]), planes(docs[at])) for b, at in _parted(high, buckets)], _WINDOWS)


def _resolve(number: int):
    def run(key, rows):
        """Bit 0: the key also occurs in a smaller document. Bit 1: it doesn't, and its anchor
        occurs with another key."""
        sizes = rows["n"].to_pylist()
        parts = [[from_planes(p, n, kind) for p, n in zip(rows[c].to_pylist(), sizes, strict=True)] for c, kind in (("high", np.uint64), ("low", np.uint64), ("docs", np.int64))]
        high, low, docs = (np.concatenate(p) for p in parts)
        keys, _, least, cls = classes(high, low, docs)
        anchor = keys >> np.uint64(32)
        same = np.zeros(len(keys), bool)
        same[1:] = anchor[1:] == anchor[:-1]
        others = same.copy()
        others[:-1] |= same[1:]
        covered = least[cls] < docs
        answer = (covered | ((others[cls] & ~covered).astype(np.uint8) << 1)).astype(np.uint8)
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        fill = lambda x: pa.array([x] * len(sizes), pa.int32())
        return pa.table({"batch": rows["batch"], "pass": fill(number), "unit": fill(0), "bucket": fill(key[0].as_py()), "answer": pa.array([answer[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    return run


def _gather(high: np.ndarray, answers: dict, buckets: int) -> np.ndarray:
    out = np.zeros(len(high), np.uint8)
    for b, at in _parted(high, buckets):
        out[at] = np.frombuffer(answers[0, b], np.uint8)
    return out


def _by_pass(answers: pa.Table) -> dict[int, dict]:
    out = {k: {} for k in range(4)}
    for number, unit, bucket, answer in zip(*(answers[c].to_pylist() for c in ("pass", "unit", "bucket", "answer")), strict=True):
        out[number][unit, bucket] = answer
    return out


def _stayed(rows: pa.Table, found: dict, length: int) -> tuple[Suffixes, np.ndarray]:
    suffixes = Suffixes(Batch(rows.combine_chunks().to_batches()[0]))
    m = max(0, len(suffixes.data) - length + 1)
    return suffixes, _bits(found[0][0, 0], m).view(bool) if m else np.zeros(0, bool)


def _stretches(rows: pa.Table, found: dict, length: int, anchor: int) -> Stretches:
    return Stretches(*_stayed(rows, found, length), length, anchor)


def _mark(length: int, digit: int, bits: int, buckets: int, size: int):
    """Answer 0 of a batch: which of its suffixes stay after the passes over their own digits."""

    def run(key, rows, answers):
        found = _by_pass(answers)
        suffixes, live = _stayed(rows, found, length)
        stay = _staying(suffixes, live, found[1], length, digit, bits, buckets, size)
        return pa.Table.from_batches([_columns([(key[0].as_py(), 0, 0, 0, _squeezed(np.packbits(stay).tobytes()))], _ANSWERS)])

    return run


def _send_stretches(buckets: int, length: int, anchor: int):
    def run(key, rows, answers):
        own = _stretches(rows, _by_pass(answers), length, anchor)
        return pa.Table.from_batches([_rows(key[0].as_py(), own.high, own.low, own.least, buckets)])

    return run


def _send_windows(buckets: int, length: int, anchor: int):
    def run(key, rows, answers):
        found = _by_pass(answers)
        own = _stretches(rows, found, length, anchor)
        _, _, high, low, least, _ = own.windows(_gather(own.high, found[2], buckets))
        return pa.Table.from_batches([_rows(key[0].as_py(), high, low, least, buckets)])

    return run


def _remove(buckets: int, length: int, anchor: int, keep_text: bool):
    def run(key, rows, answers):
        del key
        found = _by_pass(answers)
        own = _stretches(rows, found, length, anchor)
        batch = own.suffixes.batch
        answer = _gather(own.high, found[2], buckets)
        gone = (answer[own.cls] & 1 > 0) | (own.doc > own.least[own.cls])
        change = np.zeros(len(batch.data) + 1, np.int32)
        np.add.at(change, own.start[gone], 1)
        np.add.at(change, own.start[gone] + own.count[gone] - 1 + length, -1)
        place, doc, high, _, least, cls = own.windows(answer)
        fine = _gather(high, found[3], buckets)
        lost = place[(fine[cls] & 1 > 0) | (doc > least[cls])]
        np.add.at(change, lost, 1)
        np.add.at(change, lost + length, -1)
        removed = np.cumsum(change[:-1], dtype=np.int32) > 0
        starts = np.concatenate(([0], batch.ends))
        out = {"doc_id": batch.ids, "n_bytes": np.diff(starts), "n_removed": [], "n_spans": [], "kept": []}
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            r = removed[a:b]
            out["n_removed"].append(int(r.sum()))
            out["n_spans"].append(int(r[:1].sum() + np.count_nonzero(r[1:] & ~r[:-1])))
            kept = batch.data[a:b][~r].tobytes()
            out["kept"].append(kept if keep_text else hashlib.sha256(kept).hexdigest())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary() if keep_text else pa.string())
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=True)})

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, keep_text: bool = True, batch_bytes: int = BATCH_BYTES, unit: int = UNIT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept, the bytes that remain (their
    SHA-256 in hex where ``keep_text`` is false). ``anchor`` is less than ``length``."""
    ship(docs.sparkSession)
    batches, size = packed(docs, batch_bytes)
    digit, bits = min(DIGIT, length), hash_bits(size)
    buckets = max(32, size // BUCKET_SUFFIXES + 1)
    grouped = batches.groupBy("batch")

    def answered(sent: DataFrame, resolve) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(resolve, _ANSWERS)

    def asked(answers: DataFrame, send, ddl: str) -> DataFrame:
        return grouped.cogroup(answers.groupBy("batch")).applyInArrow(send, ddl)

    # about a tenth of all digits are chosen
    few_bits, few = hash_bits(size // 8), max(32, size // 8 // BUCKET_SUFFIXES + 1)
    chosen = answered(batches.mapInArrow(_send_chosen(length, anchor, few_bits, few), _DIGITS), _resolve_digits(few_bits, few))
    live = saved(asked(chosen, _live(length, anchor, few_bits, few), _ANSWERS), "live")
    first = answered(asked(live, _send_digits(length, digit, bits, buckets, unit), _DIGITS), _resolve_digits(bits, buckets))
    stay = saved(asked(live.unionByName(first), _mark(length, digit, bits, buckets, unit), _ANSWERS), "stay")
    second = saved(answered(asked(stay, _send_stretches(buckets, length, anchor), _WINDOWS), _resolve(2)), "second")
    both = stay.unionByName(second)
    third = saved(answered(asked(both, _send_windows(buckets, length, anchor), _WINDOWS), _resolve(3)), "third")
    return asked(both.unionByName(third), _remove(buckets, length, anchor, keep_text), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'binary' if keep_text else 'string'}")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), keep_text=False).withColumnRenamed("kept", "kept_sha256")


#: Windows are 100 hex digits here; spans are runs of covered windows that touch.
OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(n - 49)) AS i FROM d WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT w.doc_id, w.i, lag(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS before FROM w JOIN f USING (s) WHERE f.first < w.doc_id),
g AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM c),
r AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY ALL),
k AS (SELECT d.doc_id, substr(h, 2 * coalesce(lag(b) OVER o, 0) + 1, 2 * (a - coalesce(lag(b) OVER o, 0))) AS piece, a FROM d JOIN r USING (doc_id) WINDOW o AS (PARTITION BY d.doc_id ORDER BY a)),
t AS (SELECT d.doc_id, d.n, coalesce(x.removed, 0) AS removed, coalesce(x.spans, 0) AS spans, coalesce(p.pieces, '') || substr(h, 2 * coalesce(x.last, 0) + 1) AS kept FROM d
      LEFT JOIN (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last FROM r GROUP BY 1) x USING (doc_id)
      LEFT JOIN (SELECT doc_id, string_agg(piece, '' ORDER BY a) AS pieces FROM k GROUP BY 1) p USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(removed AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM t
"""
