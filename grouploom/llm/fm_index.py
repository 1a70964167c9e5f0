"""Benchmark decontamination over an FM-index per shard of training texts.

``build`` turns documents into shards of about ``SHARD`` words. A shard's words are numbered in a
sorted vocabulary of 64-bit word hashes, every text ends with a separator of its own, and suffixes are
sorted by prefix doubling: only suffixes that still agree with another one are sorted again. The index
keeps

* the last column of the sorted rotations in a wavelet tree (levels of bits, laid out as a matrix),
* how often each symbol occurs,
* every ``SAMPLE``-th text position, at the rows of its suffix,
* where words start and end, so that hits are spans of the text.

``search`` narrows the rows of every phrase from its last word to its first by ranks in the wavelet
tree, all phrases of a shard at once; phrases with a word that the shard lacks are left out before. Each
row that is found steps back through the text until it meets a sampled position. Spans of the windows
found are merged per text.

The index is a stored table: it is built once and can be searched for other phrases later. Phrases are
sent to the shards in rounds of at most ``ROUND`` words, whatever the size of the benchmark. Texts of more
than ``SHARD`` words are cut; pieces overlap by ``longest - 1`` words on both sides, every word is owned
by one piece, and only owned words count, so a cut changes nothing.

Word equality is equality of 64-bit hashes: among 10^9 different words of a corpus and 10^5 of a benchmark
the chance of one false match is below 1e-5.

Defined results: null texts, and texts without words, have no words and aren't contaminated; items
without words have no windows. Very long texts are cut as said. Items that repeat an item_id count as one
item with the windows of all. Items without item_id take no part. Rows that repeat a doc_id, or have none,
each give a row. Empty tables are allowed on both sides; extra columns take no part.
"""

from __future__ import annotations

import os
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import fresh, lowered, saved, saved_by, table, text_parts, word_hashes, words_of

#: Words of a shard; with a separator per text it has fewer than 2**21 symbols.
SHARD = 1 << 19
WIDTH, SAMPLE = 10, 16
#: Words of phrases that are sent to the shards at once, and of an item's piece.
ROUND, PIECE = 1 << 20, 1 << 16
#: Occurrences that are located at once.
LOCATED = 1 << 18
_SYMBOL = np.uint64(21)
_MASK = np.uint64((1 << 21) - 1)
#: Bytes that aren't in words: ASCII but digits and lower-case letters (upper-case ones are lowered).
OUTSIDE = np.zeros(256, bool)
OUTSIDE[:128] = True
OUTSIDE[48:58] = OUTSIDE[97:123] = False
INDEX = "shard long, rows array<long>, ids array<long>, words array<int>, own array<int>, lead array<int>, base array<int>, n int, longest int, vocabulary binary, counts binary, levels int, bits binary, marks binary, samples binary, gaps binary, lengths binary"


def _packed(values: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest needs, compressed."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    data = values.astype(kind).tobytes()
    return bytes([kind.itemsize]) + len(values).to_bytes(8, "little") + (pa.compress(data, "zstd", asbytes=True) if data else b"")


def _unpacked(blob: bytes) -> np.ndarray:
    size, n = blob[0], int.from_bytes(blob[1:9], "little")
    data = pa.decompress(blob[9:], n * size, "zstd", asbytes=True) if n else b""
    return np.frombuffer(data, f"<u{size}").astype(np.int64)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order. Symbols are below 2**21 and the last of every text is unique,
    so that suffixes which agree so far never reach beyond a text."""
    n = len(symbols)
    s, place = symbols.astype(np.uint64), np.arange(n, dtype=np.uint64)
    key = (s << np.uint64(42)) | place
    key[:-1] |= s[1:] << _SYMBOL
    key.sort()
    order, group = (key & _MASK).astype(np.int32), key >> _SYMBOL
    slots, h = np.arange(n, dtype=np.int32), 2
    rank = np.empty(n, np.uint64)
    while True:
        first = np.concatenate(([True], group[1:] != group[:-1]))
        start = slots[np.maximum.accumulate(np.where(first, np.arange(len(first), dtype=np.int32), 0))]
        rank[order[slots]] = start.astype(np.uint64)
        alone = first.copy()
        alone[:-1] &= first[1:]
        slots = slots[~alone]
        if not len(slots):
            return order
        at = order[slots].astype(np.uint64)
        key = (rank[at] << np.uint64(42)) | (rank[at + np.uint64(h)] << _SYMBOL) | at
        key.sort()
        order[slots] = (key & _MASK).astype(np.int32)
        group, h = key >> _SYMBOL, 2 * h


class WaveletTree:
    """Ranks and symbols of a sequence, from its levels of bits (most significant first); each level
    is ordered by the bits above it."""

    def __init__(self, n: int, levels: int, bits: np.ndarray):
        self.n, self.levels = n, levels
        self.words = np.ascontiguousarray(bits).reshape(levels, -1)
        counts = np.bitwise_count(self.words)
        self.before = np.cumsum(counts, axis=1, dtype=np.int64) - counts
        self.zeros = n - counts.sum(axis=1, dtype=np.int64)

    @staticmethod
    def build(sequence: np.ndarray, levels: int) -> np.ndarray:
        x, out = sequence.astype(np.int32), np.zeros((levels, len(sequence) // 64 + 1), np.uint64)
        for k in range(levels):
            bit = (x >> (levels - 1 - k)) & 1 == 1
            packed = np.packbits(bit, bitorder="little")
            out[k].view(np.uint8)[: len(packed)] = packed
            x = np.concatenate((np.compress(~bit, x), np.compress(bit, x)))
        return out.ravel()

    def ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, low = at >> 6, (np.uint64(1) << (at & 63).view(np.uint64)) - np.uint64(1)
        return self.before[level].take(word) + np.bitwise_count(self.words[level].take(word) & low)

    def down(self, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Where places go when they follow the bits of symbols through all levels."""
        for k in range(self.levels):
            ones = self.ones(k, at)
            at = np.where((symbols >> (self.levels - 1 - k)) & 1 == 1, self.zeros[k] + ones, at - ones)
        return at

    def symbols(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places, and how often each occurs before its place."""
        symbol, base = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for k in range(self.levels):
            bit = (self.words[k].take(at >> 6) >> (at & 63).view(np.uint64)) & np.uint64(1) == 1
            ones, zero = self.ones(k, at), self.ones(k, base)
            at = np.where(bit, self.zeros[k] + ones, at - ones)
            base = np.where(bit, self.zeros[k] + zero, base - zero)
            symbol = (symbol << 1) | bit
        return symbol, at - base


class Piece(NamedTuple):
    """A text, or a piece of a long one: ``own`` words after ``lead`` others, from word ``base`` of the
    text on."""

    row: int
    id: int | None
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    lead: int
    own: int
    base: int


def _shard(number: int, texts: list[Piece], longest: int) -> tuple:
    """An index row."""
    sizes = np.array([len(t.hashes) for t in texts])
    hashes = np.concatenate([t.hashes for t in texts])
    # words by the upper bits of their hashes with their places below; the few that agree there are sorted whole
    m = len(hashes)
    key = (hashes & ~_MASK) | np.arange(m, dtype=np.uint64)
    key.sort()
    at = (key & _MASK).astype(np.int64)
    h = hashes[at]
    if (h[1:] < h[:-1]).any():
        at = np.argsort(hashes, kind="stable")
        h = hashes[at]
    first = np.concatenate(([True], h[1:] != h[:-1])) if m else np.zeros(0, bool)
    word = np.empty(m, np.int64)
    word[at] = np.cumsum(first) - 1
    docs = len(texts)
    place = np.arange(m) + np.repeat(np.arange(docs), sizes)
    symbols = np.empty(m + docs, np.int64)
    symbols[place] = word + docs
    symbols[np.cumsum(sizes) + np.arange(docs)] = np.arange(docs)
    order = suffix_order(symbols)
    levels = max(1, int(symbols.max(initial=0)).bit_length())
    marked = order % SAMPLE == 0
    marks = np.zeros(len(order) // 64 + 1, np.uint64)
    packed = np.packbits(marked, bitorder="little")
    marks.view(np.uint8)[: len(packed)] = packed
    starts, ends = np.concatenate([t.starts for t in texts]), np.concatenate([t.ends for t in texts])
    # bytes between words; a text's first word counts from its text's (or piece's) own start
    gaps = starts - np.concatenate(([0], ends[:-1])) if m else starts
    head = (np.cumsum(sizes) - sizes)[sizes > 0]
    gaps[head] = starts[head]
    return (
        number, [t.row for t in texts], [t.id for t in texts], sizes.tolist(), [t.own for t in texts], [t.lead for t in texts], [t.base for t in texts], len(symbols), longest, h[first].tobytes(),
        _packed(np.diff(np.flatnonzero(np.append(first, True)))), levels, WaveletTree.build(symbols[order - 1], levels).tobytes(), marks.tobytes(),
        _packed(np.compress(marked, order) // SAMPLE), _packed(gaps), _packed(ends - starts),
    )


def _build(shard: int, longest: int):
    reach = longest - 1

    def run(batches):
        held, words, row = [], 0, int.from_bytes(os.urandom(8), "little") >> 2

        def out():
            values = _shard(int.from_bytes(os.urandom(8), "little") >> 1, held, longest)
            kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
            fields = [x.split() for x in INDEX.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], kinds[t]) for v, (_, t) in zip(values, fields, strict=True)], names=[c for c, _ in fields])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, data, offsets in text_parts(batch.column(1), 1 << 20):
                starts, ends, owner = words_of(low := lowered(data), offsets, OUTSIDE)
                hashes = word_hashes(low, starts, ends)
                cuts = np.searchsorted(owner, np.arange(len(offsets)))
                for k in range(len(offsets) - 1):
                    a, b = cuts[k], cuts[k + 1]
                    size = int(b - a)
                    for base in range(0, max(size, 1), shard):
                        # a piece: its own words, and the words around them that a phrase may reach
                        own, lead = min(shard, size - base), min(reach, base)
                        piece = slice(a + base - lead, min(b, a + base + own + reach))
                        if words and words + own + len(held) > shard:
                            yield out()
                            held, words = [], 0
                        held.append(Piece(row, ids[first + k], hashes[piece], starts[piece] - offsets[k], ends[piece] - offsets[k], lead, own, base))
                        words += own
                    row += 1
        if held:
            yield out()

    return run


def build(docs: DataFrame, longest: int = WIDTH, shard: int = SHARD) -> DataFrame:
    """The index of ``docs`` (doc_id, text), a stored table with a row per shard; phrases of at most
    ``longest`` words can be searched in it."""
    if not 1 <= longest <= 1 << 16 or shard > 1 << 20:
        raise ValueError("phrases have 1 to 65536 words, shards at most 2**20")
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return saved_by(docs.mapInArrow(_build(shard, longest), INDEX), "shard", 1)


class Shard:
    """An index row, opened."""

    def __init__(self, row: dict):
        self.rows, self.ids = row["rows"], row["ids"]
        self.own, self.lead, self.base = (np.array(row[c], np.int64) for c in ("own", "lead", "base"))
        #: Place of each text's first word; its words are followed by a separator.
        self.first = np.concatenate(([0], np.cumsum(np.array(row["words"], np.int64) + 1)))
        self.n, self.longest = row["n"], row["longest"]
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        docs = len(self.rows)
        counts = np.concatenate((np.ones(docs, np.int64), _unpacked(row["counts"])))
        self.before = np.concatenate(([0], np.cumsum(counts)))
        self.tree = WaveletTree(self.n, row["levels"], np.frombuffer(row["bits"], np.uint64))
        self.marks = WaveletTree(self.n, 1, np.frombuffer(row["marks"], np.uint64))
        self.samples = _unpacked(row["samples"]) * SAMPLE
        gaps, lengths = _unpacked(row["gaps"]), _unpacked(row["lengths"])
        to = np.cumsum(gaps + lengths)
        words = np.array(row["words"], np.int64)
        before = np.repeat(np.concatenate(([0], to))[np.cumsum(words) - words], words)
        self.ends = to - before
        self.starts = self.ends - lengths

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of word hashes; -1 for words that the shard lacks."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), max(len(self.vocabulary) - 1, 0))
        known = self.vocabulary[at] == hashes if len(self.vocabulary) else np.zeros(len(hashes), bool)
        return np.where(known, at + len(self.rows), -1)

    def ranges(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase: backward search."""
        last = symbols[start + size - 1]
        low, high = self.before[last], self.before[last + 1]
        for step in range(1, int(size.max(initial=0))):
            open_ = np.flatnonzero((size > step) & (low < high))
            if not len(open_):
                break
            c = symbols[start[open_] + size[open_] - 1 - step]
            low[open_], high[open_] = self._narrowed(c, low[open_], high[open_])
        return low, np.maximum(low, high)

    def _narrowed(self, c: np.ndarray, low: np.ndarray, high: np.ndarray):
        k = len(c)
        found = self.tree.down(np.concatenate((low, high, np.zeros(k, np.int64))), np.tile(c, 3))
        return self.before[c] + found[:k] - found[2 * k :], self.before[c] + found[k : 2 * k] - found[2 * k :]

    def located(self, rows: np.ndarray) -> np.ndarray:
        """Text places of rows: step back to a sampled one."""
        place, at, open_ = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        for steps in range(SAMPLE):
            here = at[open_]
            marked = (self.marks.words[0, here >> 6] >> (here & 63).astype(np.uint64)) & np.uint64(1) == 1
            place[open_[marked]] = self.samples[self.marks.ones(0, here[marked])] + steps
            open_, here = open_[~marked], here[~marked]
            if not len(open_):
                break
            symbol, rank = self.tree.symbols(here)
            at[open_] = self.before[symbol] + rank
        return place


class Phrases:
    """Windows of items, by their places in one array of word hashes."""

    def __init__(self, rows: list[tuple[str, bytes, bool]], width: int):
        self.items = sorted({r[0] for r in rows})
        number = {x: k for k, x in enumerate(self.items)}
        starts, sizes, items, at, words = [], [], [], 0, []
        for item, blob, whole in rows:
            w = np.frombuffer(blob, np.uint64)
            words.append(w)
            if len(w) >= width:
                starts.append(at + np.arange(len(w) - width + 1))
                sizes.append(np.full(len(starts[-1]), width))
            elif whole and len(w):
                starts.append(np.array([at]))
                sizes.append(np.array([len(w)]))
            else:
                at += len(w)
                continue
            items.append(np.full(len(starts[-1]), number[item]))
            at += len(w)
        none = np.zeros(0, np.int64)
        self.starts, self.sizes, self.owners = (np.concatenate(x) if x else none for x in (starts, sizes, items))
        hashes = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.vocabulary, self.word = np.unique(hashes, return_inverse=True)


FOUND = "row long, doc_id long, n_words long, spans array<struct<first:long,last:long,start:long,stop:long>>, items array<string>"


def _hits(shard: Shard, phrases: Phrases):
    """Spans of owned words that are hit, as arrays (text, first, last, start, stop): words of the text
    and bytes; and pairs (text, item) found."""
    symbols = shard.words(phrases.vocabulary)[phrases.word]
    lacking = np.concatenate(([0], np.cumsum(symbols < 0)))
    known = np.flatnonzero(lacking[phrases.starts + phrases.sizes] == lacking[phrases.starts])
    sizes, owners = phrases.sizes[known], phrases.owners[known]
    low, high = shard.ranges(symbols, phrases.starts[known], sizes)
    total = np.concatenate(([0], np.cumsum(high - low)))
    depth, pairs = np.zeros(shard.n + 1, np.int64), [np.zeros(0, np.int64)]
    for a in range(0, int(total[-1]), LOCATED):
        number = np.arange(a, min(a + LOCATED, int(total[-1])))
        window = np.searchsorted(total, number, side="right") - 1
        place = shard.located(low[window] + number - total[window])
        depth += np.bincount(place, minlength=shard.n + 1) - np.bincount(place + sizes[window], minlength=shard.n + 1)
        text = np.searchsorted(shard.first, place, side="right") - 1
        pairs.append(np.unique(text * len(phrases.items) + owners[window]))
    hit = np.concatenate(([0], (np.cumsum(depth[:-1]) > 0).astype(np.int8), [0]))
    start, stop = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
    text = np.searchsorted(shard.first, start, side="right") - 1
    from_ = (shard.first[:-1] + shard.lead)[text]
    start, stop = np.maximum(start, from_), np.minimum(stop, from_ + shard.own[text])
    inside = start < stop
    text, start, stop, from_ = text[inside], start[inside], stop[inside], from_[inside]
    base = shard.base[text] - from_
    spans = (text, base + start, base + stop, shard.starts[start - text], shard.ends[stop - 1 - text])
    both = np.unique(np.concatenate(pairs))
    return spans, np.divmod(both, max(len(phrases.items), 1))


def _search(phrases, first_round: bool):
    def run(table: pa.Table) -> pa.Table:
        out: dict[int, list] = {}
        for row in table.to_pylist():
            shard = Shard(row)
            (text, *spans), (doc, item) = _hits(shard, phrases.value)
            cut, at = np.searchsorted(text, np.arange(len(shard.rows) + 1)), np.searchsorted(doc, np.arange(len(shard.rows) + 1))
            spans = [x.tolist() for x in spans]
            names = [phrases.value.items[k] for k in item.tolist()]
            own = shard.own.tolist()
            for k, number in enumerate(shard.rows):
                a, b = cut[k], cut[k + 1]
                if first_round or a < b or at[k] < at[k + 1]:
                    found = [dict(zip(("first", "last", "start", "stop"), x, strict=True)) for x in zip(*[s[a:b] for s in spans], strict=True)]
                    for c, v in enumerate((number, shard.ids[k], own[k] if first_round else 0, found, names[at[k] : at[k + 1]])):
                        out.setdefault(c, []).append(v)
        span = pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "stop")])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(span), pa.list_(pa.string()))
        return pa.table([pa.array(out.get(c, []), t) for c, t in enumerate(kinds)], names=["row", "doc_id", "n_words", "spans", "items"])

    return run


def phrase_table(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item (id as text), words (hashes), whole (the item is this row alone), n: items in pieces of at
    most ``PIECE`` words that overlap by ``width - 1``."""
    ship(items.sparkSession)

    def run(batches):
        for batch in batches:
            names, out = batch.column(0).to_pylist(), []
            for first, data, offsets in text_parts(batch.column(1), 1 << 20):
                starts, ends, owner = words_of(low := lowered(data), offsets, OUTSIDE)
                hashes = word_hashes(low, starts, ends)
                cuts = np.searchsorted(owner, np.arange(len(offsets)))
                for k in range(len(offsets) - 1):
                    w = hashes[cuts[k] : cuts[k + 1]]
                    for a in range(0, max(len(w) - width + 1, min(len(w), 1)), PIECE):
                        piece = w[a : a + PIECE + width - 1]
                        out.append((names[first + k], piece.tobytes(), len(w) == len(piece), len(piece)))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.bool_(), pa.int64()), strict=True)], names=["item", "words", "whole", "n"])

    rows = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return saved(rows.mapInArrow(run, "item string, words binary, whole boolean, n long"), "phrases")


def _rounds(phrases: DataFrame):
    """Lists of phrase rows of at most ``ROUND`` words (a piece more), read one after the other."""
    held, words = [], 0
    for r in phrases.toLocalIterator():
        held.append((r["item"], bytes(r["words"]), r["whole"]))
        words += r["n"]
        if words >= ROUND:
            yield held
            held, words = [], 0
    yield held


def search(index: DataFrame, phrases: DataFrame, width: int = WIDTH) -> DataFrame:
    """row, doc_id, n_words, spans and items of every text of the index. Spans are words first to last
    and bytes start to stop of the text, each without its end, merged; items are those with a window in
    the text, sorted."""
    spark = index.sparkSession
    ship(spark)
    parts = None
    for k, rows in enumerate(_rounds(phrases)):
        sent = spark.sparkContext.broadcast(Phrases(rows, width))
        found = index.groupBy("shard").applyInArrow(_search(sent, k == 0), FOUND)
        parts = saved(found, "found") if parts is None else parts.unionByName(saved(found, "found"))
    out = parts.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    last = lambda a: F.element_at(a, -1)

    def joined(a, s):
        end = F.struct(last(a)["first"].alias("first"), F.greatest(last(a)["last"], s["last"]).alias("last"), last(a)["start"].alias("start"), F.greatest(last(a)["stop"], s["stop"]).alias("stop"))
        return F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["last"] >= s["first"]), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(end))).otherwise(F.concat(a, F.array(s)))

    empty = F.array().cast(out.schema["spans"].dataType)
    # spans of one round are merged already; several rounds or pieces may touch
    merged = F.when(F.size("spans") > 1, F.aggregate("spans", empty, joined)).otherwise(F.col("spans"))
    return out.withColumn("spans", merged)


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``search`` of all windows of ``items`` (item_id, text) in a new index of ``docs``."""
    return search(build(docs, width), phrase_table(items, width), width)


def without_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs``, whose doc_id must be unique, with the bytes of the found spans cut out of their texts."""
    doc, spans = fresh(docs, "hit_doc"), fresh(docs, "hit_spans")
    hit = found.where(F.size("spans") > 0).select(F.col("doc_id").alias(doc), F.col("spans").alias(spans))
    raw = F.col("text").cast("binary")
    stops = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans, lambda s: s["stop"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length("text").cast("bigint")))
    kept = F.aggregate(F.zip_with(stops, starts, lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int"))), F.lit(b""), lambda a, b: F.concat(a, b))
    joined = docs.join(hit, F.col("doc_id") == F.col(doc), "left")
    return joined.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(kept.cast("string"))).select(docs.columns)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


OP12_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (SELECT DISTINCT item, len(win) AS n, win FROM (SELECT item, unnest(CASE WHEN len(ws) < 10 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 8), lambda k: array_to_string(ws[k:k + 9], ' ')) END) AS win FROM b WHERE len(ws) > 0)),
z AS (SELECT DISTINCT len(string_split(win, ' ')) AS n, win FROM i),
d AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS win FROM w, (SELECT DISTINCT n FROM z), range(1, CAST(len(ws) - n + 2 AS BIGINT)) r(k)),
o AS (SELECT doc_id, d.n, k, win FROM d SEMI JOIN z USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM o, range(k, k + o.n) r(p) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM o JOIN i USING (win) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
