"""Context-tree weighting over binary-decomposed bytes, and a word baseline.

A text is a byte string with A-Z lower-cased and one end byte. Each byte is eight binary choices,
each with its own context tree over the ``DEPTH`` bytes before it. Counts of the training texts
give every node a Krichevsky-Trofimov block probability; a node's weighted probability halves that
and the product of its children's. The share of the halves is the weight with which a node's own
estimate is mixed with what the deeper nodes say, from the full depth up to the root.

The corpus job: batches send their distinct (context, byte) strings and words with their training
counts, each once, to buckets. A bucket holds whole subtrees below ``NEAR`` context bytes and weighs
them; the upper levels are summed by Spark and broadcast, with at most 256 * 256 * 255 nodes at any
size of the corpus (of real text about a hundredth of that). Buckets then answer each batch with
code lengths of its strings and counts of its words; texts don't move.

Defined results: a null text counts as empty; its tokens are the end alone. Rows without doc_id
are held out of training (their remainder is null). Repeated rows count as often as they occur.
Very long texts are read in parts; a text is held whole by one task. An empty table gives no rows.
Extra columns take no part. Words are told apart by 64-bit hashes. Code lengths of strings are
rounded to 2^-27 of a decimal digit, and are at most 32 digits.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .batches import Batch, bucket_of, from_planes, merged_counts, packed, planes
from .common import lowered, saved, saved_by, table, word_hashes, words_of

#: Context bytes; a string of context and byte fits 64 bits, so at most 7.
DEPTH = 6
#: Bytes of text in a batch.
BATCH_BYTES = 8 << 20
#: The strings of a bucket share their nearest context bytes.
NEAR = 3
#: Bytes of the corpus per bucket of strings.
BUCKET_BYTES = 12 << 20
#: Strings that are weighed at once, unless more share their nearest context.
SLICE = 1 << 17
#: Stands for the end of a text among word hashes.
END_WORD = np.uint64(0x7F4A7C159E3779B9)
_SENT = "batch long, bucket int, n int, keys binary, counts binary"
_MODEL = "bucket int, n int, keys binary, counts binary, total long, known long, nodes array<struct<node:long,below:double,n0:double,n1:double>>"
_ANSWER = "batch long, bucket int, answer binary"


def strings(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all bytes of all texts of a run and the number of each key's text.

    A key holds the byte before, the one before that, and so on, and last the byte itself, from
    the most significant byte on, so that subtrees of contexts are ranges of keys."""
    n = len(offsets) - 1
    long = np.zeros(len(data) + n * (depth + 1), np.uint64)
    sizes = np.diff(offsets)
    shift = np.repeat(np.arange(n) * (depth + 1) + depth, sizes)
    long[np.arange(len(data)) + shift] = lowered(data)
    own = np.ones(len(long), bool)
    starts = offsets[:-1] + np.arange(n) * (depth + 1)
    for k in range(depth):
        own[starts + k] = False
    at = np.flatnonzero(own)
    keys = np.zeros(len(at), np.uint64)
    for k in range(1, depth + 1):
        keys <<= np.uint64(8)
        keys |= long[at - k]
    return (keys << np.uint64(8)) | long[at], np.repeat(np.arange(n), sizes + 1)


def word_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = lowered(data)
    starts, ends, owner = words_of(data, offsets)
    n = len(offsets) - 1
    return np.concatenate((word_hashes(data, starts, ends), np.full(n, END_WORD))), np.concatenate((owner, np.arange(n)))


def is_training(ids: list) -> np.ndarray:
    return np.array([k is not None and zlib.crc32(str(k).encode()) % 10 != 0 for k in ids], bool)


def distinct(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs; sorts in place."""
    found.sort()
    first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else np.zeros(0, np.int64)
    return found[first], np.diff(np.append(first, len(found)))


class Keys:
    """The distinct strings (depth > 0) or words (depth 0) of a batch, in order, with their counts
    in its training texts, dealt over buckets."""

    def __init__(self, batch: Batch, depth: int, buckets: int):
        self.depth = depth
        training = is_training(batch.ids)
        n = len(batch.data) + len(batch.ids)  # there are at most as many tokens
        found, ends = np.empty(n, np.uint64), [0, n]
        for row, data, offsets in batch.parts():
            keys, owner = self.tokens(data, offsets)
            own = training[row + owner]
            m = int(np.count_nonzero(own))
            # keys of training texts from the front, others from the back
            found[ends[0] : ends[0] + m], found[ends[1] - (len(keys) - m) : ends[1]] = keys[own], keys[~own]
            ends = [ends[0] + m, ends[1] - (len(keys) - m)]
        own, times = distinct(found[: ends[0]])
        others, _ = distinct(found[ends[1] :])
        del found
        at = np.searchsorted(own, others)
        new = np.append(own, np.uint64(0))[at] != others
        new |= at == len(own)
        self.keys, self.counts = np.insert(own, at[new], others[new]), np.insert(times, at[new], 0)
        group = self.keys >> np.uint64(8 * (depth + 1 - NEAR)) if depth else self.keys
        bucket = bucket_of(group, buckets).astype(np.int32)
        self.order = np.argsort(bucket, kind="stable")
        self.cuts = np.searchsorted(bucket[self.order], np.arange(buckets + 1))

    def tokens(self, data: np.ndarray, offsets: np.ndarray):
        return strings(data, offsets, self.depth) if self.depth else word_tokens(data, offsets)

    def parts(self):
        """Bucket and places of its keys, for every bucket that has any."""
        for b in np.flatnonzero(self.cuts[1:] > self.cuts[:-1]).tolist():
            yield b, self.order[self.cuts[b] : self.cuts[b + 1]]


def _squeezed(values: np.ndarray) -> bytes:
    return pa.compress(planes(values), "zstd", asbytes=True)


def _restored(data: bytes, n: int, kind) -> np.ndarray:
    return from_planes(pa.decompress(data, n * np.dtype(kind).itemsize, "zstd", asbytes=True), n, kind)


def _in_order(keys: np.ndarray) -> bytes:
    return _squeezed(np.diff(keys, prepend=np.uint64(0)))


def _kinds(depth: int, buckets: int, word_buckets: int) -> list[tuple[int, int, int]]:
    """Depth, buckets and first bucket of strings (none where they have no buckets) and of words."""
    return [(depth, buckets, 0)] * (buckets > 0) + [(0, word_buckets, buckets)]


def _send(depth: int, buckets: int, word_buckets: int):
    def run(rows):
        for part in rows:
            for k in range(part.num_rows):
                batch = Batch(part, k)
                for levels_, n, first in _kinds(depth, buckets, word_buckets):
                    own = Keys(batch, levels_, n)
                    out = [(batch.number, first + b, len(at), _in_order(own.keys[at]), _squeezed(own.counts[at].astype(np.uint32))) for b, at in own.parts()]
                    if out:
                        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["batch", "bucket", "n", "keys", "counts"])

    return run


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0: Stirling's series at x + 8, stepped down."""
    product = np.ones_like(x)
    for k in range(8):
        product = product * (x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


_SMALL = 1 << 12
_HALVES, _WHOLES = (log_gamma(np.arange(_SMALL) + x) for x in (0.5, 1.0))


def _log_gamma_of(counts: np.ndarray, table_: np.ndarray, more: float) -> np.ndarray:
    out = table_[np.minimum(counts, _SMALL - 1).astype(np.int64)]
    large = np.flatnonzero(counts >= _SMALL)
    out[large] = log_gamma(counts[large] + more)
    return out


def block_probability(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma_of(n0, _HALVES, 0.5) + _log_gamma_of(n1, _HALVES, 0.5) - np.log(np.pi) - _log_gamma_of(n0 + n1, _WHOLES, 1.0)


def weigh(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of the weighted probability of nodes, and the share of their own estimate in it."""
    weighted = np.logaddexp(own, below) - np.log(2)
    return weighted, np.exp(own - np.log(2) - weighted)


class Level:
    """The nodes of one depth: for each of the eight choices of a byte, runs of the strings of that
    depth (context, byte), which are in order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, deeper: Level | None = None, up: np.ndarray | None = None):
        self.keys, self.counts, self.deeper, self.up = keys, counts, deeper, up
        self.first, self.node, self.one, self.share, self.weighted, self.n = [], [], [], [], [], []
        for step in range(8):
            prefix = keys >> np.uint64(8 - step)
            new = np.ones(len(keys), bool)
            new[1:] = prefix[1:] != prefix[:-1]
            first, node = np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - 1
            total = np.add.reduceat(counts, first)
            n1 = np.add.reduceat(np.where(self.bit(step), counts, 0.0), first)
            own = block_probability(total - n1, n1)
            if deeper is None:
                weighted, share = own, None
            else:
                weighted, share = weigh(own, np.bincount(node[up[deeper.first[step]]], deeper.weighted[step], len(first)))
            for out, value in ((self.first, first), (self.node, node), (self.one, (n1 + 0.5) / (total + 1)), (self.share, share), (self.weighted, weighted), (self.n, (total - n1, n1))):
                out.append(value)

    def bit(self, step: int) -> np.ndarray:
        return (self.keys >> np.uint64(7 - step)) & np.uint64(1) > 0

    def shallower(self) -> Level:
        """The level above: contexts without their farthest byte."""
        keys = ((self.keys >> np.uint64(16)) << np.uint64(8)) | (self.keys & np.uint64(255))
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        up = np.empty(len(keys), np.int32)
        up[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(k))))
        return Level(k[first], np.add.reduceat(self.counts[order], first), self, up)


def levels(keys: np.ndarray, counts: np.ndarray, depth: int) -> Level:
    """The level of ``NEAR`` context bytes, with the deeper ones below it."""
    level = Level(keys, counts.astype(float))
    for _ in range(depth - NEAR):
        level = level.shallower()
    return level


def slices(keys: np.ndarray, depth: int):
    """Ranges of about ``SLICE`` keys that don't cut subtrees below the nearest context."""
    near = keys >> np.uint64(8 * (depth + 1 - NEAR))
    cuts = np.flatnonzero(near[1:] != near[:-1]) + 1
    a = 0
    while a < len(keys):
        k = int(np.searchsorted(cuts, a + SLICE))
        b = int(cuts[k]) if k < len(cuts) else len(keys)
        yield slice(a, b)
        a = b


def _parents(level: Level, step: int) -> np.ndarray:
    """The nodes (two context bytes, choice) above the nodes of the level of ``NEAR`` bytes."""
    keys = level.keys[level.first[step]]
    choice = (np.uint64(1) << np.uint64(step)) | ((keys & np.uint64(255)) >> np.uint64(8 - step))
    return (((keys >> np.uint64(16)) << np.uint64(8)) | choice).astype(np.int64)


def upper_nodes(keys: np.ndarray, counts: np.ndarray, depth: int):
    """What the nodes at depth ``NEAR - 1`` get from a bucket: node, sum of ln, zeros and ones."""
    found = []
    for part in slices(keys, depth):
        level = levels(keys[part], counts[part], depth)
        found += [(_parents(level, s), level.weighted[s], *level.n[s]) for s in range(8)]
    if not found:
        return [np.zeros(0, np.int64), *[np.zeros(0)] * 3]
    node, *values = (np.concatenate(x) for x in zip(*found, strict=True))
    nodes, at = np.unique(node, return_inverse=True)
    return [nodes, *[np.bincount(at, v, len(nodes)) for v in values]]


class Top:
    """The upper levels as one step: a probability of the level of ``NEAR`` bytes below a node is
    mixed with all nodes above it to a + b * probability."""

    def __init__(self, node: np.ndarray, below: np.ndarray, n0: np.ndarray, n1: np.ndarray):
        order = np.argsort(node)
        self.node = node[order]
        n, under = (n0[order], n1[order]), below[order]
        self.a, self.b = np.zeros(len(node)), np.ones(len(node))
        at, nodes = np.arange(len(node)), self.node
        for _ in range(NEAR):
            weighted, share = weigh(block_probability(*n), under)
            one = (n[1] + 0.5) / (n[0] + n[1] + 1)
            self.a, self.b = (1 - share[at]) * self.a + share[at] * one[at], (1 - share[at]) * self.b
            nodes, up = np.unique(((nodes >> 16) << 8) | (nodes & 255), return_inverse=True)
            n, under, at = tuple(np.bincount(up, x, len(nodes)) for x in n), np.bincount(up, weighted, len(nodes)), up[at]


def code_digits(keys: np.ndarray, counts: np.ndarray, depth: int, top: Top) -> np.ndarray:
    """-log10 probability of every string's byte after its context, in 2^-27 of a digit."""
    out = np.empty(len(keys), np.uint32)
    for part in slices(keys, depth):
        upper = levels(keys[part], counts[part], depth)
        chain = [upper]
        while chain[-1].deeper is not None:
            chain.append(chain[-1].deeper)
        deepest = chain[-1]
        places = [np.arange(len(deepest.keys), dtype=np.int32)]
        for level in chain[-2::-1] if len(chain) > 1 else []:
            places.append(level.up[places[-1]])
        probability = np.ones(len(deepest.keys))
        for step in range(8):
            one = None
            for level, place in zip(chain[::-1], places, strict=True):
                node = level.node[step][place]
                here = level.one[step][node]
                one = here if one is None else one + level.share[step][node] * (here - one)
            at = np.searchsorted(top.node, _parents(upper, step))[upper.node[step][places[-1]]]
            one = top.a[at] + top.b[at] * one
            probability *= np.where(deepest.bit(step), one, 1 - one)
        out[part] = np.minimum(np.round(-np.log10(probability) * 2**27), 2**32 - 1).astype(np.uint32)
    return out


def _merge(depth: int, buckets: int):
    def run(key, rows):
        bucket, sizes = key[0].as_py(), rows["n"].to_pylist()
        sent = [(np.cumsum(_restored(k, n, np.uint64), dtype=np.uint64), _restored(c, n, np.uint32).astype(np.int64)) for k, c, n in zip(rows["keys"].to_pylist(), rows["counts"].to_pylist(), sizes, strict=True)]
        keys, counts = merged_counts([k for k, _ in sent], [c for _, c in sent])
        del sent
        upper = upper_nodes(keys, counts, depth) if bucket < buckets else [np.zeros(0, np.int64), *[np.zeros(0)] * 3]
        nodes = pa.StructArray.from_arrays([pa.array(x) for x in upper], names=["node", "below", "n0", "n1"])
        return pa.table({
            "bucket": pa.array([bucket], pa.int32()), "n": pa.array([len(keys)], pa.int32()), "keys": [_in_order(keys)], "counts": [_squeezed(counts)], "total": [int(counts.sum())],
            "known": [int((counts > 0).sum())], "nodes": pa.ListArray.from_arrays(pa.array([0, len(nodes)], pa.int32()), nodes),
        })

    return run


def _answers(depth: int, buckets: int, top):
    def run(key, asked, model):
        bucket, n = key[0].as_py(), model["n"][0].as_py()
        keys, values = np.cumsum(_restored(model["keys"][0].as_py(), n, np.uint64), dtype=np.uint64), _restored(model["counts"][0].as_py(), n, np.int64)
        if bucket < buckets:
            values = code_digits(keys, values, depth, top.value)
        answers = []
        for own, m in zip(asked["keys"], asked["n"].to_pylist(), strict=True):
            own = np.cumsum(_restored(own.as_py(), m, np.uint64), dtype=np.uint64)
            answers.append(_squeezed(values[np.searchsorted(keys, own)]))
        return pa.table({"batch": asked["batch"], "bucket": asked["bucket"], "answer": pa.array(answers, pa.binary())})

    return run


def _sums(own: Keys, batch: Batch, values: list[np.ndarray]) -> list[np.ndarray]:
    """Sums over every text of the values of its keys."""
    out = [np.zeros(len(batch.ids)) for _ in values]
    for row, data, offsets in batch.parts(1 << 18):
        tokens, owner = own.tokens(data, offsets)
        order = np.argsort(tokens)
        at, m = np.searchsorted(own.keys, tokens[order]), len(offsets) - 1
        for total, value in zip(out, values, strict=True):
            total[row : row + m] += np.bincount(owner[order], value[at], m)
    return out


def _score(depth: int, buckets: int, word_buckets: int, total: int, known: int):
    unit = np.log10(total + 0.1 * (known + 1))

    def run(key, rows, answers):
        del key
        found = dict(zip(answers["bucket"].to_pylist(), answers["answer"].to_pylist(), strict=True))
        batch = Batch(rows.combine_chunks().to_batches()[0])
        sums = [] if buckets else [np.full(len(batch.ids), np.nan)]
        for levels_, n, first in _kinds(depth, buckets, word_buckets):
            own, kind = Keys(batch, levels_, n), np.uint32 if levels_ else np.int64
            values = np.zeros(len(own.keys), kind)
            for b, at in own.parts():
                values[at] = _restored(found[first + b], len(at), kind)
            wanted = [-(values / 2**27)] if levels_ else [np.ones(len(values)), values > 0, np.log10(values + 0.1) - unit]
            sums += _sums(own, batch, wanted)
        held = [None if k is None else bool(zlib.crc32(str(k).encode()) % 10 == 0) for k in batch.ids]
        return pa.table({
            "doc_id": pa.array(batch.ids, pa.int64()), "held_out": pa.array(held, pa.bool_()), "n_tokens": pa.array(sums[1].astype(np.int64)), "n_known": pa.array(sums[2].astype(np.int64)),
            "train_tokens": pa.array(np.full(len(held), total, np.int64)), "base_score": pa.array(sums[3]), "score": pa.array(sums[0]), "n_bytes": pa.array(np.diff(np.concatenate(([0], batch.ends)))),
        })

    return run


def code_lengths(docs: DataFrame, batch_bytes: int = BATCH_BYTES, depth: int = DEPTH) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    n_bytes and bits_per_byte (of the text and its end). ``depth`` is 3 to 7."""
    if not NEAR <= depth <= 7:
        raise ValueError(f"depth is {NEAR} to 7, not {depth}")
    found = _scores(docs, batch_bytes, depth)
    return found.withColumn("bits_per_byte", -F.col("score") / (F.log10(F.lit(2.0)) * (F.col("n_bytes") + 1)))


def word_scores(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The columns of ``code_lengths`` that come from words, without the tree: no string is sent."""
    return _scores(docs, batch_bytes, 0).drop("score")


def _scores(docs: DataFrame, batch_bytes: int, depth: int) -> DataFrame:
    spark = ship(docs.sparkSession)
    batches, size = packed(docs, batch_bytes)
    buckets = max(32, size // BUCKET_BYTES + 1)
    word_buckets = max(8, buckets // 8)
    buckets = buckets if depth else 0
    sent = saved_by(batches.mapInArrow(_send(depth, buckets, word_buckets), _SENT), "bucket", buckets + word_buckets)
    model = saved_by(sent.groupBy("bucket").applyInArrow(_merge(depth, buckets), _MODEL), "bucket", buckets + word_buckets)
    words = model.where(F.col("bucket") >= buckets).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    top = None
    if buckets:
        nodes = model.select(F.inline("nodes")).groupBy("node").agg(*[F.sum(c).alias(c) for c in ("below", "n0", "n1")])
        upper = saved(nodes, "upper").toPandas()
        top = spark.sparkContext.broadcast(Top(*[upper[c].to_numpy() for c in ("node", "below", "n0", "n1")]))
    answers = sent.select("batch", "bucket", "n", "keys").groupBy("bucket").cogroup(model.select("bucket", "n", "keys", "counts").groupBy("bucket")).applyInArrow(_answers(depth, buckets, top), _ANSWER)
    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        _score(depth, buckets, word_buckets, *words), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_lengths(table(spark, sf_dir, "documents"))


def word_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that SQL can express: tokens, known tokens and the word baseline."""
    return word_scores(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 5).alias("base_score"))


#: crc32 of an id's digits, bit by bit.
CRC = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
WORD_BASE_SQL = rf"""
WITH d AS (SELECT doc_id, {CRC} % 10 = 0 AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS ws FROM documents),
t AS (SELECT doc_id, held_out, unnest(ws) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w), n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c.c) AS n_known, CAST(any_value(n.n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 0.1) / (n.n + 0.1 * (n.v + 1)))), 5) AS base_score
FROM t LEFT JOIN c USING (w), n GROUP BY doc_id, held_out
"""
