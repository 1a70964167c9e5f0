"""Quality classifier: a generalised additive model with pairwise interactions.

Features of whole texts are counted in Arrow batches. Cyclic boosting of shallow trees fits one
lookup table per feature and one per chosen pair of features, on a bounded sample of labelled rows
(``SAMPLE``, the rows with the least hash of their id; the bound covers fitting only). A text's
score is the logistic of the sum of its bins' entries. Labels, language, source and id are never
features.

Defined results: null and empty texts have all features 0 and are scored like any other. Labelled
rows without a quality are left out; repeated ones count as often as they occur. Without labelled
rows of both classes every score is the smoothed share of label 1. Very long texts are counted
whole. A score of exactly 0.5 counts as label 1; of equally good cuts the first is taken. An empty
table gives no rows. Extra columns take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import fresh, saved, table, text_parts, training_rows, word_hashes, words_of

#: Labelled rows that a fit uses at most.
SAMPLE = 20_000
#: Bytes of text whose features are counted at once; a longer text is counted whole.
PART_BYTES = 1 << 19
BINS, CYCLES, PAIRS, PAIR_CYCLES, RATE = 32, 120, 10, 60, 0.15

_bytes = np.arange(256)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _LOWER = (_bytes >= 65) & (_bytes <= 90), (_bytes >= 97) & (_bytes <= 122)
_DIGIT, _HIGH = (_bytes >= 48) & (_bytes <= 57), _bytes >= 128
_CLASSES = {
    "upper": _UPPER, "lower": _LOWER, "digit": _DIGIT, "high": _HIGH, "stop": _class(b"."), "comma": _class(b","), "bang": _class(b"!?"),
    "symbol": _class(b"#$%&*+<=>@^_`|~\\/{}[]"), "quote": _class(b"\"'-;:()"), "line": _class(b"\n"), "control": (_bytes < 9) | ((_bytes > 13) & (_bytes < 32)) | (_bytes == 127),
}
NAMES = (
    *(f"share_{k}" for k in _CLASSES), "log_bytes", "log_words", "mean_word", "sd_word", "long_words", "short_words", "distinct_words", "top_word", "repeat_next", "repeat_second",
    "upper_words", "wordless", "marked_ends", "distinct_lines", "mean_line", "entropy", "distinct_trigrams", "inner_marks",
)


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, features) of a run of whole texts."""
    n = len(offsets) - 1
    sizes = np.diff(offsets).astype(float)
    out = np.zeros((n, len(NAMES)))
    if not len(data):
        return out
    per = np.maximum(sizes, 1)

    def by_text(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    column = iter(range(len(NAMES)))
    for members in _CLASSES.values():
        out[:, next(column)] = by_text(members[data]) / per
    starts, ends, owner = words_of(data, offsets)
    count = np.bincount(owner, minlength=n).astype(float)
    words = np.maximum(count, 1)
    width = (ends - starts).astype(float)
    hashes = word_hashes(data, starts, ends)

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, values, minlength=n) / words

    out[:, next(column)] = np.log1p(sizes)
    out[:, next(column)] = np.log1p(count)
    average = mean(width)
    out[:, next(column)] = average
    out[:, next(column)] = np.sqrt(np.maximum(mean(width**2) - average**2, 0))
    out[:, next(column)] = mean(width > 14)
    out[:, next(column)] = mean(width <= 3)
    first = np.searchsorted(owner, np.arange(n + 1))
    distinct, top, trigrams = np.zeros(n), np.zeros(n), np.zeros(n)
    triples = hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7) if len(hashes) > 2 else hashes[:0]
    for t in range(n):
        a, b = first[t], first[t + 1]
        if b > a:
            x = np.sort(hashes[a:b])
            edge = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True])))
            distinct[t], top[t] = len(edge) - 1, np.diff(edge).max()
            trigrams[t] = 1.0
            if b - a > 2:
                x = np.sort(triples[a : b - 2])
                trigrams[t] = (1 + np.count_nonzero(x[1:] != x[:-1])) / len(x)
    out[:, next(column)] = distinct / words
    out[:, next(column)] = top / words
    for step in (1, 2):
        same = np.zeros(len(hashes), bool)
        if len(hashes) > step:
            same[step:] = (hashes[step:] == hashes[:-step]) & (owner[step:] == owner[:-step])
        out[:, next(column)] = mean(same)
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum((_LOWER | _HIGH)[data], out=letters[1:])
    capitals = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_UPPER[data], out=capitals[1:])
    low, up = letters[ends] - letters[starts], capitals[ends] - capitals[starts]
    out[:, next(column)] = mean((up > 1) & (up >= low))
    out[:, next(column)] = mean(low + up == 0)
    plain = (_UPPER | _LOWER | _HIGH | _DIGIT)[data]
    out[:, next(column)] = mean(~plain[ends - 1]) if len(ends) else 0
    # lines: a break ends a line, and so does a text
    cut = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate((offsets[:-1][sizes > 0], (cut + 1)[~np.isin(cut + 1, offsets)])))
    line_ends = np.append(line_starts[1:], len(data))
    line_owner = np.searchsorted(offsets, line_starts, side="right") - 1
    lines = np.bincount(line_owner, minlength=n).astype(float)
    order = np.lexsort((h := word_hashes(data, line_starts, line_ends), line_owner))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (line_owner[order][1:] != line_owner[order][:-1])
    out[:, next(column)] = np.bincount(line_owner[order][new], minlength=n) / np.maximum(lines, 1)
    out[:, next(column)] = np.log1p(sizes / np.maximum(lines, 1))
    entropy = np.zeros(n)
    for t in range(n):
        if sizes[t]:
            p = np.bincount(data[offsets[t] : offsets[t + 1]], minlength=256) / sizes[t]
            p = p[p > 0]
            entropy[t] = -(p * np.log2(p)).sum()
    out[:, next(column)] = entropy
    out[:, next(column)] = trigrams
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~plain, out=marks[1:])
    out[:, next(column)] = mean((marks[ends] - marks[starts]) >= 3)
    return out


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``x``, the array of feature values, of every row."""
    ship(docs.sparkSession)
    docs = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1]] + ["x array<double>"])

    def run(batches):
        for batch in batches:
            for row, data, offsets in text_parts(batch.column(len(keep)), PART_BYTES):
                n = len(offsets) - 1
                x = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(NAMES)), pa.array(text_features(data, offsets).ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(row, n) for k in range(len(keep))], x], names=[*keep, "x"])

    return docs.mapInArrow(run, ddl)


class AdditiveModel:
    """Bin edges, a table per feature and a table per pair of features (on coarser bins)."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        share = (y.sum() + 1) / (len(y) + 2)
        self.intercept = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(NAMES))]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        if len(np.unique(y)) == 2:
            self._fit(self.bins(x), y.astype(float))

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def logit(self, bins: np.ndarray) -> np.ndarray:
        z = np.full(len(bins), self.intercept)
        for j, t in enumerate(self.tables):
            z += t[bins[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[bins[:, i], bins[:, j]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(self.bins(x))))

    def _fit(self, bins: np.ndarray, y: np.ndarray) -> None:
        z = self.logit(bins)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-z))
            return y - p, np.maximum(p * (1 - p), 1e-6)

        for _ in range(CYCLES):
            for j, t in enumerate(self.tables):
                if len(t) > 1:
                    g, h = slopes()
                    step = RATE * _tree(np.bincount(bins[:, j], g, len(t)), np.bincount(bins[:, j], h, len(t)))
                    t += step
                    z += step[bins[:, j]]
        g, h = slopes()
        gains = []
        for i in range(len(self.tables)):
            for j in range(i):
                if len(self.tables[i]) > 1 and len(self.tables[j]) > 1:
                    gains.append((_cut(*self._grids(bins, i, j, g, h))[0], i, j))
        self.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
        self.pair_tables = [np.zeros((len(self.tables[i]), len(self.tables[j]))) for i, j in self.pairs]
        for _ in range(PAIR_CYCLES):
            for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
                g, h = slopes()
                _, step = _cut(*self._grids(bins, i, j, g, h))
                t += RATE * step
                z += RATE * step[bins[:, i], bins[:, j]]

    def _grids(self, bins, i, j, g, h):
        a, b = len(self.tables[i]), len(self.tables[j])
        at = bins[:, i] * b + bins[:, j]
        return np.bincount(at, g, a * b).reshape(a, b), np.bincount(at, h, a * b).reshape(a, b)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4, ridge: float = 5.0) -> np.ndarray:
    """Leaf values, bin by bin, of a tree grown best split first over ordered bins."""
    parts = [(0, len(g))]
    G, H = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))

    def worth(a, b):
        return (G[b] - G[a]) ** 2 / (H[b] - H[a] + ridge)

    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a > 1:
                k = np.arange(a + 1, b)
                gain = worth(a, k) + worth(k, b) - worth(a, b)
                m = int(np.argmax(gain))
                if gain[m] > best[0]:
                    best = (gain[m], (a, b), int(k[m]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + ridge)
    return out


def _cut(g: np.ndarray, h: np.ndarray, ridge: float = 5.0) -> tuple[float, np.ndarray]:
    """The best cut of a pair's grid into four quadrants: its gain, and the values it adds."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = G[:-1, :-1], H[:-1, :-1]
    top, left = G[:-1, -1:], G[-1:, :-1]
    top_h, left_h = H[:-1, -1:], H[-1:, :-1]
    quarters = [(a, b), (top - a, top_h - b), (left - a, left_h - b), (G[-1, -1] - top - left + a, H[-1, -1] - top_h - left_h + b)]
    gain = sum(x**2 / (y + ridge) for x, y in quarters)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = [x[i, j] / (y[i, j] + ridge) for x, y in quarters]
    step = np.empty(g.shape)
    step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = values
    return float(gain[i, j] - G[-1, -1] ** 2 / (H[-1, -1] + ridge)), step


def _chosen(labels: DataFrame, sample: int) -> DataFrame:
    usable = labels.where(training_rows(F.col("doc_id"), 3) != 1).where("quality IS NOT NULL")
    usable = usable.select(F.col("doc_id").alias("labelled"), F.col("quality").cast("double").alias("y"))
    return usable.orderBy(F.xxhash64("labelled"), "labelled", "y").limit(sample)


def training_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that a fit uses: at most ``sample`` labelled ids, which are broadcast."""
    name = fresh(docs, "labelled")
    ids = F.broadcast(_chosen(labels, sample).select(F.col("labelled").alias(name)).distinct())
    return docs.join(ids, F.col("doc_id") == F.col(name), "left_semi")


def fit(found: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel:
    """Fits on at most ``sample`` labelled rows outside the held-out third, least hash first."""
    chosen = _chosen(labels, sample)
    own = found.select("doc_id", "x").join(F.broadcast(chosen.select("labelled").distinct()), F.col("doc_id") == F.col("labelled"), "left_semi")
    rows = chosen.join(own, F.col("labelled") == F.col("doc_id")).select("labelled", "y", "x").toPandas()
    rows["order"] = [tuple(v) for v in rows.x]
    rows = rows.sort_values(["labelled", "y", "order"])
    x = np.array(rows.x.tolist(), float).reshape(len(rows), len(NAMES))
    return AdditiveModel(x, (rows.y.to_numpy() >= 0.5).astype(int))


def scored(found: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id and score of every row of a feature table."""
    shared = found.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(x))], names=["doc_id", "score"])

    return found.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least 0.5; no shuffle."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = [shared.value.score(text_features(data, offsets)) >= 0.5 for _, data, offsets in text_parts(batch.column(at), PART_BYTES)]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = saved(features(docs), "features")
    model = fit(found, table(spark, sf_dir, "labels"))
    return scored(found, model).select(
        "doc_id", (training_rows(F.col("doc_id"), 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
