"""MinHash near-dedup with tensored banding.

Two collections of ``side`` half keys of ``HALF`` minhashes each are computed per text; table
(i, j) is keyed by half key i of the first and half key j of the second collection. So
side * side tables of 2 * HALF minhashes cost 2 * side * HALF minhashes instead of
2 * HALF * side * side. ``sides`` chooses side by the bound on similarity. Documents that share a
key are candidates; every link is confirmed on the full shingle sets.

Candidates of one key are not paired with one another. A first pass compares the members of a key
with its least document, a second with its most typical member (of a group of edited copies, the
one nearest to their origin). What still shares keys across components then goes through an exact
prefix filter with positions, which finds every remaining link among these documents and meets
only pairs that could be linked; so no candidate is dropped. Rows of a shingle that many of these
prefixes hold are dealt to many tasks, by bands of set sizes and by parts.

Defined results: texts without words (null, empty, white space) have no shingles and link with
nothing. Documents with equal sets are one class and are compared once. Rows that repeat a doc_id
are one node: their links are those of the id. Rows without doc_id are kept and link with nothing.
Very long texts give whole sets. A component is named by its smallest doc_id, so ties don't arise.
An empty table gives no rows; extra columns take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import copied, dealt, fresh, hot_copies, lowered, mixed, saved, table, text_parts, word_hashes, words_of
from .components import roots

HALF = 3
#: Bytes of text whose words are hashed at once; a longer text is hashed whole.
PART_BYTES = 1 << 19
#: Rows of a batch that are copied at once.
SLICE = 512
#: Share of pairs just at the bound that may have no key in common.
MISSED = 0.001


def found_share(side: int, percent: int) -> float:
    """Probability that two texts of similarity ``percent`` share a key."""
    return (1 - (1 - (percent / 100) ** HALF) ** side) ** 2


def sides(percent: int) -> int:
    """The least number of half keys a side that misses at most ``MISSED`` at the bound."""
    side = 1
    while found_share(side, percent) < 1 - MISSED:
        side += 1
    return side


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int):
    """Distinct hashed word shingles of every text of a run: (hashes, offsets of each text)."""
    data = lowered(data)
    starts, ends, owner = words_of(data, offsets)
    hashes = word_hashes(data, starts, ends)
    n = len(offsets) - 1
    first = np.searchsorted(owner, np.arange(n + 1))
    sets, sizes = [], np.zeros(n + 1, np.int64)
    rolled = hashes[: max(0, len(hashes) - words + 1)].copy()
    for k in range(1, words):
        rolled = mixed(rolled + np.uint64(k)) + hashes[k : k + len(rolled)]
    rolled = mixed(rolled)
    for t in range(n):
        a, b = first[t], first[t + 1]
        if b - a >= words:
            x = np.sort(rolled[a : b - words + 1])
            x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif b > a:
            whole = hashes[a : a + 1]
            for k in range(1, b - a):
                whole = mixed(whole + np.uint64(k)) + hashes[a + k : a + k + 1]
            x = mixed(whole + np.uint64(977 * (words - (b - a))))
        else:
            continue
        sets.append(x)
        sizes[t + 1] = len(x)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.cumsum(sizes)


def slices(batches):
    """Batches in parts of few rows: a part is copied while its texts are hashed."""
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            yield batch.slice(a, SLICE)


def _signatures(words: int, side: int):
    seeds = mixed(np.arange(1, 2 * side * HALF + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    factors = seeds | np.uint64(1)

    def run(batches):
        for batch in slices(batches):
            ids = batch.column("doc_id")
            for row, data, offsets in text_parts(batch.column("text"), PART_BYTES):
                values, ends = shingle_sets(data, offsets, words)
                sizes = np.diff(ends)
                full = sizes > 0
                n = len(sizes)
                sums = np.zeros((2, n), np.uint64)
                least = np.zeros((n, 2 * side * HALF), np.uint64)
                if len(values):
                    at = ends[:-1][full]
                    sums[0, full] = np.add.reduceat(values, at)
                    sums[1, full] = np.add.reduceat(mixed(values ^ np.uint64(0xA0761D6478BD642F)), at)
                    for k in range(2 * side * HALF):
                        least[full, k] = np.minimum.reduceat((values ^ seeds[k]) * factors[k], at)
                halves = np.zeros((n, 2 * side), np.uint64)
                for k in range(HALF):
                    halves = mixed(halves + least[:, k::HALF] + np.uint64(k))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (2 * side)), pa.array(halves.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, n), pa.array(sizes), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists],
                    names=["doc_id", "n_shingles", "s1", "s2", "halves"],
                )

    return run


def _sets(words: int):
    def run(batches):
        for batch in slices(batches):
            ids = batch.column("doc_id")
            for row, data, offsets in text_parts(batch.column("text"), PART_BYTES):
                values, ends = shingle_sets(data, offsets, words)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(row, len(offsets) - 1), lists], names=["node", "members"])

    return run


def _cross(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, node, comp) of the keys whose members lie in more than one component."""
    named = shared.join(labels, shared.node == labels.n, "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    mixed_keys = named.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("key")
    return named.join(mixed_keys, "key")


def _components(links: DataFrame) -> DataFrame:
    return saved(roots(links).select(F.col("node").alias("n"), "root"), "labels")


def _tokens(cross: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, sid, n, s, df): the shingles of the nodes of ``cross``, and in how many of these
    sets each occurs. sid tells the sets of a doc_id with several texts apart."""
    members = sets.join(cross.select("node").distinct(), "node", "left_semi").select("node", F.xxhash64("members").alias("sid"), F.size("members").alias("n"), F.explode("members").alias("s"))
    counts = members.groupBy("s").agg(F.count("*").alias("df"))
    return members.join(counts, "s")


def _star_pairs(cross: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each key's members with its centre, the member whose shingles are the most common ones: of
    a group of edited copies the one nearest to their origin."""
    central = tokens.groupBy("node").agg(F.avg("df").alias("common"))
    named = cross.join(central, "node")
    centre = named.groupBy("key").agg(F.max(F.struct("common", -F.col("node"), "node", "comp")).alias("c")).select("key", F.col("c.node").alias("node2"), F.col("c.comp").alias("comp2"))
    return named.join(centre, "key").where("comp <> comp2").select(F.greatest("node", "node2").alias("x"), F.least("node", "node2").alias("y")).distinct()


def _cells(prefix: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join of ``prefix`` with itself by shingle: any two rows of a shingle whose
    sizes allow a link meet in one cell (band, i, j).

    A shingle has one cell, but for those with over a thousandth of the rows, at most a thousand.
    Their rows are told apart by bands of n, so wide that linked sets lie in the same band or in
    neighbours, and dealt to ``share`` parts: part i of one side meets part j of the other. A share
    is the root of the number of thousandths: it copies no row more often than 32 times a band."""
    hot = hot_copies(prefix, "s").select("s", F.ceil(F.sqrt("copies")).cast("int").alias("share"))
    rows = prefix.join(F.broadcast(hot), "s", "left")
    cold, share = F.col("share").isNull(), F.coalesce("share", F.lit(1))
    band = F.floor(F.log(F.col("n")) / (math.log(100 / percent) + 1e-6)).cast("int")
    part, every = F.pmod(F.xxhash64("node", "n"), share).cast("int"), F.sequence(F.lit(0), share - 1)
    one = rows.select("s", "node", "comp", "n", "place", F.when(cold, 0).otherwise(band).alias("band"), part.alias("i"), F.explode(every).alias("j"))
    near = F.when(cold, F.array(F.lit(0))).otherwise(F.array(band - 1, band, band + 1))
    twin = rows.select("s", *[F.col(c).alias(c + "2") for c in ("node", "comp", "n", "place")], part.alias("j"), every.alias("every"), F.explode(near).alias("band"))
    return one, twin.withColumn("i", F.explode("every")).drop("every")


def _prefix_pairs(cross: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """All pairs between components of ``cross`` that can be linked, by a prefix filter.

    With the shingles of all sets in one order, rarest first, linked sets share one within their
    first n - ceil(n * percent / 100) + 1 shingles; and after the first that they share, enough
    must be left in both (positions). Edits come first in that order, so members of a group that
    differ too much from one another never meet."""
    nodes = cross.select("node", "comp").distinct()
    place = F.row_number().over(Window.partitionBy("node", "sid").orderBy("df", "s"))
    ordered = tokens.join(nodes, "node").select("node", "comp", "n", "s", "df", place.alias("place"))
    prefix = saved(ordered.where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & (F.col("df") > 1)).drop("df"), "prefix")
    left = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) + 1
    enough = left * (100 + percent) >= (F.col("n") + F.col("n2")) * percent
    one, two = _cells(prefix, percent)
    pairs = one.join(two, ["s", "band", "i", "j"]).where((F.col("comp") < F.col("comp2")) & enough)
    return pairs.select(F.greatest("node", "node2").alias("x"), F.least("node", "node2").alias("y")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets overlap enough; sizes are compared before sets are moved."""
    n = sets.select("node", F.size("members").alias("n"), "members")
    size = n.select("node", "n")
    near = (
        pairs.join(size.select(F.col("node").alias("u"), F.col("n").alias("nu")), "u")
        .join(size.select(F.col("node").alias("v"), F.col("n").alias("nv")), "v")
        .where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent)
        .select("u", "v").distinct()
    )
    near = saved(near, "near")
    # a centre has a pair with every member of its group: its set is copied, its pairs are spread
    hot_u, hot_v = hot_copies(near, "u"), hot_copies(near, "v")
    near = dealt(dealt(near, "u", hot_u, "su"), "v", hot_v, "sv")
    left = copied(n.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("members").alias("mu")), "u", hot_u, "su")
    right = copied(n.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("members").alias("mv")), "v", hot_v, "sv")
    common = F.size(F.array_intersect("mu", "mv"))
    return (
        near.join(left, ["u", "su"]).join(right, ["v", "sv"])
        .where(common * 100 >= (F.col("nu") + F.col("nv") - common) * percent)
        .select("u", "v").distinct()
    )


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    ship(docs.sparkSession)
    side = sides(percent)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = saved(docs.mapInArrow(_signatures(words, side), "doc_id long, n_shingles long, s1 long, s2 long, halves array<long>"), "signed")
    group = ["n_shingles", "s1", "s2"]
    named = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = saved(named.groupBy(group).agg(F.min("doc_id").alias("node"), F.any_value("halves").alias("halves")), "classes")

    left, right = F.slice("halves", 1, side), F.slice("halves", side + 1, side)
    keys = (
        classes.select("node", right.alias("right"), F.posexplode(left).alias("i", "a"))
        .select("node", "i", "a", F.posexplode("right").alias("j", "b"))
        .select(F.xxhash64("i", "j", "a", "b").alias("key"), "node")
    )
    several = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key", "lo")
    shared = saved(keys.join(several, "key"), "shared")
    nodes = shared.select("node").distinct()
    sets = saved(docs.join(nodes, docs.doc_id == nodes.node, "left_semi").mapInArrow(_sets(words), "node long, members array<long>").where("size(members) > 0").distinct(), "sets")

    links = saved(_confirmed(shared.where("node <> lo").select(F.col("node").alias("u"), F.col("lo").alias("v")).distinct(), sets, percent), "links")
    # a doc_id with several texts joins the classes of those texts
    several_rows = named.groupBy("doc_id").count().where("count > 1")
    repeats = named.join(several_rows, "doc_id", "left_semi").join(classes.select(*group, "node"), group).select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    links = saved(links.unionByName(repeats.distinct()), "links")
    tested = shared.where("node <> lo").select(F.greatest("node", "lo").alias("x"), F.least("node", "lo").alias("y")).distinct()

    labels, cross = _components(links), None
    for complete in (False, True):
        cross = saved(_cross(shared.select("key", "node"), labels), "cross")
        if not cross.limit(1).count():
            break
        if not complete:
            tokens = saved(_tokens(cross, sets), "tokens")
        pairs = _prefix_pairs(cross, tokens, percent) if complete else _star_pairs(cross, tokens)
        pairs = saved(pairs.join(tested, ["x", "y"], "left_anti"), "pairs")
        more = saved(_confirmed(pairs.select(F.col("x").alias("u"), F.col("y").alias("v")), sets, percent), "more")
        tested = tested.unionByName(pairs)
        if more.limit(1).count():
            links = labels.where("n <> root").select(F.col("n").alias("u"), F.col("root").alias("v")).unionByName(more)
            labels = _components(links)

    named_classes = classes.join(labels, classes.node == labels.n, "left").select(*group, F.coalesce("root", "node").alias("component_id"))
    own = named.select("doc_id", *group).join(named_classes, group).select("doc_id", "n_shingles", "component_id")
    rest = signed.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return own.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, except those of a component's larger ids."""
    name = fresh(docs, "gone")
    gone = near_duplicates(docs, words, percent).where("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs.doc_id.cast("bigint") == F.col(name), "left_anti")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x AS u, y AS v FROM l UNION SELECT y, x FROM l),
r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
m AS (SELECT u, least(u, min(v)) AS c FROM r GROUP BY u)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id, w.doc_id = coalesce(m.c, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.u = w.doc_id
"""
