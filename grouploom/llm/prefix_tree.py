"""Tree of conversation prefixes by collapse of whole sequences.

Identical conversations are one weighted sequence: its weight is their number, its ends are their ids.
A sequence is a leaf of the tree unless it is a proper prefix of another one (anti-join with the
prefixes that are continued). Nodes are aggregates of weighted prefixes of the distinct sequences.

Prefixes are known by keys, not by gathered turns: a turn at depth d contributes two 60-bit hashes of
(d, turn), and the key of a prefix is the MD5 of its depth and of both sums. Two of 10^12 different
prefixes share a key with a probability below 1e-11. The sums run in the order of turns within ranges of
rows; what earlier ranges of the same conversation add up to is joined on. So no task needs a whole
conversation, and texts are shuffled once, to be put in order.

Savings of subtrees need no walk over the tree. Every node belongs to the least sequence through it; what
a sequence owns is the end of its path, from the first depth that is its own. With S(r, d) the bytes of
sequence r from depth d on, w its weight and A(r) the bytes that it owns,

    saved(v) = sum over r through v of w(r) * S(r, d) - [sum of A(r) - A(owner) + S(owner, d)].

Joins whose one side has a row per turn have a unique key on the other, and that side is a table of its
own, so that Spark can split a partition in which one conversation or one common prefix weighs heavily. An end list is hashed from runs
of at most ``RUN`` ids; a list of several runs meets in one task run by run, since SHA-256 goes from the
first byte to the last, and the task holds one run.

Defined results: turns are ordered by turn, null first, then by role and by text; null role or text counts
as empty. Equal rows are turns of their own. Rows without conv_id belong to no conversation and are left
out. Empty and very long texts are turns like others (hashed whole). An empty table has no nodes, the root
included; extra columns take no part.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import saved, table

#: Ids of an end list that are joined at once.
RUN = 1 << 15
#: Conversations c - c % SHARE lend their first turns; their number is crc32(c) % TURNS.
SHARE, TURNS = 5, 9
_ROW_BITS = 33


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv, seq, role, text, digest, bytes: ``seq`` rises with the order of a conversation's turns.

    Rows are dealt by ranges of the order and sorted there; seq holds the range (above 33 bits) and
    the place in it, so a conversation's turns in one range have consecutive numbers."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), text("role"), text("text")).where("conv IS NOT NULL")
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return saved(placed.select("conv", "seq", "role", "text", F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"), F.octet_length("text").cast("bigint").alias("bytes")), "turns")


def _range_of(seq: Column) -> Column:
    return F.shiftright(seq, _ROW_BITS).cast("int")


def _earlier(parts: DataFrame, *columns: str) -> DataFrame:
    """``parts`` (a row per conversation and range) with sums over the ranges before."""
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0).cast(parts.schema[c].dataType)).alias(f"earlier_{c}") for c in columns])


class Rebuilt(NamedTuple):
    conversations: DataFrame  # conv
    turns: DataFrame  # conv, range, depth, seq, digest, bytes


def as_they_are(turns: DataFrame) -> Rebuilt:
    """Every conversation with its own turns."""
    return rebuilt(turns, F.lit(0))


def rebuilt(turns: DataFrame, borrowed: Column, share: int = SHARE) -> Rebuilt:
    """Conversations that begin with the first ``borrowed`` (an expression over conv) turns of
    conversation conv - conv % share, fewer if it has fewer, and go on with their own turns after as
    many. ``turns`` is from ``ordered_turns``."""
    placed = turns.select("conv", "seq", "digest", "bytes", _range_of(F.col("seq")).alias("range"))
    parts = saved(_earlier(placed.groupBy("conv", "range").agg(F.min("seq").alias("first"), F.count("*").alias("n")), "n"), "parts")
    place = (F.col("seq") - F.col("first") + F.col("earlier_n") + 1).alias("place")
    every = saved(parts.select("conv").distinct().withColumn("h", borrowed.cast("bigint")).withColumn("lender", F.col("conv") - F.col("conv") % share), "conversations")
    most = every.agg(F.max("h")).first()[0] or 0
    # the first turns of lenders, at most as many as any conversation borrows
    lenders = parts.join(every.select(F.col("lender").alias("conv")).distinct(), "conv", "left_semi").where(F.col("earlier_n") < most)
    lent = placed.join(lenders, ["conv", "range"]).select(F.col("conv").alias("lender"), place, "seq", "digest", "bytes").where(F.col("place") <= most)
    taken = every.join(lent, "lender").where("place <= h").select("conv", F.lit(-1).alias("range"), F.col("place").alias("depth"), "seq", "digest", "bytes")
    taken = saved(taken, "taken")
    shift = every.join(taken.groupBy("conv").agg(F.count("*").alias("m")), "conv", "left").select("conv", "h", F.coalesce("m", F.lit(0)).alias("m"))
    own = placed.join(parts.join(shift, "conv"), ["conv", "range"]).select("conv", "range", place, "h", "m", "seq", "digest", "bytes").where("place > h")
    own = own.select("conv", "range", (F.col("place") - F.col("h") + F.col("m")).alias("depth"), "seq", "digest", "bytes")
    return Rebuilt(every.select("conv"), saved(taken.unionByName(own), "rebuilt"))


def _hashes(depth: Column, digest: Column) -> list[Column]:
    text = F.md5(F.concat(depth.cast("string"), F.lit(":"), F.hex(digest)).cast("binary"))
    return [F.conv(F.substring(text, 1 + 16 * k, 15), 16, 10).cast("decimal(20,0)").alias(f"h{k}") for k in (0, 1)]


def _key(depth: Column, *sums: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth.cast("string"), *[s.cast("string") for s in sums]).cast("binary")))


def _root() -> Column:
    return _key(F.lit(0), F.lit(0), F.lit(0))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv, depth, key, parent (key), bytes, through (bytes of all turns up to this one)."""
    rows = turns.select("conv", "range", "depth", "bytes", *_hashes(F.col("depth"), F.col("digest")))
    sums = ("h0", "h1", "bytes")
    wide = lambda c: F.col(c).cast("decimal(38,0)" if c[0] == "h" else "bigint")
    rows = rows.select("conv", "range", "depth", *[wide(c).alias(c) for c in sums])
    earlier = _earlier(rows.groupBy("conv", "range").agg(*[F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in sums]), *sums).drop(*sums)
    within = Window.partitionBy("conv", "range").orderBy("depth")
    run = rows.join(earlier, ["conv", "range"]).select("conv", "depth", "bytes", "h0", "h1", *[(F.sum(c).over(within) + F.col(f"earlier_{c}")).cast(rows.schema[c].dataType).alias(f"to_{c}") for c in sums])
    before = [(F.col(f"to_{c}") - F.col(c)).cast("decimal(38,0)") for c in ("h0", "h1")]
    return saved(run.select("conv", "depth", _key(F.col("depth"), F.col("to_h0"), F.col("to_h1")).alias("key"), _key(F.col("depth") - 1, *before).alias("parent"), "bytes", F.col("to_bytes").alias("through")), "prefixes")


def end_digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 of the decimal ids (column conv) of each key, ascending, joined by commas."""
    numbered = ends.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").withColumn("n", F.monotonically_increasing_id())
    runs = numbered.groupBy("key", F.floor(F.col("n") / RUN).alias("run")).agg(F.min("conv").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if state:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], names=["key", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    ordered = runs.repartition("key").sortWithinPartitions("key", "first")
    return ordered.select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


class Tree(NamedTuple):
    nodes: DataFrame  # key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    ends: DataFrame  # key, conv: the node that each conversation ends at
    leaves: DataFrame  # key, first (its least conversation), weight


def tree(all_of: Rebuilt) -> Tree:
    """Nodes, ends and leaves of the conversations' prefix tree."""
    ship(all_of.turns.sparkSession)
    steps = prefixes(all_of.turns)
    last = F.max(F.struct("depth", "key", "through"))
    finals = all_of.conversations.join(steps.groupBy("conv").agg(last.alias("last")), "conv", "left")
    finals = saved(finals.select("conv", F.coalesce("last.key", _root()).alias("key"), F.coalesce("last.through", F.lit(0)).alias("total")), "ends")
    # identical conversations collapse into one weighted sequence, named by its least member
    sequences = saved(finals.groupBy("key").agg(F.min("conv").alias("first"), F.count("*").alias("weight"), F.first("total").alias("total")), "sequences")
    paths = steps.join(sequences.select(F.col("first").alias("conv")), "conv", "left_semi").withColumnRenamed("conv", "first")
    roots = sequences.select("first", F.lit(0).cast(paths.schema["depth"].dataType).alias("depth"), _root().alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("bytes"), F.lit(0).cast("bigint").alias("through"))
    paths = saved(paths.unionByName(roots), "paths")
    continued = paths.where("depth > 0").select(F.col("parent").alias("key")).distinct()
    leaves = saved(sequences.join(continued, "key", "left_anti").select("key", "first", "weight"), "leaves")
    # a node belongs to the least sequence through it
    owners = saved(paths.groupBy("key").agg(F.min("first").alias("owner")), "owners")
    owned = paths.join(owners, "key").select("first", "depth", "owner", (F.col("through") - F.col("bytes")).alias("before"))
    mine = F.col("owner") == F.col("first")
    ends_of = owned.groupBy("first").agg(
        F.min(F.when(mine, F.col("depth"))).alias("from"), F.min(F.when(mine, F.col("before"))).alias("before"),
        F.max(F.when(~mine, F.struct("depth", "owner")))["owner"].alias("above"),
    )
    facts = sequences.join(ends_of, "first").join(leaves.select("first", F.lit(1).alias("leaf")), "first", "left")
    facts = facts.select("first", "weight", "total", F.coalesce("leaf", F.lit(0)).alias("leaf"), "from", "above", F.coalesce(F.col("total") - F.col("before"), F.lit(0)).alias("owns"))
    facts = saved(facts, "facts")
    rest = (F.col("total") - F.col("through") + F.col("bytes")).alias("rest")
    through = paths.join(facts, "first").select("key", "parent", "depth", "first", "weight", "leaf", "from", "above", "owns", rest)
    nodes = through.groupBy("key").agg(
        F.min(F.struct("first", "depth", "parent", "from", "above", "owns", "rest")).alias("o"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.col("weight") * F.col("rest")).alias("all_bytes"), F.sum("owns").alias("owns"),
    )
    nodes = saved(nodes, "nodes")
    children = nodes.where("o.depth > 0").groupBy(F.col("o.parent").alias("key")).agg(F.count("*").alias("n_children"))
    above = F.when(F.col("o.depth") > 0, F.when(F.col("o.depth") == F.col("o.from"), F.col("o.above")).otherwise(F.col("o.first")))
    out = nodes.join(children, "key", "left").select(
        "key", F.col("o.first").alias("conv_id"), F.col("o.depth").cast("bigint").alias("depth"), above.alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), F.col("n_leaves").cast("bigint").alias("n_leaves"),
        (F.col("all_bytes") - (F.col("owns") - F.col("o.owns") + F.col("o.rest"))).cast("bigint").alias("saved_tokens"),
    )
    return Tree(out, finals.select("key", "conv"), leaves)


def node_texts(nodes: DataFrame, all_of: Rebuilt, turns: DataFrame) -> DataFrame:
    """``nodes`` below the root with the role and text of their last turn."""
    at = all_of.turns.select(F.col("conv").alias("conv_id"), "depth", "seq")
    return nodes.join(at, ["conv_id", "depth"]).join(turns.select("seq", "role", "text"), "seq").drop("seq")


def with_ends(found: Tree) -> DataFrame:
    """Nodes with the digest of the ids of the conversations that end there."""
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    out = found.nodes.join(end_digests(found.ends), "key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = ordered_turns(table(spark, sf_dir, "conversations"))
    borrowed = F.crc32(F.col("conv").cast("string").cast("binary")) % TURNS
    return with_ends(tree(rebuilt(turns, borrowed)))


_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
OP11_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, t.place AS p, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.place <= c.h
      UNION ALL SELECT c.conv_id, t.place + 10, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.place > c.h),
s AS (SELECT conv_id, list((role, text) ORDER BY p) AS s FROM b GROUP BY conv_id),
q AS (SELECT c.conv_id, CASE WHEN s.s IS NULL THEN [] ELSE list_transform(s.s, lambda x: md5(concat(strlen(x[1]), ':', x[1], x[2])) || ':' || strlen(x[2])) END AS s FROM c LEFT JOIN s USING (conv_id)),
n AS (SELECT d AS depth, s[:d] AS k, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (len(s) = d) AS ends FROM q, range(0, len(s) + 1) r(d) GROUP BY ALL),
m AS (SELECT depth, k, conv_id, n_convs, ends, k[:depth - 1] AS up, (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE CAST(string_split(k[depth], ':')[2] AS BIGINT) END AS saved FROM n),
ch AS (SELECT up AS k, depth - 1 AS depth, count(*) AS n FROM m WHERE depth > 0 GROUP BY ALL),
l AS (SELECT m.depth, m.k, count(*) FILTER (ch.n IS NULL) AS leaf, any_value(m.saved) AS saved FROM m LEFT JOIN ch USING (depth, k) GROUP BY ALL),
a AS (SELECT d AS depth, l.k[:d] AS k, sum(leaf) AS n_leaves, sum(saved) AS saved FROM l, range(0, l.depth + 1) r(d) GROUP BY ALL)
SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, coalesce(ch.n, 0) AS n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN a USING (depth, k) LEFT JOIN ch USING (depth, k) LEFT JOIN m p ON p.depth = m.depth - 1 AND p.k = m.up AND m.depth > 0
"""
