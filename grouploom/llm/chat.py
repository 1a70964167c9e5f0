"""Chat formatting by quotation linking.

Messages are split into passages: paragraphs of lines with one quote level (leading ``>`` marks,
nested ``> >``), without lines that introduce a quote. Passages and their lines are normalised
(white space folded, letters lower-cased) and hashed. A quoted passage is joined to the first
earlier message of its conversation that holds it as a paragraph of its own text; where there is
none, each of its lines is joined to the first earlier message with that line. So every quote
level of a message gets the original message of that depth: of several, the one with the most
quoted words, then the later.

A message answers the original of its least linked level (level 1, or a deeper one where level 1
has no owner); ``quoted`` has those of all levels. Replies join the thread of the message they
answer.

Each message comes back without quotes, with its thread and its place in it: ``ORDER BY conv_id,
thread, place`` reads a conversation in reply order, every reply below what it answers and before
the next answer to that. ``written`` stores conversations in that order.

Messages of a conversation or thread are never gathered. Threads come from joins that double the
reach of reply links each round; places come from the tour around each thread's reply tree (down
to a message, later up from it), whose steps are numbered by doubling as well. Links that have
arrived take no part in later rounds, so a thread's first message doesn't become a hot key.

Defined results: a null text counts as empty; a message that only quotes has an empty text. Null
conv_id or turn: the message is a thread of its own, with place 0. Rows that repeat (conv_id, turn)
are one message for linking and stay rows. Without a link a message starts a thread. Very long
texts are parsed in one pass, in time in proportion to their length. An empty table gives no rows;
extra columns take no part.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from ..session import ship
from .common import saved, table

_MARKS = re.compile(r"(?:[ \t]{0,3}>)+ ?")
#: "On ... wrote:" lines and the like that introduce a quote go with it.
_INTRODUCES = re.compile(r".{0,200}(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*$", re.IGNORECASE)


def parse(text: str) -> tuple[str, list[tuple[int, str, int, list[tuple[str, int]]]]]:
    """The text without quotes, and its passages: quote level, normalised text, words, and the
    same of its lines."""
    lines = []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        marks = _MARKS.match(line)
        lines.append((marks[0].count(">"), line[marks.end() :]) if marks else (0, line))
    own, passages, at = [], [], 0
    for k, (level, line) in enumerate(lines):
        if level == 0:
            # an introducing line stands before a quote, or before one blank line and a quote
            after = next((lv for lv, s in lines[k + 1 : k + 3] if lv or s.strip()), 0)
            if after and _INTRODUCES.match(line):
                lines[k] = (0, "")
            else:
                own.append(line)
    while at < len(lines):
        level, run = lines[at][0], []
        while at < len(lines) and lines[at][0] == level and lines[at][1].strip():
            run.append(lines[at][1])
            at += 1
        each = [line.lower().split() for line in run]
        words = list(chain.from_iterable(each))
        if words:
            passages.append((level, " ".join(words), len(words), [(" ".join(w), len(w)) for w in each]))
        if not run:
            at += 1
    return "\n".join(own).strip("\n"), passages


def _parsed(batches):
    for batch in batches:
        out = [parse(t or "") for t in batch.column("text").to_pylist()]
        digest = lambda p: hashlib.sha256(p.encode()).digest()[:16]
        passages = [[{"level": lv, "hash": digest(p), "words": n, "lines": [{"hash": digest(x), "words": m} for x, m in ls]} for lv, p, n, ls in ps] for _, ps in out]
        line = pa.struct([("hash", pa.binary()), ("words", pa.int32())])
        kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.binary()), ("words", pa.int32()), ("lines", pa.list_(line))]))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array([t for t, _ in out], pa.string()), pa.array(passages, kind)], names=["conv_id", "turn", "role", "text", "passages"])


_PASSAGES = "array<struct<level:int,hash:binary,words:int,lines:array<struct<hash:binary,words:int>>>>"


def quoted_originals(passages: DataFrame) -> DataFrame:
    """conv_id, turn, level, source: the original message of every quote level that has one."""
    # the first to write a passage or a line owns it, so that a passage of many messages is one row
    own = passages.where("level = 0")
    owners = own.groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))
    line_owners = own.select("conv_id", "turn", F.explode("lines.hash").alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))
    quoted = passages.where("level > 0").groupBy("conv_id", "turn", "level", "hash").agg(F.max("words").alias("words"), F.max("lines").alias("lines"))

    def with_owner(rows: DataFrame, by: DataFrame) -> DataFrame:
        return rows.join(by, ["conv_id", "hash"], "left").withColumn("source", F.when(F.col("source") < F.col("turn"), F.col("source")))

    whole = saved(with_owner(quoted, owners), "whole")
    lines = whole.where("source IS NULL").select("conv_id", "turn", "level", F.explode("lines").alias("x")).select("conv_id", "turn", "level", "x.hash", "x.words").distinct()
    columns = ["conv_id", "turn", "level", "source", "words"]
    found = whole.select(columns).unionByName(with_owner(lines, line_owners).select(columns)).where("source IS NOT NULL")
    votes = found.groupBy("conv_id", "turn", "level", "source").agg(F.sum("words").alias("words"))
    best = votes.groupBy("conv_id", "turn", "level").agg(F.max(F.struct("words", "source")).alias("best"))
    return best.select("conv_id", "turn", "level", F.col("best.source").alias("source"))


def reply_links(originals: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, quoted (level and source, by level) of every linked message."""
    level = F.struct("level", "source")
    own = originals.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(level)).alias("quoted"))
    return saved(own.withColumn("reply_to", F.col("quoted")[0]["source"]), "replies")


def threads(replies: DataFrame) -> DataFrame:
    """conv_id, turn, thread, depth of every message with a reply_to."""
    reach = replies.select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("depth"))
    arrived, steps = None, reach
    while True:
        beyond = steps.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        if arrived is not None:
            beyond = beyond.unionByName(arrived.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more")))
        moved = steps.join(beyond, ["conv_id", "up"], "left").select(
            "conv_id", "turn", F.coalesce("further", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved")
        )
        moved = saved(moved, "reach")
        done = moved.where("NOT moved").drop("moved")
        arrived = done if arrived is None else arrived.unionByName(done)
        steps = moved.where("moved").drop("moved")
        if not steps.limit(1).count():
            return arrived.select("conv_id", "turn", F.col("up").alias("thread"), "depth")


def places(replies: DataFrame) -> DataFrame:
    """conv_id, turn, place: the number of every linked message in the tour of its thread.

    A tour goes down to a message, through its answers in the order of their turns, and up again.
    ``left`` is the number of messages that a step and those after it go down to."""
    ordered = numbered(replies.select("conv_id", "turn", "reply_to"), "n", F.col("conv_id"), F.col("reply_to"), F.col("turn"))
    ordered = saved(ordered, "ordered")
    after = ordered.select((F.col("n") - 1).alias("n"), F.col("conv_id").alias("c"), F.col("reply_to").alias("r"), F.col("turn").alias("sibling"))
    same = (F.col("c") == F.col("conv_id")) & (F.col("r") == F.col("reply_to"))
    siblings = ordered.join(after, "n", "left").select("conv_id", "turn", "reply_to", F.when(same, F.col("sibling")).alias("sibling"))
    children = replies.groupBy("conv_id", F.col("reply_to").alias("turn")).agg(F.min("turn").alias("child"))
    inner = replies.select("conv_id", F.col("turn").alias("reply_to"), F.lit(True).alias("inner"))
    linked = saved(siblings.join(children, ["conv_id", "turn"], "left").join(inner, ["conv_id", "reply_to"], "left"), "linked")

    def step(kind: int, turn, down):
        """The step to ``turn``; no turn ends the tour."""
        return linked.select("conv_id", "turn", F.lit(kind == 0).alias("down"), turn.alias("to_turn"), down.alias("to_down"), F.lit(1 - kind).cast("long").alias("left"))

    child, sibling = F.col("child"), F.col("sibling")
    steps = step(0, F.coalesce(child, F.col("turn")), child.isNotNull()).unionByName(
        step(1, F.coalesce(sibling, F.when(F.col("inner"), F.col("reply_to"))), sibling.isNotNull())
    )
    steps = saved(steps, "steps")
    arrived, moving = steps.where("to_turn IS NULL"), steps.where("to_turn IS NOT NULL")
    while moving.limit(1).count():
        target = moving.unionByName(arrived).select("conv_id", F.col("turn").alias("to_turn"), F.col("down").alias("to_down"), F.col("to_turn").alias("t"), F.col("to_down").alias("d"), F.col("left").alias("more"))
        moved = saved(moving.join(target, ["conv_id", "to_turn", "to_down"]).select("conv_id", "turn", "down", F.col("t").alias("to_turn"), F.col("d").alias("to_down"), (F.col("left") + F.col("more")).alias("left")), "tour")
        arrived, moving = arrived.unionByName(moved.where("to_turn IS NULL")), moved.where("to_turn IS NOT NULL")
    return arrived.where("down").select("conv_id", "turn", "left")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, quoted, thread, depth, place, text, chat (the message with
    its role mark)."""
    ship(messages.sparkSession)
    messages = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parsed = saved(messages.mapInArrow(_parsed, f"conv_id long, turn long, role string, text string, passages {_PASSAGES}"), "parsed")
    passages = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.*")
    replies = reply_links(quoted_originals(passages))
    linked = saved(replies.join(threads(replies), ["conv_id", "turn"]).join(places(replies), ["conv_id", "turn"]), "linked")
    sizes = linked.groupBy("conv_id", "thread").agg(F.count("*").alias("size"))
    links = linked.join(sizes, ["conv_id", "thread"]).withColumn("place", F.col("size") - F.col("left") + 1).drop("size", "left")
    mark = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("text"), F.lit("\n"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return parsed.join(links, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "reply_to", "quoted", F.coalesce("thread", "turn").alias("thread"), none("depth"), none("place"), "text", mark.alias("chat")
    )


def written(ordered: DataFrame, path: str) -> None:
    """Conversations in reply order as files of JSON lines; a long one goes on in the next file."""
    order = ["conv_id", "thread", "place", "turn"]
    ordered.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, "role", "depth", "text").write.json(path)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_ordered(table(spark, sf_dir, "conversations"))


def with_quotes(messages: DataFrame) -> DataFrame:
    """Messages that begin with a line of their own and quote, by a rule over their turns, that
    line of an earlier turn, and one more below it. Every fifth quotes at level 1 what nobody
    wrote, so that only level 2 links it."""
    name = lambda t: F.concat(F.lit("note "), F.col("conv_id"), F.lit(" of turn "), t)
    t = F.col("turn")
    first, second = t - 1 - t % 3, t - 2 - t % 3
    level1 = F.when(first >= 0, F.concat(F.lit("> "), F.when(t % 5 == 4, F.lit("lost line")).otherwise(name(first)), F.lit("\n")))
    level2 = F.when(second >= 0, F.concat(F.lit("> > "), name(second), F.lit("\n")))
    return messages.withColumn("text", F.concat(F.coalesce(level1, F.lit("")), F.coalesce(level2, F.lit("")), name(t), F.lit("\n\n"), F.coalesce("text", F.lit(""))))


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, with quotes put in by ``with_quotes``, linked again."""
    return reply_ordered(with_quotes(table(spark, sf_dir, "conversations"))).select("conv_id", "turn", "reply_to", "thread", "depth", "place")


QUOTED_SQL = """
WITH RECURSIVE quotes AS (
  SELECT conv_id, turn, CASE WHEN turn % 5 <> 4 AND turn - 1 - turn % 3 >= 0 THEN turn - 1 - turn % 3 END AS q1,
         CASE WHEN turn - 2 - turn % 3 >= 0 THEN turn - 2 - turn % 3 END AS q2 FROM conversations),
links AS (SELECT conv_id, turn, coalesce(q1, q2) AS reply_to FROM quotes),
tree AS (
  SELECT conv_id, turn, reply_to, turn AS thread, 0 AS depth, [turn] AS path FROM links WHERE reply_to IS NULL
  UNION ALL
  SELECT l.conv_id, l.turn, l.reply_to, t.thread, t.depth + 1, list_append(t.path, l.turn)
  FROM links l JOIN tree t ON l.conv_id = t.conv_id AND l.reply_to = t.turn)
SELECT conv_id, turn, CAST(reply_to AS BIGINT) AS reply_to, CAST(thread AS BIGINT) AS thread, CAST(depth AS BIGINT) AS depth,
       CAST(row_number() OVER (PARTITION BY conv_id, thread ORDER BY path) - 1 AS BIGINT) AS place FROM tree
"""
