"""Quotes of parts of a passage, of text before an introducing line, and of deeper levels."""

import json
import random
import time

from grouploom.llm import chat


def replies(spark, texts):
    df = spark.createDataFrame([(1, k, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in chat.reply_ordered(df).collect()}
    return [got[k].reply_to for k in range(len(texts))], got


def test_text_before_an_introducing_line_is_owned(spark):
    found, got = replies(spark, ["Are you well?", "Fine, thanks.\nOn Monday x wrote:\n> Are you well?", "> Fine, thanks.\nGood."])
    assert found == [None, 0, 1] and got[1].text == "Fine, thanks." and got[2].depth == 2


def test_some_lines_of_a_paragraph(spark):
    found, _ = replies(spark, ["One line here.\nTwo lines there.\nThree lines.", "Thanks.", "> Two lines there.\nYes.", "> Two lines there.\n> Three  LINES.\nNo.", "> Two lines there.\n> edited line\nHm."])
    assert found == [None, None, 0, 0, 0]


def test_paragraphs_come_before_lines(spark):
    found, _ = replies(spark, ["Thanks.\nIs that all?", "Thanks.", "> Thanks.\nWelcome."])
    assert found == [None, None, 1]


def test_deeper_levels_where_level_1_has_no_owner(spark):
    found, got = replies(spark, ["The first text.", "Second.", "> edited second\n> > The first text.\nThird.", "> > The first text.\nFourth.", "> Second.\n> > The first text of many words.\n> > The first text.\nFifth."])
    assert found == [None, None, 0, 0, 1] and got[2].thread == 0 and got[2].text == "Third."


def test_every_level_has_its_original(spark):
    found, got = replies(spark, ["First.", "> First.\nSecond.", "> Second.\n> > First.\nThird.", "> Third.\n> > Second.\n> > > First.\nFourth."])
    assert found == [None, 0, 1, 2] and [got[k].place for k in range(4)] == [0, 1, 2, 3]
    assert [tuple(q) for q in got[3].quoted] == [(1, 2), (2, 1), (3, 0)] and got[0].quoted is None


def brute_replies(parents):
    """Thread, depth and place of every message of a forest of reply links, by recursion."""
    children, out = {}, {}
    for k, p in parents.items():
        children.setdefault(p, []).append(k)

    def walk(k, thread, depth, place):
        out[k] = (thread, depth, place)
        for c in sorted(children.get(k, [])):
            place = walk(c, thread, depth + 1, place + 1)
        return place

    for root in children[None]:
        walk(root, root, 0, 0)
    return out


def test_generated_threads(spark):
    """Branches, a long chain, and a message that most others answer, against recursion."""
    rng = random.Random(6)
    rows, want = [], {}
    for conv, pick in enumerate([lambda k: rng.randrange(k), lambda k: k - 1, lambda k: 0 if rng.random() < 0.8 else rng.randrange(k)]):
        parents = {0: None}
        for k in range(1, 70):
            parents[k] = None if rng.random() < 0.04 else pick(k)
        want |= {(conv, k): (parents[k], *x) for k, x in brute_replies(parents).items()}
        rows += [(conv, k, "user", ("" if p is None else f"> Line {p} of this talk.\n") + f"Line {k} of this talk.\n\nMore.") for k, p in parents.items()]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_to, r.thread, r.depth, r.place) for r in chat.reply_ordered(df.repartition(5)).collect()}
    assert got == want


def test_very_long_message():
    start = time.time()
    text, passages = chat.parse("\n".join(f"line {k}" if k % 3 else f"> quote {k}" for k in range(400_000)))
    again, one = chat.parse("word\n" * 400_000)
    assert len(passages) > 200_000 and one[0][2] == 400_000 and text.count("\n") > 200_000 and again.startswith("word")
    assert time.time() - start < 60


def test_written_in_order(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "user", "a b"), (1, 1, "user", "c"), (1, 2, "user", "> a b\nd"), (1, 3, "user", "> c\ne")], "conv_id long, turn long, role string, text string")
    chat.written(chat.reply_ordered(df), str(tmp_path / "out"))
    lines = [json.loads(x) for f in sorted((tmp_path / "out").glob("*.json")) for x in f.read_text().splitlines()]
    assert [x["text"] for x in lines] == ["a b", "d", "c", "e"]
