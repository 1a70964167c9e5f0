"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A vocabulary of word pieces with an end-of-word suffix (a ``tokenizers`` JSON file) is read as
data. Every distinct word of a batch is merged once: its symbols are the leaves' neighbours of a
segment tree whose leaves hold the ranks of adjacent pairs and whose root is the leftmost lowest
rank. A merge rewrites two leaves and their paths to the root, until the root holds no rank. The
trees of all new words of a batch with equal width are updated together as NumPy arrays.

Defined results: a null text counts as empty and gives no ids. Strings of special tokens in a text
become those tokens, as in the library. Very long texts are encoded whole; a word of more than 4096
bytes takes the same steps on a tree of its own. Repeated rows are encoded each; of pairs of equal
rank the leftmost is merged first. An empty table gives no rows. Extra columns take no part.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import table, text_parts

NONE = np.int64(1) << 40  # a rank that no pair has
#: Blocks of code points whose case and classes are the same in all tables: Latin, Greek, Cyrillic, general
#: punctuation, currency, kana and the first block of Han. Texts with others are normalised and split by the
#: tokenizers library, whose tables have a version of their own; words are merged here in either case.
FAMILIAR = r"\u0000-\u052f\u1e00-\u1eff\u2000-\u206f\u20a0-\u20bf\u3040-\u30ff\u4e00-\u9fa5"
STRANGE = re.compile(f"[^{FAMILIAR}]")
#: Words that a worker remembers at most; beyond that the memory starts anew.
REMEMBERED = 400_000


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 bytes stand
    for themselves, the others for the letters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, more = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in letters:
            letters[b], more = chr(more), more + 1
    return [letters[b] for b in range(256)]


class PairTree:
    """Segment trees, one per row, over the ranks of adjacent pairs of equally wide words."""

    def __init__(self, ranks: np.ndarray):
        n, width = ranks.shape
        self.leaves = 1 << max(0, int(width - 1).bit_length())
        # rank first, then place, so that the minimum is the leftmost lowest rank
        self.key = np.full((n, 2 * self.leaves), NONE << np.int64(12), np.int64)
        self.key[:, self.leaves : self.leaves + width] = (ranks << np.int64(12)) | np.arange(width)
        for k in range(self.leaves - 1, 0, -1):
            self.key[:, k] = np.minimum(self.key[:, 2 * k], self.key[:, 2 * k + 1])

    def root(self) -> tuple[np.ndarray, np.ndarray]:
        return self.key[:, 1] >> np.int64(12), self.key[:, 1] & np.int64(4095)

    def update(self, rows: np.ndarray, places: np.ndarray, ranks: np.ndarray) -> None:
        at = self.leaves + places
        self.key[rows, at] = (ranks << np.int64(12)) | places
        while (at > 1).any():
            at = at >> 1
            self.key[rows, at] = np.minimum(self.key[rows, 2 * at], self.key[rows, 2 * at + 1])


class Vocabulary:
    def __init__(self, spec_text: str):
        spec = json.loads(spec_text)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.pieces = {v: k for k, v in self.ids.items()} | {v: k for k, v in self.special.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        # the library's own tables of letters and case, for texts with code points outside FAMILIAR
        self.normalizer = tokenizers.Tokenizer.from_str(spec_text).normalizer
        self.splitter = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "removed", invert=True)
        self.specials = regex.compile("|".join(regex.escape(x) for x in self.special)) if self.special else None
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([self.ids[a] for a, _ in merges], np.int64)
        right = np.array([self.ids[b] for _, b in merges], np.int64)
        made = np.array([self.ids[a + b] for a, b in merges], np.int64)
        pair = (left << np.int64(20)) | right
        # of pairs listed twice the later counts, as in a table that is filled in order
        _, last = np.unique(pair[::-1], return_index=True)
        keep = np.sort(len(pair) - 1 - last)
        order = keep[np.argsort(pair[keep])]
        self.pair, self.rank, self.made = pair[order], order.astype(np.int64), made[order]
        letters = byte_letters()
        self.first = np.array([self.ids[x] for x in letters], np.int64)
        self.final = np.array([self.ids[x + self.suffix] for x in letters], np.int64)

    @cached_property
    def merges(self) -> dict[int, tuple[int, int]]:
        """Pair -> rank and merged id, for words that are merged one by one."""
        return dict(zip(self.pair.tolist(), zip(self.rank.tolist(), self.made.tolist(), strict=True), strict=True))

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of every pair; NONE where the two don't merge (or one is absent)."""
        pair = (left << np.int64(20)) | right
        at = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
        known = (self.pair[at] == pair) & (left >= 0) & (right >= 0)
        return np.where(known, self.rank[at], NONE), np.where(known, self.made[at], -1)

    def merge_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of every word; words are grouped by the width of their tree."""
        out: list[list[int]] = [[] for _ in words]
        groups: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            groups.setdefault(max(1, (len(word) - 1).bit_length()), []).append(k)
        for _, all_members in sorted(groups.items()):
            width = max(len(words[k]) for k in all_members)
            step = max(1, (1 << 18) // width)
            for a in range(0, len(all_members), step):
                self._merge(words, all_members[a : a + step], out)
        return out

    def _merge(self, words: list[bytes], members: list[int], out: list[list[int]]) -> None:
        sizes = np.array([len(words[k]) for k in members])
        width = int(sizes.max())
        if width > 4096:  # a place must fit its 12 bits; such words take the same steps by hand
            for k in members:
                out[k] = self._merge_long(words[k])
            return
        n = len(members)
        grid = np.zeros((n, width), np.uint8)
        inside = np.arange(width) < sizes[:, None]
        grid[inside] = np.frombuffer(b"".join(words[k] for k in members), np.uint8)
        ids = np.where(inside, self.first[grid], -1)
        ids[np.arange(n), sizes - 1] = self.final[grid[np.arange(n), sizes - 1]]
        if width > 1:
            after = np.tile(np.arange(1, width + 1), (n, 1))  # next living place; width or more: none
            before = np.tile(np.arange(-1, width - 1), (n, 1))
            ranks, _ = self.look_up(ids[:, :-1], ids[:, 1:])
            tree = PairTree(ranks)
            live = np.arange(n)
            while True:
                rank, place = tree.root()
                live = live[rank[live] < NONE]
                if not len(live):
                    break
                at = place[live]
                gone = after[live, at]
                _, merged = self.look_up(ids[live, at], ids[live, gone])
                ids[live, at], ids[live, gone] = merged, -1
                nxt = after[live, gone]
                after[live, at] = nxt
                has = nxt < width
                before[live[has], nxt[has]] = at[has]
                right = np.full(len(live), NONE)
                right[has] = self.look_up(merged[has], ids[live[has], nxt[has]])[0]
                tree.update(live, at, right)
                dead = gone < width - 1
                tree.update(live[dead], gone[dead], np.full(int(dead.sum()), NONE))
                prev = before[live, at]
                has = prev >= 0
                tree.update(live[has], prev[has], self.look_up(ids[live[has], prev[has]], merged[has])[0])
        for k, row in zip(members, ids, strict=True):
            out[k] = row[row >= 0].tolist()

    def _merge_long(self, word: bytes) -> list[int]:
        """One very long word: the same tree as a flat list, updated along one path at a time."""
        ids = self.first[np.frombuffer(word, np.uint8)]
        ids[-1] = self.final[word[-1]]
        ranks = self.look_up(ids[:-1], ids[1:])[0].tolist()
        ids, n = ids.tolist(), len(ids)
        table = self.merges
        leaves = 1 << (n - 1).bit_length()
        worst = (int(NONE), 0)
        tree = [worst] * (2 * leaves)
        for k, r in enumerate(ranks):
            tree[leaves + k] = (r, k)
        for k in range(leaves - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(k: int, rank: int) -> None:
            at = leaves + k
            tree[at] = (rank, k)
            while at > 1:
                at >>= 1
                tree[at] = min(tree[2 * at], tree[2 * at + 1])

        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while tree[1][0] < NONE:
            k = tree[1][1]
            gone = after[k]
            ids[k] = table[(ids[k] << 20) | ids[gone]][1]
            ids[gone] = -1
            after[k] = after[gone]
            put(gone, int(NONE))
            put(k, int(NONE))
            if after[k] < n:
                before[after[k]] = k
                put(k, table.get((ids[k] << 20) | ids[after[k]], worst)[0])
            if before[k] >= 0:
                put(before[k], table.get((ids[before[k]] << 20) | ids[k], worst)[0])
        return [x for x in ids if x >= 0]

    def split(self, text: str) -> list[str]:
        """The words of a text in order; a special token's string is a word of its own.

        White space only separates words, so folding its runs to single spaces, as the
        vocabulary's normaliser does, would not change them.
        """
        if self.specials and "<|" in text:
            out, at = [], 0
            for found in self.specials.finditer(text):
                out += self._plain(text[at : found.start()])
                out.append(found[0])
                at = found.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.words.findall(text.lower())
        if STRANGE.search(text):
            return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]
        text = unicodedata.normalize("NFC", text)
        # letter by letter: str.lower alone has a rule for a sigma at a word's end
        return self.words.findall(text.lower() if "\u03a3" not in text else "".join(map(str.lower, text)))


class Encoder:
    """A vocabulary and the words that it has met: their ids as packed int32, and their pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        special = self.vocabulary.special
        self.ids = {w: np.int32(k).tobytes() for w, k in special.items()}
        self.text = {w: w for w in special}

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Packed ids and decoded text (pieces joined by a space) of every text."""
        split = [self.vocabulary.split(t) for t in texts]
        new = set().union(*split).difference(self.ids)
        if len(self.ids) + len(new) > REMEMBERED:
            self.forget()
            new = set().union(*split).difference(self.ids)
        if new:
            words = sorted(new)
            pieces = self.vocabulary.pieces
            for word, ids in zip(words, self.vocabulary.merge_words([w.encode() for w in words]), strict=True):
                self.ids[word] = np.array(ids, np.int32).tobytes()
                self.text[word] = " ".join([pieces[k] for k in ids])
        ids, text = self.ids.__getitem__, self.text.__getitem__
        return [b"".join(map(ids, s)) for s in split], [" ".join(map(text, s)) for s in split]


_encoders: dict[str, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    name = hashlib.sha256(spec.encode()).hexdigest()
    if name not in _encoders:
        _encoders[name] = Encoder(Vocabulary(spec))
    return _encoders[name]


def encode(docs: DataFrame, tokenizer_path: str, keep: tuple[str, ...] = ("doc_id",), decode: bool = True) -> DataFrame:
    """The columns ``keep`` of ``docs``, and ids (array<int>) and, with ``decode``, decoded
    (string) of every row's whole text. The vocabulary file (a bounded size) is broadcast."""
    spark = ship(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    docs = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    names = [*keep, "ids", *["decoded"] * decode]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1]] + ["ids array<int>"] + ["decoded string"] * decode)

    def run(batches):
        encoder = _encoder(spec.value)
        for batch in batches:
            for row, data, offsets in text_parts(batch.column(len(keep)), 1 << 20):
                whole, n = data.tobytes(), len(offsets) - 1
                packed, decoded = encoder.encode([whole[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
                ends = np.zeros(n + 1, np.int32)
                np.cumsum([len(p) >> 2 for p in packed], out=ends[1:])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                columns = [batch.column(k).slice(row, n) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, lists, *[pa.array(decoded, pa.string())] * decode], names=names)

    return docs.mapInArrow(run, ddl)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents"), default_tokenizer())
    hexed: Column = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256)
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), hexed.alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
