"""BPE encoding and decoding with a trie of distinct words.

Byte pair encoding has a prefix property: the encoding of a string without its
last token is the encoding of that shorter string. So the last token of each
prefix is all there is to remember, and it is the longest vocabulary entry that
ends the prefix and may follow the last token before it. Words are put in a trie
and visited depth first; a prefix that many words share is settled once.

Only files of one kind are read: normalised by NFC, white space and lower case,
split by a pattern, byte-level letters, with a suffix at the end of each word.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The Unicode white space, and the ASCII separators that Python's split() adds to it.
_SPACE = "[\t-\r \x85\xa0  -     　]+"
_SPACES = re.compile(_SPACE)
_ODD = re.compile("[\x1c-\x1f]")
# Letters and digits that Unicode 16 added to those of the running Python (15.1),
# as ranges, and their lower case where they have one. Tokenizer files follow Unicode 16.
_ADDED = """1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d40-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b-1138b
1138e-1138e 11390-113b5 113b7-113b7 113d1-113d1 113d3-113d3 116d0-116e3 11bc0-11be0 11bf0-11bf9 13460-143fa
16100-1611d 16130-16139 16d40-16d6c 16d70-16d79 18cff-18cff 1ccf0-1ccf9 1e5d0-1e5ed 1e5f0-1e5fa"""
_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}
_LOWER |= {0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_LATE = re.compile("[" + "".join(map(chr, _LOWER)) + "Σ]")
#: Words kept between batches; text handled at a time.
CACHED_WORDS, BLOCK_CHARS = 600_000, 1 << 21


def _letters() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _known_classes(pattern: str) -> str:
    """``pattern`` with letters and numbers limited to what Unicode 16 has; white space spelled out."""
    added = [tuple(int(x, 16) for x in r.split("-")) for r in _ADDED.split()]
    out = {}
    for kind in "LN":
        is_kind, runs = regex.compile(rf"\p{{{kind}}}").match, []
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and is_kind(chr(c)) and (unicodedata.category(chr(c)) != "Cn" or any(a <= c <= b for a, b in added)):
                if runs and runs[-1][1] == c - 1:
                    runs[-1][1] = c
                else:
                    runs.append([c, c])
        out[kind] = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in runs)
    for kind, ranges in out.items():
        pattern = pattern.replace(rf"\p{{{kind}}}", ranges)
    return pattern.replace(r"\s", _SPACE[1:-2])


class Vocabulary:
    """Tables of one tokenizer file; picklable, to be broadcast."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        splitter, level = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or level["type"] != "ByteLevel" or not model["end_of_word_suffix"] or spec["decoder"]:
            raise ValueError(f"{path} is of another kind")
        self.pattern = _known_classes(splitter["pattern"]["Regex"])
        self.suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in (ids | self.special).items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for n, (a, b) in enumerate(model["merges"]):
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.merged[left, right] = whole
            if whole in self.parts:
                raise ValueError(f"{a + b!r} is made by two merges")
            self.parts[whole], self.rank[whole] = (left, right), n
        # Entries by their letters, the word end told apart: those that encode as themselves.
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for t, i in ids.items():
            if t in self.special or not self._own(i):
                continue
            if t.endswith(self.suffix):
                self.final[t.removesuffix(self.suffix)] = i
            else:
                self.inner[t] = i
        self.longest = max(map(len, [*self.inner, *self.final]))

    def _own(self, token: int) -> bool:
        """Whether merging by rank ever makes this entry, i.e. its last merge isn't forestalled."""
        if token not in self.parts:
            return True
        left, right = self.parts[token]
        return self._own(left) and self._own(right) and self.follows(left, right, self.rank[token])

    def follows(self, left: int, right: int, limit: int | float = float("inf")) -> bool:
        """Whether no merge of a rank below ``limit`` would join the two across their border.

        The merges that made the two are undone from the latest on. A merge
        across the border counts only if it came before what is undone by then:
        of equal ranks the one further left goes first.
        """
        rank, parts, merged = self.rank, self.parts, self.merged
        while True:
            across = merged.get((left, right))
            if across is not None and rank[across] < limit:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit = min(limit, a)
                left = parts[left][1]
            else:
                limit = min(limit, b + 1)
                right = parts[right][0]


class Encoder:
    """Encodes texts; remembers a bounded number of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.stand_in = {b: c for b, c in enumerate(_letters()) if c != chr(b)}
        self.split = re.compile(vocabulary.pattern).findall
        self.special = re.compile("(" + "|".join(map(re.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.table = np.array([vocabulary.tokens.get(i, "") for i in range(max(vocabulary.tokens) + 1)], dtype=object)
        self.known: dict[str, bytes] = {}
        self.follow: dict[tuple[int, int], bool] = {}

    def walk(self, words: list[str]) -> dict[str, bytes]:
        """Token ids, as little-endian bytes, of words given as byte letters, through a trie of all of them."""
        root: dict = {}
        for w in words:
            node = root
            for c in w[:-1]:
                below = node.get(c)
                if below is None:
                    below = node[c] = {}
                node = below
            if "" in node:
                node[""].append(w[-1])
            else:
                node[""] = [w[-1]]
        inner, final, longest, follow, follows = self.v.inner, self.v.final, self.v.longest, self.follow, self.v.follows
        out: dict[str, bytes] = {}
        last: list[int] = [-1]  # last token of each prefix on the branch
        begin: list[int] = [0]  # where it begins

        def settle(path: str, table: dict[str, int], n: int, first: int) -> tuple[int, int]:
            """Last token of ``path`` and its start. Only one entry fits, so likely starts come first."""
            low = n - longest if n > longest else 0
            for starts in (range(first if first > low else low, n), range(first - 1, low - 1, -1)):
                for start in starts:
                    token = table.get(path[start:])
                    if token is None:
                        continue
                    if not start:
                        return token, 0
                    pair = last[start] << 20 | token
                    ok = follow.get(pair)
                    if ok is None:
                        ok = follow[pair] = follows(last[start], token)
                    if ok:
                        return token, start
            raise ValueError(f"{path!r} has letters that the vocabulary lacks")

        stack = [("", root, 0, 0)]
        while stack:
            path, node, n, first = stack.pop()
            if n:
                del last[n:], begin[n:]
                token, first = settle(path, inner, n, first)
                last.append(token)
                begin.append(first)
            for c, child in node.items():
                if c:
                    stack.append((path + c, child, n + 1, first))
                    continue
                for end in child:
                    word = path + end
                    token, at = settle(word, final, n + 1, first)
                    if at:
                        ids = [token]
                        while at:
                            ids.append(last[at])
                            at = begin[at]
                        ids.reverse()
                        out[word] = array("i", ids).tobytes()
                    else:
                        out[word] = token.to_bytes(4, "little")
        return out

    def learn(self, chunks: list[str]) -> None:
        """Adds texts without white space to ``known``: their ids as little-endian bytes.

        A piece of the split is split into itself, so pieces are remembered alike.
        """
        known, split, stand_in = self.known, self.split, self.stand_in
        pieces = [split(c) for c in chunks]
        fresh = {w for ws in pieces for w in ws if w not in known}
        spelt = {w: w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(stand_in) for w in fresh}
        found = self.walk(list(spelt.values()))
        for w, letters in spelt.items():
            known[w] = found[letters]
        for c, ws in zip(chunks, pieces):
            if len(ws) != 1:
                known[c] = b"".join([known[w] for w in ws])

    def chunks(self, text: str) -> list[str]:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if not text.isascii() and _LATE.search(text):
            text = text.replace("Σ", "σ").translate(_LOWER)  # each letter by itself: no final sigma
        text = text.lower()
        return [c for c in _SPACES.split(text) if c] if _ODD.search(text) else text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian bytes."""
        jobs: list[list[str | int]] = []
        for text in texts:
            parts: list[str | int] = []
            for n, part in enumerate(self.special.split(text) if self.special and "<" in text else [text]):
                parts += [self.v.special[part]] if n % 2 else self.chunks(part)
            jobs.append(parts)
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
            self.follow.clear()
        self.learn([p for p in {p for parts in jobs for p in parts if p.__class__ is str} if p not in self.known])
        known = self.known
        mixed = lambda p: known[p] if p.__class__ is str else np.array([p], "<i4").tobytes()
        return [b"".join([known[p] for p in parts] if all(p.__class__ is str for p in parts) else map(mixed, parts)) for parts in jobs]

    def encode_long(self, text: str) -> bytes:
        """A text of any length, cut at white space into blocks."""
        out, at = [], 0
        while at < len(text):
            cut = _SPACES.search(text, at + BLOCK_CHARS) if len(text) > at + BLOCK_CHARS else None
            end = cut.end() if cut else len(text)
            out += self.encode([text[at:end]])
            at = end
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.table[ids].tolist())


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        if size and size + len(t) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


_ENCODERS: dict[str, Encoder] = {}


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` (array of int) and ``decoded`` (the text that the ids stand for) per row.

    Special tokens written out in a text become their ids; none are added. Null
    and empty texts have no ids and decode to the empty text. The vocabulary has
    a fixed size and is broadcast; the file is read on the driver only.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary(path))
    name = hashlib.sha256(open(path, "rb").read()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _ENCODERS.get(name)
        if coder is None:
            coder = _ENCODERS[name] = Encoder(shared.value)
        for batch in batches:
            start = 0
            for block in _blocks([t or "" for t in batch.column(1).to_pylist()]):
                found = coder.encode(block) if len(block[0]) <= BLOCK_CHARS else [coder.encode_long(t) for t in block]
                flat = np.frombuffer(b"".join(found), "<i4")
                ends = np.cumsum([0, *[len(f) // 4 for f in found]])
                decoded = [coder.decode(flat[a:b]) for a, b in zip(ends, ends[1:])]
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(block)), ids, pa.array(decoded, pa.string())], [key, "ids", "decoded"])
                start += len(block)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")


def report(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Number of tokens and digests of ids and decoded text per row."""
    return encode(docs, path, key, text).select(
        key, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
