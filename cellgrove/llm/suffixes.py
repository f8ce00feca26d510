"""Removal of repeated byte strings through a distributed merge sort of suffixes.

A string of ``LENGTH`` bytes is judged by the k-gram with the smallest hash in it,
its anchor. Equal strings have equal anchors at equal offsets, so it is enough to
sort what follows and, reversed, what precedes the anchors: about one suffix in a
hundred bytes instead of one at each byte.

Suffixes are sorted as strings: tasks sort runs, cut them at splitters and send
them front-coded (shared prefix length and the rest); each range merges its runs
with a loser tree that knows how many bytes a head shares with the last winner and
compares only what lies beyond. The shared lengths in the merged order show at
which depths the path of a suffix branches. The stretch between two branchings is
a node; suffixes of one node are equal that far.

A string with offset o around its anchor is then a pair of nodes, one of the
suffix at depth LENGTH - o and one of the reversed prefix at depth o + GRAM, and it
occurs again exactly if another anchor has the same pair of nodes. That is a
grouped count, whatever the number of copies.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.common import release, store

LENGTH, GRAM = 200, 24
#: Bytes of context whose hash must occur twice for an anchor to matter: one side of any string has them.
HALF = (LENGTH + GRAM) // 2
#: Suffixes in a run, in a range and in a block of a run; splitters are taken from so many a range.
RUN, RANGE, BLOCK, SAMPLE = 100_000, 40_000, 2_000, 32
_ODD = 0x9E3779B97F4A7C15
_PIECE = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    base, inverse = np.full(n, _ODD, np.uint64), np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
    base[0] = inverse[0] = 1
    return np.cumprod(base, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)


_POW, _INV = _powers(_PIECE + 2 * LENGTH)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _least(grams: np.ndarray) -> np.ndarray:
    """Smallest hash of the k-grams of each window, its place in the low bits; of equal ones the first."""
    span = LENGTH - GRAM + 1
    packed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    blocks = np.concatenate([packed, np.full(-len(packed) % span, ~np.uint64(0))]).reshape(-1, span)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(packed) - span + 1
    return np.minimum(right[:count], left[span - 1 : span - 1 + count])


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors of a text with hashes of the ``HALF`` bytes after and before (zero where it ends first)."""
    at, after, before = [], [], []
    for begin in range(0, max(len(text) - LENGTH + 1, 0), _PIECE):
        # windows that start in this piece, with all bytes of the last one and of the contexts
        low = max(begin - HALF, 0)
        part = np.frombuffer(text[low : begin + _PIECE + LENGTH - 1 + HALF], np.uint8).astype(np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * _POW[: len(part)], dtype=np.uint64)])
        n = min(len(text), begin + _PIECE + LENGTH - 1) - low
        grams = _mix((sums[GRAM : n + 1] - sums[: n + 1 - GRAM]) * _INV[: n + 1 - GRAM])[begin - low :]
        found = np.unique(_least(grams) & _PLACE).astype(np.int64) + begin
        here = found - low
        ok = here + HALF <= len(part)
        end = np.where(ok, here + HALF, here)
        after.append(np.where(ok, _mix((sums[end] - sums[here]) * _INV[here]), 0))
        first = here + GRAM - HALF
        ok, first = first >= 0, np.maximum(first, 0)
        before.append(np.where(ok, _mix((sums[here + GRAM] - sums[first]) * _INV[first] + np.uint64(1)), 0))
        at.append(found)
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, keep = np.unique(np.concatenate(at), return_index=True)
    return at, np.concatenate(after)[keep].view(np.int64), np.concatenate(before)[keep].view(np.int64)


def anchors_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Index of the text, position and both hashes of the anchors of many texts; short ones are handled together."""
    group, size = [], 0
    for n, t in enumerate([*texts, None]):
        if group and (t is None or size + len(t) > _PIECE):
            yield _together(group, [texts[i] for i in group])
            group, size = [], 0
        if t is None or len(t) < LENGTH:
            continue
        if len(t) > _PIECE:
            at, after, before = anchors(t)
            yield np.full(len(at), n), at, after, before
        else:
            group.append(n)
            size += len(t)


def _together(numbers: list[int], texts: list[bytes]) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    n, ends = len(raw), np.cumsum([len(t) for t in texts])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw * _POW[:n], dtype=np.uint64)])
    grams = _mix((sums[GRAM:] - sums[: n + 1 - GRAM]) * _INV[: n + 1 - GRAM])
    least = _least(grams)
    whole = np.ones(len(least), bool)
    for e in ends[:-1]:  # windows over the end of a text
        whole[max(e - LENGTH + 1, 0) : e] = False
    found = np.unique(least[whole] & _PLACE).astype(np.int64)
    text = np.searchsorted(ends, found, "right")
    begin = np.concatenate([[0], ends[:-1]])[text]
    ok = found + HALF <= ends[text]
    end = np.where(ok, found + HALF, found)
    after = np.where(ok, _mix((sums[end] - sums[found]) * _INV[found]), 0)
    ok = found + GRAM - HALF >= begin
    first = np.where(ok, found + GRAM - HALF, found)
    before = np.where(ok, _mix((sums[found + GRAM] - sums[first]) * _INV[first] + np.uint64(1)), 0)
    return np.asarray(numbers)[text], found - begin, after.view(np.int64), before.view(np.int64)


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known to be equal."""
    high = min(len(a), len(b))
    if a[known:high] == b[known:high]:
        return high
    low = known
    while low + 1 < high:  # equal up to low, different before high
        mid = (low + high) >> 1
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low if a[low : low + 1] != b[low : low + 1] else low + 1


class LoserTree:
    """Merges sorted runs of (string, bytes shared with the one before, payload)."""

    def __init__(self, runs: list[Iterator[tuple[bytes, int, bytes]]]):
        self.runs, self.n = runs, 1
        while self.n < len(runs):
            self.n *= 2
        self.head = [next(r, None) for r in runs] + [None] * (self.n - len(runs))
        self.common = [0] * self.n  # bytes a head shares with the last winner
        self.losers = [0] * self.n
        self.winner = self._play_all(1)

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser. Bytes that both share with the last winner are not looked at again."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if self.common[a] != self.common[b]:
            return (a, b) if self.common[a] > self.common[b] else (b, a)
        known = self.common[a]
        same = shared(x[0], y[0], known)
        a, b = (a, b) if x[0][same:] <= y[0][same:] else (b, a)
        self.common[b] = same
        return a, b

    def _play_all(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        winner, self.losers[node] = self._play(self._play_all(2 * node), self._play_all(2 * node + 1))
        return winner

    def __iter__(self) -> Iterator[tuple[bytes, int, bytes]]:
        while self.head[self.winner] is not None:
            w = self.winner
            string, _, payload = self.head[w]
            yield string, self.common[w], payload
            self.head[w] = next(self.runs[w], None)
            if self.head[w] is not None:
                self.common[w] = self.head[w][1]
            node = (w + self.n) >> 1
            while node:
                w, self.losers[node] = self._play(w, self.losers[node])
                node >>= 1
            self.winner = w


#: Bytes that go with a suffix: its id, and whether it stands beside one context only.
_ID = 17
_BLOCK_SCHEMA = "part int, run string, seq int, common binary, sizes binary, rest binary, ids binary"


def _front_code(strings: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes, bytes, bytes]:
    common, sizes, rest, before = [], [], [], b""
    for s, _ in strings:
        k = shared(before, s)
        common.append(k)
        sizes.append(len(s) - k)
        rest.append(s[k:])
        before = s
    return bytes(common), bytes(sizes), b"".join(rest), b"".join(i for _, i in strings)


def _decode(blocks: pd.DataFrame) -> Iterator[tuple[bytes, int, bytes]]:
    before = b""
    for common, sizes, rest, ids in blocks[["common", "sizes", "rest", "ids"]].itertuples(index=False, name=None):
        at, first = 0, True
        for n, (k, size) in enumerate(zip(common, sizes)):
            s = (b"" if first else before)[:k] + rest[at : at + size]
            yield s, shared(before, s) if first else k, ids[_ID * n : _ID * n + _ID]
            before, first, at = s, False, at + size


def _records(common: list[int]) -> list[tuple[int, ...]]:
    """For each position, the distinct running minima of ``common`` from it back to the start."""
    out, stack = [], []
    for k in common:
        while stack and stack[-1] >= k:
            stack.pop()
        if k >= GRAM:
            stack.append(k)
        out.append(tuple(stack))
    return out


def _merge(blocks: pd.DataFrame) -> pd.DataFrame:
    """One range in order: per suffix the depths at which it parts from others of the range.

    The row without id sums up the range for its neighbours: the depths at which
    the others part from its first and from its last suffix.
    """
    part = int(blocks["part"].iloc[0])
    runs = [_decode(b.sort_values("seq")) for _, b in blocks.groupby("run", sort=True)]
    strings, common, ids = map(list, zip(*LoserTree(runs)))
    common[0] = 0
    left = _records(common)
    right = _records([*common[1:][::-1]])[::-1] + [()]
    to_first, to_last = list(common), [*common[1:], LENGTH]
    to_first[0] = LENGTH
    for i in range(1, len(strings)):
        to_first[i] = min(to_first[i - 1], common[i])
    for i in range(len(strings) - 2, -1, -1):
        to_last[i] = min(to_last[i + 1], common[i + 1])
    rows = [(part, i[:16], bool(i[16]), s, bytes({*a, *b}), f, z) for i, s, a, b, f, z in zip(ids, strings, left, right, to_first, to_last)]
    rows.append((part, None, False, strings[0], bytes(sorted(set(to_first))), len(strings[0]), to_first[-1]))
    rows.append((part, None, False, strings[-1], bytes(sorted(set(to_last))), len(strings[-1]), -1))
    return pd.DataFrame(rows, columns=["part", "id", "only", "s", "depths", "to_first", "to_last"])


def _borders(sums: list) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
    """Depths at which suffixes of earlier (later) ranges part from the first (last) of each range."""
    firsts = {r.part: r for r in sums if r.to_last >= 0}
    lasts = {r.part: r for r in sums if r.to_last < 0}
    parts = sorted(firsts)
    before, after = {p: [] for p in parts}, {p: [] for p in parts}
    for p, q in zip(parts, parts[1:]):
        edge, whole = shared(bytes(lasts[p].s), bytes(firsts[q].s)), firsts[p].to_last
        before[q] = sorted({min(edge, x) for x in lasts[p].depths} | {min(edge, whole, y) for y in before[p]})
    for p, q in list(zip(parts, parts[1:]))[::-1]:
        edge, whole = shared(bytes(lasts[p].s), bytes(firsts[q].s)), firsts[q].to_last
        after[p] = sorted({min(edge, x) for x in firsts[q].depths} | {min(edge, whole, y) for y in after[q]})
    return before, after


def sorted_paths(strings: DataFrame) -> DataFrame:
    """Of a stored table, which is released: ``id`` and ``path`` of distinct strings: depth, alone or not, and name in 18 bytes an entry, deepest last.

    An entry is alone if no other string reaches its depth with it and the string
    itself stands beside one context ``only``.

    A suffix has the name of a path's entry at every depth from the entry before
    it up to its own; the last entry is the suffix itself. Names are hashes of
    128 bits of the prefix up to the entry's depth.
    """
    spark = strings.sparkSession
    count = strings.count()
    parts = max(1, -(-count // RANGE))
    sample = [bytes(r[0]) for r in strings.orderBy("id").limit(min(count, SAMPLE * parts)).select("s").collect()]
    sample.sort()
    splitters = spark.sparkContext.broadcast([sample[i * len(sample) // parts] for i in range(1, parts)])

    def cut_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number, run = TaskContext.get().partitionId(), 0, []

        def send():
            run.sort()
            rows, low = [], 0
            bounds = [bisect_right(run, (s,)) for s in splitters.value]
            for part, high in enumerate([*bounds, len(run)]):
                for seq, i in enumerate(range(low, high, BLOCK)):
                    rows.append((part, f"{task}:{number}", seq, *_front_code(run[i : min(i + BLOCK, high)])))
                low = high
            return pd.DataFrame(rows, columns=_BLOCK_SCHEMA.replace(",", "").split()[::2])

        for b in batches:
            run += [(bytes(s), bytes(i) + bytes((o,))) for s, i, o in zip(b["s"], b["id"], b["only"])]
            if len(run) >= RUN:
                yield send()
                number, run = number + 1, []
        if run:
            yield send()

    blocks = strings.select("s", "id", "only").mapInPandas(cut_runs, _BLOCK_SCHEMA)
    merged = store(blocks.groupBy("part").applyInPandas(_merge, "part int, id binary, only boolean, s binary, depths binary, to_first int, to_last int"))
    around = spark.sparkContext.broadcast(_borders(merged.filter("id is null").collect()))

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, after = around.value
        for b in batches:
            paths = []
            for part, only, s, own, first, last in b[["part", "only", "s", "depths", "to_first", "to_last"]].itertuples(index=False, name=None):
                depths = {*own, *[min(first, d) for d in before[part]], *[min(last, d) for d in after[part]]}
                alone = only and len(s) not in depths  # no other suffix begins with this one
                depths = sorted(d for d in depths if GRAM <= d < len(s)) + [len(s)]
                paths.append(b"".join([bytes((d, alone and d == len(s))) + xxhash.xxh3_128_digest(s[:d]) for d in depths]))
            yield pd.DataFrame({"id": b["id"], "path": paths})

    rows = merged.filter("id is not null").select("part", "id", "only", "s", "depths", "to_first", "to_last")
    paths = store(rows.mapInPandas(name, "id binary, path binary"))
    release(strings, merged)
    return paths


def _entries(path: bytes) -> list[tuple[int, int, bytes]]:
    return [(path[i], path[i + 1], path[i + 2 : i + 18]) for i in range(0, len(path), 18)]


def _pairs(right: bytes, left: bytes) -> list[tuple[bytes, bytes, int, int, bool]]:
    """Node pairs of an anchor with the first and last offset of each, and whether no other context is in both."""
    out, after = [], _entries(right)
    j, low = len(after) - 1, GRAM - 1
    for depth, alone, u in _entries(left):
        # offsets at which the prefix is in u: o + GRAM in (low, depth]
        a, b = low + 1 - GRAM, min(depth - GRAM, LENGTH - GRAM)
        low = depth
        for k in range(j, -1, -1):
            deep, single, v = after[k]
            under = after[k - 1][0] if k else GRAM - 1
            first, last = max(a, LENGTH - deep), min(b, LENGTH - 1 - under)
            if first <= last:
                out.append((u, v, first, last, bool(alone or single)))
            if LENGTH - 1 - under > b:
                break
            j = k
    return out


def repeated(docs: DataFrame, name: str, text: str) -> DataFrame:
    """``name`` and ``spans`` (start and end in bytes, sorted, may overlap) of texts with repeated strings.

    ``name`` is a binary that tells texts apart: rows with one name are copies of
    one text, which is worked on once and counts as often as it occurs.
    """
    slim = docs.select(F.col(name).alias("_k"), F.col(text).alias("_t")).filter(F.octet_length("_t") >= LENGTH)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, at, after, before in anchors_of([t.encode() for t in b["_t"]]):
                yield pd.DataFrame({"_k": b["_k"].iloc[n].array, "at": at, "after": after, "before": before})

    found = store(slim.mapInPandas(find, "_k binary, at int, after long, before long"))
    # an anchor matters if the context on one of its sides occurs twice
    sides = found.select("_k", "at", F.explode(F.array("after", "before")).alias("h")).filter("h <> 0")
    twice = sides.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    kept = sides.join(twice, "h", "left_semi").groupBy("_k").agg(F.sort_array(F.collect_set("at")).alias("ats"))

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            rows = []
            for k, copies, t, ats in zip(b["_k"], b["copies"], b["_t"], b["ats"]):
                raw = t.encode()
                for a in ats.tolist():
                    right, left = raw[a : a + LENGTH], raw[max(a + GRAM - LENGTH, 0) : a + GRAM][::-1]
                    rid, lid = digest(right), digest(left)
                    rows.append((k, copies, a, right, left, rid, lid, digest(rid + lid)))
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=["_k", "copies", "at", "right", "left", "rid", "lid", "pid"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["_k", "copies", "at", "right", "left", "rid", "lid", "pid"])

    # copies are collapsed before the shuffle, which the join then shares
    once = slim.groupBy("_k").agg(F.first("_t").alias("_t"), F.count("*").alias("copies"))
    around = once.join(kept, "_k").select("_k", "copies", "_t", "ats").mapInPandas(
        contexts, "_k binary, copies long, at int, right binary, left binary, rid binary, lid binary, pid binary"
    )
    around = store(around)

    def strings(i: str, x: str, other: str) -> DataFrame:
        only = (F.min(other) == F.max(other)).alias("only")
        return store(around.groupBy(F.col(i).alias("id")).agg(F.first(x).alias("s"), only))

    after, before = strings("rid", "right", "lid"), strings("lid", "left", "rid")
    places = store(around.select("_k", "at", "pid"))
    both = store(around.groupBy("pid").agg(F.first("rid").alias("rid"), F.first("lid").alias("lid"), F.sum("copies").alias("n")))
    release(found, around)
    right = sorted_paths(after).select(F.col("id").alias("rid"), F.col("path").alias("right"))
    left = sorted_paths(before).select(F.col("id").alias("lid"), F.col("path").alias("left"))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            rows = []
            for pid, n, r, l in b[["pid", "n", "right", "left"]].itertuples(index=False, name=None):  # noqa: E741
                # nodes that hold this pair of contexts alone repeat as often as the pair does
                rows += [(pid, n, None if own else digest(u + v), x, y) for u, v, x, y, own in _pairs(r, l) if n > 1 or not own]
            yield pd.DataFrame(rows, columns=["pid", "n", "node", "first", "last"])

    nodes = store(both.join(right, "rid").join(left, "lid").select("pid", "n", "right", "left").mapInPandas(spread, "pid binary, n long, node binary, first int, last int"))
    release(both, right, left)
    again = nodes.filter("node is not null").groupBy("node").agg(F.sum("n").alias("m")).filter("m > 1").select("node")
    hits = nodes.filter("node is null").select("pid", "first", "last").unionByName(
        nodes.join(again, "node", "left_semi").select("pid", "first", "last")
    )
    # all strings around an anchor overlap in it, so what they cover is one span
    ranges = hits.groupBy("pid").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    spans = places.join(ranges, "pid").select(
        "_k", F.struct((F.col("at") - F.col("last")).alias("start"), (F.col("at") - F.col("first") + LENGTH).alias("end")).alias("s")
    )
    return spans.groupBy(F.col("_k").alias(name)).agg(F.sort_array(F.collect_list("s")).alias("spans"))


def _join_up(spans) -> list[tuple[int, int]]:
    """Maximal runs of sorted spans; runs that touch are one."""
    out: list[list[int]] = []
    for s in spans if spans is not None else ():
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["start"], s["end"]])
    return [(a, b) for a, b in out]


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``removed`` (maximal byte runs) and ``kept`` (the bytes that remain).

    A byte goes if a string of ``LENGTH`` bytes over it also starts anywhere
    else, in the same text or another. Null texts count as empty ones; texts
    under ``LENGTH`` bytes stay whole. Keys may be null or equal: what goes from a
    row depends on its text alone, which is known by 128 bits of its SHA-256.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), whole.alias("_t"), F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("_d"))
    spans = repeated(rows, "_d", "_t")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone, left = [], []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw, runs, kept, at = t.encode(), _join_up(spans), [], 0
                for a, z in runs:
                    kept.append(raw[at:a])
                    at = z
                gone.append([{"start": a, "end": z} for a, z in runs])
                left.append(b"".join([*kept, raw[at:]]))
            removed = pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), removed, pa.array(left, pa.binary())], [key, "removed", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    joined = rows.join(spans, "_d", "left").select("_key", "_t", "spans")
    return joined.mapInArrow(take, f"`{key}` {kind}, removed array<struct<start:long,end:long>>, kept binary")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Bytes, removed bytes, removed runs and the digest of what remains, per row."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return remove(docs, key, text).select(
        key, (gone + F.length("kept")).cast("long").alias("n_bytes"), gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
