"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits in ``SEGMENTS`` segments on a ring. If two fingerprints
differ in at most t bits, then some segment starts a chain of consecutive
segments whose cumulative differences stay within l * t / SEGMENTS after l
segments, for every l. With t = 2 and four segments a chain of three has the
budgets 0, 1, 1: its first segment is equal, and so is at least one of the next
two. Hence two equal segments at one of six places make a candidate, which is an
equi-join on 32 bits; the chain test prunes before the full comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.common import map_texts, packed
from cellgrove.operators.graph import connected_components
from cellgrove.session import cut

BITS, SEGMENTS, DISTANCE, CHAIN = 64, 4, 2, 3
WIDTH = BITS // SEGMENTS
MASK = (1 << WIDTH) - 1
PLACES = tuple(combinations(range(SEGMENTS), 2))
#: Fingerprints that share a key: up to so many are compared with each other, more meet at midpoints.
CROWDED = 64
_BLOCK = 1 << 16


def simhash(text: str | None, size: int = 3) -> int:
    """Fingerprint of one text: a bit is 1 if set in over half the shingle hashes."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= size:
        hashed = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = list(accumulate((len(w) + 1 for w in found)))
        starts = [0, *ends[:-1]]
        digest = xxhash.xxh64_intdigest
        hashed = [digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[size - 1 :])]
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashed), _BLOCK):
        part = np.array(hashed[i : i + _BLOCK], dtype=np.uint64).astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashed)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """``key`` and ``fp`` (the 64 bits as a long) per row. Null texts count as empty ones: zero."""

    work = lambda texts: [np.array([simhash(t, size) for t in texts], dtype=np.uint64).view(np.int64)]
    return map_texts(docs, key, text, lambda: work, "fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, i * WIDTH).bitwiseAND(F.lit(MASK))


def _chain(difference: Column) -> Column:
    """Whether some chain of ``CHAIN`` segments keeps its cumulative differences within budget."""
    d = [F.bit_count(_segment(difference, i)) for i in range(SEGMENTS)]
    viable = F.lit(False)
    for start in range(SEGMENTS):
        total, ok = F.lit(0), F.lit(True)
        for step in range(CHAIN):
            total = total + d[(start + step) % SEGMENTS]
            ok = ok & (total <= (step + 1) * DISTANCE // SEGMENTS)
        viable = viable | ok
    return viable


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` whose components are those of all pairs within ``DISTANCE`` bits.

    ``distinct`` has each fingerprint once, as ``fp``. Under a key that at most
    ``CROWDED`` fingerprints share, pairs are compared. Under a crowded key each
    fingerprint is linked through the points one bit away, the key left as it is:
    two fingerprints are within two bits exactly if they share such a point or
    one is such a point of the other. That is 33 rows for each fingerprint and
    never more than 33 fingerprints at a point, whatever the crowd.
    """
    places = F.array(
        *[
            F.struct(F.lit(n).alias("place"), (_segment(F.col("fp"), i) * (MASK + 1) + _segment(F.col("fp"), j)).alias("bits"))
            for n, (i, j) in enumerate(PLACES)
        ]
    )
    rows = distinct.select("fp", F.inline(places))
    sizes = rows.groupBy("place", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    rows = cut(rows.join(sizes, ["place", "bits"]))
    light = rows.filter(F.col("n") <= CROWDED)
    left = light.select("place", "bits", F.col("fp").alias("a"))
    right = light.select("place", "bits", F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    near = (F.col("a") < F.col("b")) & _chain(x) & (F.bit_count(x) <= DISTANCE)
    pairs = left.join(right, ["place", "bits"]).filter(near).select("a", "b")

    free = F.array(
        *[
            F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << (s * WIDTH + k))) for s in range(SEGMENTS) if s not in p for k in range(WIDTH)])
            for p in PLACES
        ]
    )
    points = rows.filter(F.col("n") > CROWDED).select(
        "place", "fp", F.explode(F.get(free, F.col("place"))).alias("flip")
    ).select("place", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    least = points.groupBy("place", "point").agg(F.min("fp").alias("b"))
    crowd = points.join(least, ["place", "point"]).filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(crowd).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id`` per row.

    Equal fingerprints collapse to one before any join, so copies cost one row
    each. component_id is the smallest key reachable over links of at most
    ``DISTANCE`` bits. Empty and null texts share the fingerprint zero and are
    linked like any other. Rows with equal keys each keep their own row; a null
    key gets a fingerprint but is never the smallest. An empty table gives an
    empty result.
    """
    fps = cut(fingerprints(docs, key, text, size))
    groups = cut(fps.groupBy("fp").agg(F.min(key).alias("_least")))
    roots = connected_components(fingerprint_links(groups.select("fp")), "a", "b")
    linked = groups.join(roots, groups["fp"] == roots["node"], "left").select(
        F.col("fp").alias("_fp"), F.coalesce("root", "fp").alias("_root"), "_least"
    )
    linked = cut(linked)
    least = linked.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = linked.join(least, "_root").select("_fp", "component_id")
    return fps.join(named, F.col("fp") == F.col("_fp")).select(
        F.col(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


#: Wide fingerprints for similarity: bits over shingles, compared in boxes of 64 on a ring.
WIDE, BOX, WIDE_CHAIN = 1024, 64, 4
#: Members of a key that are compared by a join; more are compared in blocks of this many.
SMALL, CROWD_BLOCK = 24, 256
#: Buckets that occurrences of shingles are counted in, and how many of them travel in one row.
BUCKETS, SLICE = 1 << 20, 1 << 10
_FEW = 4096


def allowed(similarity: float) -> int:
    """Differing bits of wide fingerprints at a Jaccard similarity of sets of equal size."""
    cosine = 2 * similarity / (1 + similarity)
    return int(np.arccos(cosine) / np.pi * WIDE)


def _wide(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Fingerprint of many 64-bit hashes, each stretched to ``bits`` by mixing; as uint64 words."""
    salt = (np.arange(1, bits // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    ones = np.zeros(bits, np.int64)
    for i in range(0, len(hashes), _FEW):
        h = hashes[i : i + _FEW, None] ^ salt
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        ones += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes)).view(np.uint64)


def shingle_hashes(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles of one text; a shorter text is one shingle."""
    found = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    shingles = {b" ".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1))}
    return np.unique(np.array([digest(w, 42) for w in shingles], dtype=np.uint64))


def prefix_keys(hashes: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first ``n - ceil(similarity * n) + 1`` of n hashes, rare ones before common ones.

    Two sets of at least this Jaccard similarity have such a hash in common, for
    any order that is the same for all sets: the first hash of all that they
    share can't come later in either. ``common`` (sorted) and ``counts`` only say
    which hashes come last.
    """
    seen = np.zeros(len(hashes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        seen = np.where(common[at] == hashes, counts[at], 0)
    n = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1
    return hashes[np.lexsort((hashes, seen))[:n]].view(np.int64)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def bucket_counts(texts: DataFrame, size: int) -> np.ndarray:
    """In how many rows of all texts (``_t``) shingles of each bucket are, a row counting once for each of its shingles.

    Every row counts, copies too, so a passage never counts less than what is around
    it, and the counts are the same however rows are dealt. A task holds one count a
    bucket and sends them in slices; what reaches the driver is one count a bucket.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in b["_t"]:
                np.add.at(seen, _bucket(shingle_hashes(t, size)), 1)
        if seen.any():
            yield rows(enumerate(seen.reshape(-1, SLICE)))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for n, counts in zip(b["slice"], b["counts"]):
                totals[n] = totals.get(n, 0) + np.frombuffer(counts, np.int64)
        if totals:
            yield rows(totals.items())

    rows = lambda found: pd.DataFrame([(n, c.tobytes()) for n, c in found], columns=["slice", "counts"])
    kind = "slice int, counts binary"
    out = np.zeros((BUCKETS // SLICE, SLICE), np.int64)
    for r in texts.select("_t").mapInPandas(count, kind).repartition("slice").mapInPandas(add, kind).collect():
        out[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(-1)


def _parts_of(near: np.ndarray, ids: list) -> list[tuple]:
    """Edges from the smallest member of each connected part of a symmetric matrix to the others."""
    out, todo = [], near.any(1)
    while todo.any():
        part, size = np.zeros(len(ids), bool), 0
        part[todo.argmax()] = True
        while part.sum() != size:
            size = part.sum()
            part |= near[part].any(0)
        todo &= ~part
        members = sorted(ids[i] for i in part.nonzero()[0])
        out += [(members[0], m) for m in members[1:]]
    return out


def similar_links(prints: DataFrame, distance: int, similarity: float) -> DataFrame:
    """Edges ``a``, ``b`` between rows (``id``, ``n_set``, ``keys``, ``fp``) that share a key, whose sizes allow the
    similarity and whose fingerprints differ in at most ``distance`` bits.

    Under a key with few members all pairs are taken, each pair once, and tested
    by chains of boxes first: if two fingerprints are near, some box starts a
    chain whose cumulative differences stay within its share of the distance. A
    crowded key is compared in blocks, every block with every other, which gives
    forests and never pairs.
    """
    rows = prints.select("id", F.explode("keys").alias("bits"))
    sizes = rows.groupBy("bits").agg(F.count("*").alias("n")).filter("n > 1")
    rows = cut(rows.join(sizes, "bits"))
    held = prints.select("id", "n_set", "fp")
    few = rows.filter(F.col("n") <= SMALL)
    left, right = few.select("bits", F.col("id").alias("a")), few.select("bits", F.col("id").alias("b"))
    met = left.join(right, "bits").filter("a < b").select("a", "b").distinct()
    met = met.join(held.toDF("a", "n_a", "x"), "a").join(held.toDF("b", "n_b", "y"), "b")
    met = met.filter(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * similarity - 1e-9)
    boxes = WIDE // BOX
    differing = F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y)))

    def near(d: Column) -> Column:
        box = lambda start, n: F.get(d, F.pmod(start + n, F.lit(boxes)))

        def chain(start: Column) -> Column:
            total, ok = F.lit(0), F.lit(True)
            for n in range(WIDE_CHAIN):
                total = total + box(start, n)
                ok = ok & (total <= (n + 1) * distance // boxes)
            return ok

        return F.exists(F.sequence(F.lit(0), F.lit(boxes - 1)), chain) & (F.aggregate(d, F.lit(0), lambda t, n: t + n) <= distance)

    # the array of one binds the differences to a name, so they are worked out once
    viable = F.exists(F.array(differing), near)
    pairs = met.filter(viable).select("a", "b")

    many = rows.filter(F.col("n") > SMALL)
    blocks = F.ceil(F.col("n") / CROWD_BLOCK).cast("int")
    mine = many.withColumn("k", blocks).withColumn("m", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    sent = mine.select("bits", "id", "m", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
    sent = sent.select("bits", "id", F.least("m", "o").alias("i"), F.greatest("m", "o").alias("j")).join(held, "id")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["id"].tolist()
        bits = np.unpackbits(np.stack([np.asarray(f, np.int64) for f in group["fp"]]).view(np.uint8), axis=1).astype(np.float32)
        ones = bits.sum(1)
        near = ones[:, None] + ones[None, :] - 2 * bits @ bits.T <= distance
        n = group["n_set"].to_numpy()
        near &= np.minimum(n[:, None], n) >= np.maximum(n[:, None], n) * similarity - 1e-9
        np.fill_diagonal(near, False)
        return pd.DataFrame(_parts_of(near, ids), columns=["a", "b"])

    kind = prints.schema["id"].dataType.simpleString()
    crowd = sent.groupBy("bits", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}")
    return pairs.unionByName(crowd).distinct()


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, unchanged, but only one of each group of near copies.

    Near copies are texts whose ``size``-word shingles have at least the given
    Jaccard similarity, as told by wide fingerprints (one bit in a hundred more
    or less), and groups are closed under that. The row with the smallest key
    stays; rows without key come last, equal keys are told apart by text, and of
    equal rows one stays. Equal texts collapse before anything is compared.
    Candidates share one of the rarest shingles of both (``prefix_keys``), which
    misses no pair of that similarity; which are rare is counted over all rows.
    """
    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    order = F.struct(F.col(key).isNull().alias("z"), F.col(key).alias("k"), digest.alias("id"))
    least = cut(docs.select(order.alias("o")).groupBy("o.id").agg(F.min("o").alias("o")))
    texts = docs.select(F.col(text).alias("_t"), digest.alias("id"))
    shared = docs.sparkSession.sparkContext.broadcast(bucket_counts(texts, size))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_hashes(t, size) for t in b["_t"]]
            keys = [prefix_keys(h, similarity, h, shared.value[_bucket(h)]) for h in sets]
            yield pd.DataFrame({"id": b["id"], "n_set": [len(h) for h in sets], "keys": keys, "fp": [_wide(h, WIDE).view(np.int64) for h in sets]})

    prints = texts.mapInPandas(run, "id binary, n_set long, keys array<long>, fp array<long>")
    prints = cut(prints.dropDuplicates(["id"]))
    roots = connected_components(similar_links(prints, allowed(similarity), similarity), "a", "b")
    group = least.join(roots, least["id"] == roots["node"], "left").select("o", F.coalesce("root", "id").alias("g"))
    stay = group.groupBy("g").agg(F.min("o").alias("o")).select(F.col("o.k").alias("_k"), F.col("o.id").alias("_id"))
    rows = docs.select(packed(docs), F.col(key).alias("_key"), digest.alias("_digest"))
    kept = rows.join(stay, (F.col("_digest") == F.col("_id")) & F.col("_key").eqNullSafe(F.col("_k")), "left_semi")
    return kept.dropDuplicates(["_digest", "_key"]).select("_row.*")
