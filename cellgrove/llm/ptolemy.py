"""Centroid clustering of whole-number vectors with bounds from Ptolemaic pivots.

Lloyd's rounds in exact arithmetic. In a Euclidean space Ptolemy's inequality holds for
any four points, so for a vector x, a centroid c and a pivot pair (p, q)

    |x-c| >= | |x-p| |c-q| - |x-q| |c-p| | / |p-q|

The distances of vectors to the pivots never change and are stored beside the
vectors; those of the few centroids are renewed each round. Every distance is kept as
an interval of two doubles that surely holds the true one, and the bound is taken from
the ends that make it least. A centroid whose bound lies beyond the exact distance to
another centroid is out; the survivors are compared by exact whole-number distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.common import release, store

CLUSTERS, ROUNDS, SCALE, DIMENSIONS, SEED = 8, 10, 1024, 64, "3"
#: Pivots, and the pairs of them that are used.
PIVOTS, PAIRS = 8, 8
#: Rows that are handled in one block.
BLOCK = 4096
#: Below this, squared distances of up to 2**12 components fit 64 bits.
_SMALL = 1 << 24
#: Relative slack of one rounded operation in double precision, with room to spare.
_EPS = 2.0**-50


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows; Python's whole numbers where 64 bits might not do."""
    if max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) >= _SMALL or x.shape[-1] > 1 << 12:
        x, y = x.astype(object), y.astype(object)
    d = x - y
    return (d * d).sum(axis=-1)


def root_interval(d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles below and above the square roots of whole numbers."""
    r = np.sqrt(d2.astype(np.float64))
    return r * (1 - 4 * _EPS), r * (1 + 4 * _EPS)


def lower_bounds(x: tuple[np.ndarray, np.ndarray], c: tuple[np.ndarray, np.ndarray], pairs: list[tuple[int, int, float]]) -> np.ndarray:
    """Squared lower bounds, rows of x by rows of c, from intervals of their pivot distances.

    ``pairs`` holds two pivots and an upper end of their distance.
    """
    out = np.zeros((len(x[0]), len(c[0])))
    for p, q, apart in pairs:
        low = x[0][:, p, None] * c[0][None, :, q] - x[1][:, q, None] * c[1][None, :, p]
        back = x[0][:, q, None] * c[0][None, :, p] - x[1][:, p, None] * c[1][None, :, q]
        # slack for the products, beyond what the intervals hold
        slack = 4 * _EPS * (x[1][:, p, None] * c[1][None, :, q] + x[1][:, q, None] * c[1][None, :, p])
        np.maximum(out, (np.maximum(low, back) - slack) / apart, out=out)
    return out * out * (1 - 8 * _EPS)


def choose_pairs(pivots: np.ndarray, most: int = PAIRS) -> list[tuple[int, int, float]]:
    """For each pivot the pair with the farthest other one; pairs of equal pivots give no bound and are left out."""
    out = {}
    for p in range(len(pivots)):
        far = squared(pivots, pivots[p][None, :])
        q = int(np.argmax(far))
        if far[q] > 0:
            out.setdefault((min(p, q), max(p, q)), float(root_interval(np.array([far[q]]))[1][0]))
    return [(p, q, d) for (p, q), d in out.items()][:most]


def assign(
    x: np.ndarray, cached: tuple[np.ndarray, np.ndarray], centroids: np.ndarray, pivots: np.ndarray, pairs: list[tuple[int, int, float]]
) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: the smaller number), exact squared distance, and how many distances were computed."""
    to_pivots = np.stack([squared(centroids, p[None, :]) for p in pivots], axis=1)
    bounds = lower_bounds(cached, root_interval(to_pivots), pairs)
    own = bounds.argmin(1)
    best = squared(x, centroids[own])
    checked = len(x)
    for c in range(len(centroids)):
        # the bound is a double and may be compared with the exact distance after rounding that up
        rows = np.flatnonzero((own != c) & (bounds[:, c] <= best.astype(np.float64) * (1 + 4 * _EPS)))
        if len(rows):
            checked += len(rows)
            d = squared(x[rows], centroids[c][None, :])
            best, d = (best.astype(object), d.astype(object)) if object in (best.dtype, d.dtype) else (best, d)
            closer = (d < best[rows]) | ((d == best[rows]) & (c < own[rows]))
            own[rows[closer]], best[rows[closer]] = c, d[closer]
    return own, best, checked


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            yield batch.slice(at, BLOCK)


def whole_vectors(vectors: DataFrame, key: str, vector: str, scale: int, dimensions: int) -> DataFrame:
    """``_k`` and ``_x``: kept vectors as whole numbers floor(scale * component).

    Kept are vectors of the wanted length without null or non-finite components
    whose whole numbers are below 2**62 in size.
    """
    scaled = F.transform(vector, lambda v: F.floor(v.cast("double") * float(scale)))
    fits = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * float(scale)) < float(1 << 62))
    ok = F.col(vector).isNotNull() & (F.size(vector) == dimensions) & F.forall(vector, fits)
    return vectors.select(F.col(key).alias("_k"), F.when(ok, scaled).cast("array<bigint>").alias("_x")).filter("_x is not null")


def seed_key(key: Column, seed: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256)


def cluster(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    dimensions: int = DIMENSIONS,
    seed: str = SEED,
) -> DataFrame:
    """Per kept vector: ``key``, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    See ``whole_vectors`` for what is kept; other rows are not returned. The
    first ``k`` kept vectors by SHA-256 of ``seed:key`` (ties: by components; null keys
    last) are the first centroids, fewer where fewer are kept. Equal ones make
    the later one empty, and empty ones stay. Rows with equal or null keys count as
    rows of their own. distance is null, and sums are, where they exceed 64 bits.
    An empty table gives an empty result.

    The vectors are written once with their pivot distances. A round reads them,
    sums each block by cluster inside its task, and shuffles only these sums; k
    centroids are all that the driver holds.
    """
    spark = vectors.sparkSession
    points = whole_vectors(vectors, key, vector, scale, dimensions)
    order = seed_key(F.col("_k"), seed)
    first = [r[0] for r in points.orderBy(order.asc_nulls_last(), "_x").limit(k).select("_x").collect()]
    centroids = np.array(first, dtype=np.int64).reshape(len(first), dimensions)
    pivots = centroids[:PIVOTS]
    pairs = choose_pairs(pivots)

    def cache(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            x = _matrix(b.column(1))
            low, high = root_interval(np.stack([squared(x, p[None, :]) for p in pivots], axis=1))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(v.reshape(-1)), len(pivots)).cast(pa.list_(pa.float64())) for v in (low, high)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["_k", "_x", "_low", "_high"])

    kind = points.schema["_k"].dataType.simpleString()
    held = "_low array<double>, _high array<double>"
    if not first:
        nothing = points.limit(0).select(F.col("_k").alias(key))
        return nothing.selectExpr("*", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    known = store(points.mapInArrow(cache, f"_k {kind}, _x array<bigint>, {held}"))

    def nearest(b: pa.RecordBatch, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = _matrix(b.column(1))
        own, best, _ = assign(x, (_matrix(b.column(2)), _matrix(b.column(3))), centroids, pivots, pairs)
        return x, own, best

    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
            for b in _pieces(batches):
                x, own, _ = nearest(b, centroids)
                exact = x.astype(object) if np.abs(x).max(initial=0) >= 1 << 48 else x  # a block's sums fit 62 bits below that
                found = np.unique(own)
                total = [[str(v) for v in exact[own == c].sum(0)] for c in found]
                counts = np.bincount(own, minlength=len(centroids))[found]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts, pa.int64()), pa.array(total, pa.list_(pa.string()))], ["c", "n", "s"])

        found = known.mapInArrow(sums, "c int, n long, s array<string>")
        exact = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dimensions)]
        centroids = centroids.copy()
        for r in found.groupBy("c").agg(F.sum("n").alias("n"), *exact).collect():
            centroids[r["c"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dimensions)]

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            _, own, best = nearest(b, centroids)
            best = [int(d) if d < 1 << 63 else None for d in best]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.int32()), pa.array(best, pa.int64())], ["_k", "cluster", "distance"])

    done = store(known.select("_k", "_x", "_low", "_high").mapInArrow(last, f"_k {kind}, cluster int, distance long"))
    release(known)
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    total = lambda e: F.when(F.count("*") == F.count("distance"), e).try_cast("bigint")
    inertia = {r["cluster"]: r["i"] for r in done.groupBy("cluster").agg(total(exact).alias("i")).collect()}  # k rows
    every = None if None in inertia.values() else sum(inertia.values())
    every = None if every is None or every >= 1 << 63 else every
    digests = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    at = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))
    return done.select(
        F.col("_k").alias(key), "cluster", "distance",
        at([inertia.get(c) for c in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(every).cast("bigint").alias("inertia"), at(digests, "string").alias("centroid_sha256"),
    )


def cluster_sql(source: str = "embeddings") -> str:
    """The same in DuckDB's SQL; one pair of tables a round."""
    steps = [f"""r as (select vec_id, [cast(floor(v::double * {SCALE}) as bigint) for v in embedding] as x,
  sha256('{SEED}:' || vec_id::varchar) as h from {source}
  where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
p as (select row_number() over () as rid, vec_id, x, h from r),
c0 as (select (row_number() over (order by h nulls last, x) - 1)::int as c, x from p order by h nulls last, x limit {CLUSTERS})"""]
    near = """a{n} as (select rid, arg_min(c, (d, c)) as c, min(d) as d from
  (select p.rid, k.c, list_sum([(p.x[i] - k.x[i]) * (p.x[i] - k.x[i]) for i in range(1, {m})])::bigint as d from p cross join c{n} k) group by rid)"""
    for n in range(ROUNDS):
        steps.append(near.format(n=n, m=DIMENSIONS + 1))
        steps.append(f"""u{n} as (select c, list((s - ((s % n) + n) % n) // n order by i)::bigint[] as x from
  (select a.c, t.i, sum(p.x[t.i])::hugeint as s, count(*)::hugeint as n from a{n} a join p using (rid) cross join range(1, {DIMENSIONS + 1}) t(i) group by a.c, t.i) group by c),
c{n + 1} as (select k.c, coalesce(u.x, k.x) as x from c{n} k left join u{n} u using (c))""")
    steps.append(near.format(n=ROUNDS, m=DIMENSIONS + 1))
    return f"""with {", ".join(steps)}
select p.vec_id, a.c as cluster, a.d as distance, sum(a.d) over (partition by a.c)::bigint as cluster_inertia, sum(a.d) over ()::bigint as inertia,
  sha256(array_to_string(k.x, ',')) as centroid_sha256
from a{ROUNDS} a join p using (rid) join c{ROUNDS} k using (c)"""
