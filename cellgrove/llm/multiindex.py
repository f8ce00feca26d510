"""Near-duplicate embeddings through an inverted multi-index.

Two codebooks, one for each half of the vectors, span a grid of cells. Every
vector is filed in the cell of its two nearest centroids. A query visits cells in
the order of the summed squared distances of its halves (multi-sequence
traversal), up to a reach above the nearest cell, and all it meets there is
verified by cosine in double precision.

The reach has two parts and is the farther one. The geometry of the codebooks gives
a floor: the gaps of made partners that lie exactly at the least cosine from sampled
queries, so it doesn't hang on which pairs the data has many of. And it is measured:
sampled queries are compared with every vector, and the wanted share of their true
pairs must be met, counted by pair, by query and by group of near vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.operators.graph import connected_components
from cellgrove.session import cut

COSINE, CENTROIDS, RECALL = 0.93, 32, 0.995
#: Bounds of the sample that codebooks are fitted on and of the queries that measure the reach.
FIT_ROWS, TEST_QUERIES = 8192, 1024
#: Vectors of a cell, and queries of it, that are compared in one block.
BLOCK = 512
#: Added to the measured reach; and the finest step in which it is measured.
MARGIN, STEP = 1.25, 1e-3
#: Partners that are made for each sampled query, of either kind.
MADE = 8
_STEPS = 4096


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ book.T + (book * book).sum(1), 0.0)


def fit(
    sample: np.ndarray, centroids: int = CENTROIDS, rounds: int = 12, seed: int = 7, weights: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks of both halves by Lloyd's rounds over unit vectors, each with its weight."""
    rng, books = np.random.default_rng(seed), []
    weights = np.ones(len(sample)) if weights is None else weights
    for half in np.array_split(sample, 2, axis=1):
        book = half[rng.choice(len(half), min(centroids, len(half)), replace=False, p=weights / weights.sum())].copy()
        for _ in range(rounds):
            own = _nearest(half, book).argmin(1)
            for c in np.unique(own):
                book[c] = np.average(half[own == c], axis=0, weights=weights[own == c])
        books.append(book)
    return books[0], books[1]


def gaps(unit: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For both halves, how much farther each centroid is than the nearest one."""
    out = []
    for half, book in zip(np.array_split(unit, 2, axis=1), books):
        d = _nearest(half, book)
        out.append(d - d.min(1, keepdims=True))
    return out[0], out[1]


def traverse(a: np.ndarray, b: np.ndarray, reach: float) -> list[int]:
    """Cells by rising ``a[i] + b[j]`` up to ``reach``: a heap over the two sorted lists."""
    order_a, order_b = a.argsort(kind="stable"), b.argsort(kind="stable")
    sa, sb = a[order_a].tolist(), b[order_b].tolist()
    heap, out = [(sa[0] + sb[0], 0, 0)], []
    while heap:
        far, i, j = heapq.heappop(heap)
        if far > reach:
            break
        out.append(int(order_a[i]) * len(b) + int(order_b[j]))
        if j + 1 < len(sb):
            heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(sa):
            heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))
    return out


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _alone(unit: np.ndarray, groups: np.ndarray, cosine: float) -> np.ndarray:
    """Weights by which a group of near vectors counts about as one vector."""
    near = [((unit[i : i + BLOCK] @ unit.T >= cosine) & (groups[i : i + BLOCK, None] == groups)).sum(1) for i in range(0, len(unit), BLOCK)]
    return 1 / np.maximum(np.concatenate(near), 1)


def _point(values: np.ndarray, weights: np.ndarray, share: float) -> float:
    """Smallest value up to which ``share`` of the weight lies."""
    order = values.argsort(kind="stable")
    sums = weights[order].cumsum()
    return float(values[order][min(int(np.searchsorted(sums, share * sums[-1] * (1 - 1e-12))), len(values) - 1)])


def floor_reach(queries: np.ndarray, weights: np.ndarray, pool: np.ndarray, books, cosine: float, recall: float, seed: int = 7) -> float:
    """Reach that meets ``recall`` of partners made at exactly ``cosine``, off in any direction or in one between two of ``pool``."""
    rng, i, out = np.random.default_rng(seed), np.arange(len(queries)), [0.0]
    ga, gb = gaps(queries, books)
    for along in (False, True):
        far, mass = [], []
        for _ in range(MADE):
            off = pool[rng.integers(len(pool), size=len(i))] - pool[rng.integers(len(pool), size=len(i))] if along else rng.normal(size=queries.shape)
            off = off - (off * queries).sum(1, keepdims=True) * queries
            long = np.linalg.norm(off, axis=1)
            ok = long > 1e-9
            off[ok] /= long[ok, None]
            da, db = gaps(cosine * queries + np.sqrt(max(0.0, 1 - cosine * cosine)) * off, books)
            far.append((ga[i, da.argmin(1)] + gb[i, db.argmin(1)])[ok])
            mass.append(weights[ok])
        far, mass = np.concatenate(far), np.concatenate(mass)
        if len(far):
            out.append(_point(far, mass, recall))
    return max(out)


def _measure_reach(distinct: DataFrame, queries: pd.DataFrame, books, cosine: float, recall: float) -> float:
    """Smallest reach at which ``recall`` of the pairs of the sample queries are met, with a margin; 0 without pairs."""
    spark = distinct.sparkSession
    known = spark.sparkContext.broadcast((queries["_id"].to_numpy(), queries["_g"].to_numpy(), _unit(queries["_v"]), books))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, groups, q, books = known.value
        ga, gb = gaps(q, books)
        for b in batches:
            u = _unit(b["_v"])
            da, db = gaps(u, books)
            ca, cb = da.argmin(1), db.argmin(1)
            hit = (q @ u.T >= cosine) & (groups[:, None] == b["_g"].to_numpy()[None, :]) & (ids[:, None] != b["_id"].to_numpy()[None, :])
            i, j = hit.nonzero()
            far = np.minimum((ga[i, ca[j]] + gb[i, cb[j]]) / STEP, _STEPS - 1).astype(np.int64)
            at, n = np.unique(i * _STEPS + far, return_counts=True)
            yield pd.DataFrame({"at": at, "n": n})

    # at most one row for each query and step
    found = distinct.select("_id", "_g", "_v").mapInPandas(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    if found.empty:
        return 0.0
    query, at, n = found["at"].to_numpy() // _STEPS, found["at"].to_numpy() % _STEPS, found["n"].to_numpy(float)
    return (max(_point(at, n / np.bincount(query, n)[query] ** k, recall) for k in range(3)) + 1) * STEP * MARGIN


def _forest(linked: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Edges that hold together what a matrix of links connects: each id to the smallest of its part."""
    out, todo = [], linked.any(1)
    while todo.any():
        part = np.zeros(len(rows), bool)
        part[todo.argmax()] = True
        size, across = 0, np.zeros(len(cols), bool)
        while part.sum() + across.sum() != size:
            size = part.sum() + across.sum()
            across = linked[part].any(0)
            part = part | linked[:, across].any(1)
        todo &= ~part
        ids = np.unique(np.concatenate([rows[part], cols[across]]))
        out += [(int(ids[0]), int(x)) for x in ids[1:]]
    return out


def near_duplicates(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cosine: float = COSINE,
    centroids: int = CENTROIDS,
    recall: float = RECALL,
) -> DataFrame:
    """Per row: ``key``, n_links, component_id (smallest key reachable) and kept (that is its own).

    Vectors are compared only within equal labels and lengths. Equal ones
    collapse to one with a multiplicity before anything is compared, so a large
    group of copies costs one row. Vectors that are null, zero or hold nulls or
    non-finite numbers, and rows without label, have no links and are components
    of their own; rows without key are such too, with a null component. Rows with equal
    keys count as rows of their own.

    A vector visits its own cell and those of higher number, so that each pair of
    unlike cells is met once. Cells are compared in blocks of bounded size, with more blocks where a cell
    or its queries are many. A block gives sums of links and a spanning forest,
    never its pairs.
    """
    ok = (
        F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(vector, lambda x: x != 0)
    )
    rows = vectors.select(F.col(key).alias("_k"), F.col(label).alias("_l"), F.col(vector).alias("_v"), F.coalesce(ok, F.lit(False)).alias("_ok"))
    distinct = rows.filter("_ok").groupBy("_l", "_v").agg(F.min("_k").alias("_id"), F.count("*").alias("_m"))
    distinct = cut(distinct.withColumn("_g", F.concat_ws(":", F.size("_v").cast("string"), F.col("_l").cast("string"))))

    links = distinct.select("_id", (F.col("_m") - 1).alias("n_links"), F.col("_id").alias("component_id"))
    # vectors of another length than the most common one are compared by their own index
    for length in [r[0] for r in distinct.select(F.size("_v")).distinct().collect()]:
        links = _linked(distinct.filter(F.size("_v") == length), links, cosine, centroids, recall)
    known = distinct.select("_l", "_v", "_id").join(links, "_id")
    named = rows.filter("_ok").join(known, ["_l", "_v"]).select("_k", "n_links", "component_id")
    alone = rows.filter(~F.col("_ok")).select("_k", F.lit(0).cast("long").alias("n_links"), F.col("_k").alias("component_id"))
    kept = F.coalesce(F.col("_k") == F.col("component_id"), F.lit(True))
    return named.unionByName(alone).select(F.col("_k").alias(key), "n_links", "component_id", kept.alias("kept"))


def _linked(distinct: DataFrame, links: DataFrame, cosine: float, centroids: int, recall: float) -> DataFrame:
    """``links`` with what the index of these distinct vectors adds."""
    spark = distinct.sparkSession
    seeded = distinct.orderBy(F.xxhash64("_id"), "_id")
    sample = seeded.limit(FIT_ROWS).select("_id", "_g", "_v").toPandas()
    known = _unit(sample["_v"])
    weights = _alone(known, sample["_g"].to_numpy(), cosine)
    books = fit(known, centroids, weights=weights)
    floor = floor_reach(known[:TEST_QUERIES], weights[:TEST_QUERIES], known, books, cosine, recall)
    reach = max(floor, _measure_reach(distinct, sample.head(TEST_QUERIES), books, cosine, recall))
    shared = spark.sparkContext.broadcast(books)

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books = shared.value
        for b in batches:
            da, db = gaps(_unit(b["_v"]), books)
            own = da.argmin(1) * len(books[1]) + db.argmin(1)
            visits = [[c for c in traverse(x, y, reach) if c >= o] for x, y, o in zip(da, db, own.tolist())]
            yield b.assign(_own=own.astype(np.int32), _visits=visits)

    kind = distinct.schema["_v"].dataType.simpleString()
    filed = distinct.select("_id", "_g", "_m", "_v").mapInPandas(locate, f"_id long, _g string, _m long, _v {kind}, _own int, _visits array<int>")
    filed = cut(filed)
    asked = filed.select("_id", "_g", F.explode("_visits").alias("_cell"))
    held = filed.groupBy("_g", F.col("_own").alias("_cell")).agg(F.count("*").alias("_held"))
    sizes = asked.groupBy("_g", "_cell").agg(F.count("*").alias("_asked")).join(held, ["_g", "_cell"])
    sizes = sizes.select("_g", "_cell", F.ceil(F.col("_held") / BLOCK).cast("int").alias("_hs"), F.ceil(F.col("_asked") / BLOCK).cast("int").alias("_as"))
    piece = lambda n: F.pmod(F.xxhash64("_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = ["_g", "_cell", "_h", "_a"]
    index = filed.select("_id", "_g", F.col("_own").alias("_cell"), "_m", "_v").join(sizes, ["_g", "_cell"])
    index = index.withColumn("_h", piece("_hs")).withColumn("_a", every("_as")).select(*block, "_id", "_m", "_v")
    query = filed.select("_id", "_g", F.explode("_visits").alias("_cell"), "_own", "_m", "_v").join(sizes, ["_g", "_cell"])
    query = query.withColumn("_a", piece("_as")).withColumn("_h", every("_hs")).select(*block, "_id", "_own", "_m", "_v")

    index = index.toDF(*index.columns)  # columns of its own: both sides come from one table

    def verify(asking: pd.DataFrame, holding: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asking) and len(holding):
            x, y = asking["_id"].to_numpy(), holding["_id"].to_numpy()
            near = (_unit(asking["_v"]) @ _unit(holding["_v"]).T >= cosine) & (x[:, None] != y[None, :])
            n = near @ holding["_m"].to_numpy()
            # a pair of unlike cells is met from the lower cell only and counts for both
            away = (asking["_own"] != asking["_cell"]).to_numpy()
            back = asking["_m"].to_numpy()[away] @ near[away]
            out = [(int(i), int(i), int(k)) for i, k in [*zip(x, n), *zip(y, back)] if k] + [(a, b, 0) for a, b in _forest(near, x, y)]
        return pd.DataFrame(out, columns=["a", "b", "n"]).astype("int64")

    met = cut(query.groupBy(*block).cogroup(index.groupBy(*block)).applyInPandas(verify, "a long, b long, n long"))
    sums = met.filter("n > 0").groupBy(F.col("a").alias("_id")).agg(F.sum("n").alias("_more"))
    roots = connected_components(met.filter("n = 0").distinct(), "a", "b").select(F.col("node").alias("_id"), F.col("root").alias("_root"))
    return links.join(sums, "_id", "left").join(roots, "_id", "left").select(
        "_id", (F.col("n_links") + F.coalesce("_more", F.lit(0))).alias("n_links"), F.coalesce("_root", "component_id").alias("component_id")
    )
