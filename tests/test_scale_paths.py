"""The paths taken by hot groups and split rasters give the same result as the plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellgrove.operators import components as P
from cellgrove.operators import masked as M
from cellgrove.operators.duplicates import ncc_pairs, pair_components
from cellgrove.session import cut
from cellgrove.operators.folds import group_kfold_by_vectors, stratified_group_kfold, weighted_sample
from cellgrove.operators.graph import connected_components
from cellgrove.operators.quantiles import group_stats
from cellgrove.operators.ranking import bucketed_row_number, global_row_number
from cellgrove.operators.skeleton import thin
from cellgrove.operators.threshold import quantiles_at


def flood(mask, conn):
    """Lowest position per component, by plain flood fill."""
    h, w = mask.shape
    out = np.full(mask.shape, -1)
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (conn == 8 or abs(a) + abs(b) == 1)]
    for y in range(h):
        for x in range(w):
            if mask[y, x] and out[y, x] < 0:
                stack, name = [(y, x)], y * w + x
                while stack:
                    a, b = stack.pop()
                    if 0 <= a < h and 0 <= b < w and mask[a, b] and out[a, b] < 0:
                        out[a, b] = name
                        stack += [(a + i, b + j) for i, j in steps]
    return out


@pytest.mark.parametrize("plain_rows", [1 << 22, 0])
def test_percentiles_match_numpy(spark, plain_rows):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g, n in ((1, 400), (2, 7), (3, 1)) for v in np.round(rng.normal(size=n), 1)]
    df = spark.createDataFrame([*rows, (1, None)], "g int, v double").withColumn("n", F.lit(100))
    ps = {"a": 0.01, "b": 0.5, "c": 0.84, "d": 0.99}
    out = group_stats(df, ["g"], {k: (F.col("v"), p) for k, p in ps.items()}, {"m": F.max("v")}, "n", plain_rows)
    for r in out.collect():
        values = [v for g, v in rows if g == r.g]
        assert r.m == max(values)
        for k, p in ps.items():
            assert r[k] == pytest.approx(np.percentile(values, 100 * p), abs=1e-12)


def test_bucketed_rank_is_the_window(spark):
    df = spark.range(500).select("id", (F.col("id") % 3 == 0).cast("int").alias("g"), (F.col("id") * 7919 % 101).alias("k"))
    got = bucketed_row_number(df, ["g"], [(F.floor(F.col("k") / 10), False)], [F.col("k").desc(), F.col("id")], "rn", F.col("k"), "s")
    w = Window.partitionBy("g").orderBy(F.col("k").desc(), "id")
    want = df.withColumn("rn", F.row_number().over(w)).withColumn("s", F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    key = lambda d: sorted((r.id, r.rn, float(r.s)) for r in d.collect())
    assert key(got) == key(want)


def test_global_row_number(spark):
    df = spark.range(300).select((F.col("id") * 7919 % 300).alias("id"))
    assert all(r.id == r.row_index for r in global_row_number(df, ["id"]).collect())


@pytest.mark.parametrize("conn", [4, 8])
def test_components_across_tiles(spark, grid, back, conn):
    rng = np.random.default_rng(conn)
    masks = {i: rng.random((11, 13)) < 0.55 for i in (1, 2)}
    lab = P.label(grid({i: {"m": m} for i, m in masks.items()}), "m", conn=conn, tile=3)
    for i, m in masks.items():
        got = np.vectorize(lambda v: -1 if v is None else v)(back(lab, "comp", i))
        assert (got == flood(m, conn)).all()


def test_thin_is_the_same_in_tiles_and_keeps_components(spark, grid, back):
    rng = np.random.default_rng(3)
    mask = np.kron(rng.random((5, 6)) < 0.6, np.ones((4, 4))) > 0
    df = grid({1: {"m": mask}})
    whole = back(thin(df, "m", "s"), "s").astype(bool)
    tiled = back(thin(df, "m", "s", tile=5, halo=4), "s").astype(bool)
    assert (whole == tiled).all() and (whole <= mask).all()
    names = lambda a: len(set(flood(a, 8).ravel()) - {-1})
    assert names(whole) == names(mask)


def test_graph_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2)) if a != b]
    edges += [(200, i) for i in range(201, 260)] + [(i, i + 1) for i in range(300, 330)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    root = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert got == root


@pytest.mark.parametrize("cell_rows", [3, 1000])
def test_pairs_match_brute_force_and_copies_are_a_star(spark, cell_rows):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 12))
    vectors = [*base, *(base[:10] + 0.05 * rng.normal(size=(10, 12))), *[base[0]] * 5]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vec array<double>")
    pairs = ncc_pairs(df, "id", "vec", 0.95, 12, cell_rows=cell_rows)
    got = {(r.a, r.b) for r in pairs.collect()}
    unit = [(v - v.mean()) / np.linalg.norm(v - v.mean()) for v in vectors[:50]]
    want = {(i, j) for i in range(50) for j in range(i + 1, 50) if unit[i] @ unit[j] >= 0.95}
    assert got == want | {(0, 50 + i) for i in range(5)}
    groups = {r.id: r.group for r in pair_components(pairs).collect()}
    assert all(groups[50 + i] == 0 for i in range(5))


def test_pairs_of_crowded_cells_come_from_block_products(spark):
    vectors = np.random.default_rng(8).normal(size=(3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vec array<double>")
    pairs = ncc_pairs(df, "id", "vec", 0.8, 16, cell_rows=100)
    assert "CoGroup" in pairs._jdf.queryExecution().toString()
    unit = vectors - vectors.mean(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.8, 1))
    got = [(r.a, r.b) for r in pairs.collect()]
    assert sorted(got) == list(zip(a.tolist(), b.tolist()))


def test_group_folds_never_split_a_group(spark):
    # one group holds a third of all rows
    df = spark.range(900).select("id", F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 97 + 1).alias("g"), (F.col("id") % 3).alias("y"))
    out = stratified_group_kfold(df, "y", "g", 5, 1)
    assert out.count() == 900
    assert out.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n > 1").isEmpty()
    assert out.select("fold").distinct().count() == 5


@pytest.mark.parametrize("at_once", [2000, 200])
def test_group_folds_by_vectors_balance_every_class(spark, at_once):
    # classes mixed within the groups, a rare class, a group of a twelfth of the rows, a null group and null labels
    rng = np.random.default_rng(5)
    rows = [(int(g), int(c)) for g in range(1500) for c in rng.choice(4, rng.integers(1, 9), p=[0.6, 0.25, 0.13, 0.02])]
    rows += [(9999, 0)] * 600 + [(None, 1)] * 40 + [(7, None)] * 3
    df = spark.createDataFrame(rows, "g long, y long")
    out = cut(group_kfold_by_vectors(df, "y", "g", 5, 1, at_once))
    assert out.count() == len(rows)
    assert out.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n > 1").isEmpty()
    for c in range(4):
        per = [r["count"] for r in out.filter(F.col("y") == c).groupBy("fold").count().collect()]
        assert len(per) == 5 and max(per) - min(per) <= (4 if at_once == 2000 else 0.04 * sum(per) + 4), (c, per)


def test_group_folds_by_vectors_over_many_equal_groups(spark):
    df = spark.range(200_000).select((F.col("id") / 2).cast("long").alias("g"), (F.col("id") % 2).alias("y"))
    per = group_kfold_by_vectors(df, "y", "g", 5, 1).groupBy("fold", "y").count().collect()
    assert len(per) == 10 and all(abs(r["count"] - 20_000) <= 40 for r in per)
    empty = df.limit(0)
    assert group_kfold_by_vectors(empty, "y", "g", 5, 1).count() == 0


def test_weighted_sample_follows_the_weights(spark):
    df = spark.range(50)
    out = weighted_sample(df, "id", F.when(F.col("id") == 7, 50.0).otherwise(1.0), 3, n=20000)
    counts = {r.id: r["count"] for r in out.groupBy("id").count().collect()}
    assert sum(counts.values()) == 20000
    assert counts[7] / 20000 == pytest.approx(50 / 99, abs=0.02)
    assert max(v for k, v in counts.items() if k != 7) / 20000 == pytest.approx(1 / 99, abs=0.005)


def test_quantiles_at_each_images_own_share(spark):
    rng = np.random.default_rng(12)
    rows = [(g, float(v)) for g, n in ((1, 500), (2, 8), (3, 1), (5, 40)) for v in np.round(rng.normal(size=n), 1)]
    shares = {1: 0.93, 2: 0.5, 3: 0.2, 4: 0.4, 5: 1.0}
    df = spark.createDataFrame([*rows, (1, None), (4, None)], "image_id long, v double")
    got = quantiles_at(df, F.col("v"), spark.createDataFrame(list(shares.items()), "image_id long, p double"), "q", bins=7).collect()
    assert len(got) == 5
    for r in got:
        values = [v for g, v in rows if g == r.image_id]
        assert r.q == (pytest.approx(np.percentile(values, 100 * shares[r.image_id]), abs=1e-12) if values else None)
