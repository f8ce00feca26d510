"""Hand-made cases: borders, ties, empty denominators, round trips, literals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.functions import colour, kernels
from cellgrove.functions import logits as L
from cellgrove.operators import cells as G
from cellgrove.operators import components, equalise, evaluate, filters, morphology, neighbourhood, report, sweep
from cellgrove.operators import masked as M
from cellgrove.plans import presets
from cellgrove.plans.recipe import run_recipe, run_variants, step
from cellgrove.sources import files

PAD = {"reflect": "symmetric", "reflect101": "reflect", "replicate": "edge"}


@pytest.mark.parametrize("border", ["reflect", "reflect101", "replicate", "constant"])
@pytest.mark.parametrize("r", [1, 5])
def test_borders_match_padding(grid, back, border, r):
    v = np.random.default_rng(r).random((4, 5))
    padded = np.pad(v, r, mode=PAD[border]) if border != "constant" else np.pad(v, r)
    k = {(dy, dx): 1.0 + dy + 10.0 * dx for dy in (-r, 0, r) for dx in (-r, 0, r)}
    got = back(neighbourhood.correlate(grid({1: {"v": v}}), "v", k, border, "o"), "o").astype(float)
    want = sum(w * padded[r + a : r + a + 4, r + b : r + b + 5] for (a, b), w in k.items())
    assert np.allclose(got, want)


def test_dilate_identity_erode_order_and_median(grid, back):
    v = np.random.default_rng(2).random((6, 6))
    df = grid({1: {"v": v}})
    out = morphology.extremes(df, {"lo": ("v", kernels.ellipse(5), "min"), "hi": ("v", kernels.ellipse(5), "max")})
    lo, hi = back(out, "lo").astype(float), back(out, "hi").astype(float)
    assert (lo <= v).all() and (v <= hi).all()
    p = np.pad(v, 1, mode="edge")
    want = np.median([p[a : a + 6, b : b + 6] for a in range(3) for b in range(3)], axis=0)
    assert np.allclose(back(filters.focal_median(df, "v", 3, "m"), "m").astype(float), want)


def test_elements_and_kernels():
    assert set(kernels.ellipse(3)) == {(-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)}
    assert len(kernels.ellipse(5)) == 17
    assert kernels.line_element(3, 45) == [(-1, 1), (0, 0), (1, -1)]
    for k in (kernels.gabor(7, 1.5, 30, 3.0, 0.5), kernels.matched_line(7, 1.0, 60)):
        assert sum(k.values()) == pytest.approx(0) and sum(map(abs, k.values())) == pytest.approx(1)
    assert sum(kernels.gaussian(1.0).values()) == pytest.approx(1)


def test_flips_are_involutions_and_four_turns_are_none(grid, back):
    v = np.random.default_rng(3).random((3, 5))
    df = grid({1: {"v": v}})
    for axis in ("horizontal", "vertical"):
        assert (back(G.flip(G.flip(df, axis), axis), "v") == v).all()
    assert (back(G.rot90(df, 1), "v") == np.rot90(v)).all()
    assert (back(G.rot90(df, 4), "v") == v).all()


def test_normalise_edges(grid, back):
    flat, spike = np.full((10, 10), 3.0), np.zeros((10, 10))
    spike[0, 0] = 8.0
    full, empty = np.ones((10, 10), bool), np.zeros((10, 10), bool)
    df = grid({1: {"v": flat, "m": full}, 2: {"v": spike, "m": full}, 3: {"v": spike, "m": empty}})
    fallback = M.normalise(df, "v", "m", "n")
    assert (back(fallback, "n", 1) == 0).all()
    assert back(fallback, "n", 2)[0, 0] == 1.0
    assert (back(fallback, "n", 3) == 0).all()
    masked = M.normalise(df, "v", "m", "n", "masked")
    assert (back(masked, "n", 3) == 0).all()


def test_clahe_handles_sizes_the_tiles_do_not_divide(grid, back):
    v = np.floor(np.random.default_rng(4).random((7, 9)) * 255)
    out = back(equalise.clahe(grid({1: {"v": v}}), "v", 2.0, (2, 2), "e"), "e").astype(float)
    assert out.shape == (7, 9) and out.min() >= 0 and out.max() <= 255


def test_zero_division_rules(spark):
    rows = [(1, 0, 0, 0, 5), (2, 0, 3, 0, 2), (3, 0, 0, 4, 1)]
    df = spark.createDataFrame(rows, "id int, tp long, fp long, fn long, tn long")
    for rule in ("guarded", "epsilon", "floor_one"):
        assert all(r.dice == 0 and r.precision == 0 and r.sensitivity == 0 for r in evaluate.overlap_metrics(df, rule).collect())


def test_argmax_and_soft_targets(spark):
    row = spark.range(1).select(
        L.argmax(F.array(*[F.lit(float(v)) for v in (1, 1, 0, 0, 0)])).alias("tie"),
        *[L.total(L.soft_targets(F.lit(c), 5, 0.1, 0.2, (0, 1, 2, 3))).alias(f"s{c}") for c in range(5)],
    ).first()
    assert row.tie == 0
    # the neighbour keeps its floor and gains a share, so every row sums to one
    assert all(row[f"s{c}"] == pytest.approx(1.0) for c in range(5))


def test_bias_sweep_prefers_no_bias_on_ties(spark):
    same = spark.createDataFrame([(0, [9.0, 0.0]), (1, [0.0, 9.0])], "y int, z array<double>")
    row = report.bias_sweep(same, "y", "z", 1, [0, 1]).first()
    assert row.bias == 0.0 and row.macro_f1 == row.base_macro_f1 == 1.0
    fixable = spark.createDataFrame([(0, [0.5, 1.0]), (1, [0.0, 9.0])], "y int, z array<double>")
    row = report.bias_sweep(fixable, "y", "z", 1, [0, 1]).first()
    assert row.bias == -3.0 and row.macro_f1 == 1.0 > row.base_macro_f1


def test_bias_sweep_against_each_bias(spark):
    rng = np.random.default_rng(8)
    z = np.round(rng.normal(size=(300, 4)), 1)  # many ties
    y = rng.integers(0, 4, 300)
    df = spark.createDataFrame([(int(a), [float(v) for v in b]) for a, b in zip(y, z)], "y int, z array<double>")
    for cls in (0, 2, 3):

        def f1(bias):
            moved = z.copy()
            moved[:, cls] += bias
            p, per = moved.argmax(1), []
            for c in range(4):
                both = ((y == c) & (p == c)).sum()
                per.append(2 * both / ((y == c).sum() + (p == c).sum()))
            return round(float(np.mean(per)), 12)

        tried = [(f1(b), -i, b) for i, b in [(-1, 0.0), *[(i, -3.0 + i * 0.05) for i in range(81)]]]
        row = report.bias_sweep(df, "y", "z", cls, [0, 1, 2, 3]).first()
        assert (row.bias, row.macro_f1, row.base_macro_f1) == (max(tried)[2], pytest.approx(max(tried)[0]), pytest.approx(f1(0.0)))


def test_lab_round_trip(spark):
    df = spark.range(125).select(*[((F.floor(F.col("id") / d) % 5) / 4.0).alias(c) for c, d in (("r", 1), ("g", 5), ("b", 25))])
    lab = df.select("*", *[v.alias(f"_{n}") for n, v in colour.rgb_to_lab(*[F.col(c) for c in "rgb"]).items()])
    rgb = lab.select("r", "g", "b", *[v.alias(f"{n}2") for n, v in colour.lab_to_rgb(F.col("_l"), F.col("_a"), F.col("_b")).items()])
    assert all(abs(r[c] - r[f"{c}2"]) < 2e-3 for r in rgb.collect() for c in "rgb")


def test_rounding_is_half_to_even(spark):
    row = spark.range(1).select(F.bround(F.lit(2.5), 0).alias("a"), F.bround(F.lit(3.5), 0).alias("b")).first()
    assert (row.a, row.b) == (2, 4)


def test_run_log(spark, tmp_path):
    (tmp_path / "run.log").write_text(
        "Fold 4: macro-F1=0.8203 (n=219)\n[svm_rbf] macro-F1=0.4964  acc=0.5000\n"
        '      Normal       0.93      0.92      0.93       236\nRESULT_JSON={"f1": 0.78, "accuracy": 0.83, "tag": "x"}\nnoise\n'
    )
    got = {r.kind: r for r in files.parse_run_log(spark, str(tmp_path)).collect()}
    assert (got["fold"].name, got["fold"].f1, got["fold"].n) == ("4", 0.8203, 219)
    assert (got["model"].name, got["model"].accuracy) == ("svm_rbf", 0.5)
    assert (got["class"].precision, got["class"].n) == (0.93, 236)
    assert (got["result"].name, got["result"].f1) == ("x", 0.78)


def test_pointers_and_quarantine(spark, tmp_path):
    oid = "a" * 64
    for name in ("Stage1/a.JPG", "Stage1/b.jpg", "Other/c.jpg", "Stage1/d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"{files.POINTER_HEAD}\noid sha256:{oid}\nsize 12\n" if "b" in name else "x" * 3000)
    manifest = files.scan_labelled(spark, str(tmp_path), {"Stage1": "Stage 1"}, ["Normal", "Stage 1"])
    assert {(r.label_id, r.key) for r in manifest.collect()} == {(1, "Stage_1_a"), (1, "Stage_1_b")}
    found = files.lfs_pointers(files.list_files(spark, str(tmp_path)))
    assert [(r.oid, r["size"]) for r in found.filter("is_pointer").collect()] == [(oid, 12)]
    good, bad = files.quarantine(manifest, found)
    assert (good.count(), bad.count()) == (1, 1)


def test_csv_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text("flag,n,v\nTrue,,0.5\n1,3,\nno,4,1\n")
    schema = spark.createDataFrame([], "flag boolean, n int, v double").schema
    rows = files.read_csv_typed(spark, str(tmp_path / "t.csv"), schema).collect()
    assert [tuple(r) for r in rows] == [(True, None, 0.5), (True, 3, None), (False, 4, 1.0)]


def test_group_map_skips_incomplete_rows(spark, tmp_path):
    (tmp_path / "g.json").write_text('[{"name": "x/a.jpg", "group": 4}, {"name": "b.jpg"}, {"group": 2}]')
    assert [tuple(r) for r in files.read_group_map(spark, str(tmp_path / "g.json")).collect()] == [("a", 4)]


def test_shortlist_falls_back_to_all_rows(spark):
    df = spark.createDataFrame([("a", 0.2, 0.9), ("b", 0.5, 0.1), ("c", 0.4, 0.4)], "k string, p double, r double")
    pick = lambda floor: {x.k for x in sweep.shortlist(df, "k", ["p", "r"], 1, ("p", floor)).collect()}
    assert pick(0.3) == {"b", "c"}
    assert pick(0.9) == {"a", "b"}


def test_variants_equal_separate_recipes(grid):
    rng = np.random.default_rng(6)
    df = grid({i: {"v": rng.random((8, 8)), "fov": np.ones((8, 8), bool)} for i in (1, 2)})
    first = step("normalise", "n", value="v", mask="fov")
    last = step("gaussian", "g", value="t", sigma=0.7, border="reflect")
    recipes = {name: [first, step("sql", "t", text=text), last] for name, text in (("a", "n * n"), ("b", "sqrt(n)"))}
    rows = lambda d: sorted((r.image_id, r.y, r.x, round(r.g, 9)) for r in d.collect())
    both = run_variants(df, recipes, ["g"])
    for name, steps in recipes.items():
        assert rows(both.filter(F.col("variant") == name)) == rows(run_recipe(df, steps, ["g"]))


def test_presets_are_made_of_known_operators():
    from cellgrove.plans.recipe import OPS

    for z in (presets.FULL, presets.SMALL):
        steps = [*presets.vessel_channel(z), *presets.ridge_channel(z), *presets.filter_stack(z), *presets.boost_dark(z)]
        steps += [*presets.assemble_responses(z), *presets.reduced_responses(z), *presets.soft_response(z), *presets.segment()]
        steps += [*presets.fine_branch(z), *presets.seed_mask("path", z), *presets.cost_surface(), *presets.rim_mask(z)]
        for name in presets.SOURCES:
            steps += presets.source_recipe(name, z)
        assert all(s.op in OPS for s in steps)


def test_enhance_light_keeps_greys_grey(grid):
    from cellgrove.operators.contrast import enhance_light

    v = np.floor(np.random.default_rng(8).random((8, 8)) * 255)
    df = grid({1: {"r": v, "g": v, "b": v, "m": np.ones((8, 8), bool)}})
    rows = enhance_light(df, ("r", "g", "b"), "m", tiles=(2, 2), sigma=0.8).collect()
    assert all(abs(r.enh_r - r.enh_g) <= 1 and abs(r.enh_g - r.enh_b) <= 1 for r in rows)
    assert max(r.enh_g for r in rows) > min(r.enh_g for r in rows)


@pytest.mark.parametrize("small_first", [True, False])
def test_label_after_union(grid, small_first):
    """A raster over several tiles stays one component whichever table a union names first."""
    small, large = grid({1: {"m": np.ones((8, 8), bool)}}), grid({2: {"m": np.ones((200, 200), bool)}})
    both = small.unionByName(large) if small_first else large.unionByName(small)
    found = components.label(both, "m").groupBy("image_id").agg(F.count_distinct("comp").alias("n")).collect()
    assert {r.image_id: r.n for r in found} == {1: 1, 2: 1}


def test_more_configurations_than_a_pack(spark):
    configs = spark.range(2_500).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    met = sweep.attach_configs(spark.range(3), configs)
    assert met.select("id", "cfg.a", "cfg.b").distinct().count() == 7_500
